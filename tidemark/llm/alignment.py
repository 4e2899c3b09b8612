"""Alignment of two tokenizers' ids over the same bytes.

Both tokenizers spell a text byte for byte. Where a token of either ends at the same byte, the text is cut: what lies between
two cuts is a group, some ids of A over some ids of B. A's and B's tokens that end a group are linked.

Groups repeat far more than texts do, so they are interned. A chunk, a bounded run of rows within a task, numbers its distinct
groups; its rows keep numbers and how often each occurs. The chunks' dictionaries meet in one
table of distinct groups with their corpus-wide frequencies. Links are expanded once for each distinct group and multiplied by its
frequency, which gives each id pair's count and each B id's highest. What a group is worth (links, links whose count is the
highest of their B id, the sum of counts) is joined back by group key to the chunks' dictionaries, and by chunk to the rows.

A group key is its text, ``a1,a2|b1``: nothing depends on hashes. No dictionary is broadcast or held whole; hot groups
come once for each chunk, not once for each document. Two tokens that end together are one a suffix of the other, so there are at
most as many id pairs as the vocabularies' tokens have bytes, whatever the corpus, and with byte pieces about twice that.

Defined results: texts that are null or empty, or that a tokenizer doesn't spell byte for byte (special pieces, normalised
characters), have no tokens: zeros and an empty digest. Repeated rows have results each and count each. An empty table gives no
rows; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .packing import byte_letters

#: A chunk ends beyond so many distinct groups, or numbers held for rows.
DISTINCT, HELD = 1 << 18, 1 << 22
#: Characters of texts that are tokenized together.
TOGETHER = 1 << 20
# Fixed value: the pattern by which byte-level vocabularies cut a text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The space that the second tokenizer's pieces write.
BLANK = "▁"

ROW = "chunk long, row int, n_a long, n_b long, n_groups long, groups_sha256 string, own array<int>, times array<int>"


def byte_level(path: str) -> tuple[list[bytes], Callable[[list[str]], list[list[int]]]]:
    """The bytes of each id of a byte-level vocabulary file, and a function from texts to ids; special tokens are ordinary text.

    Where the file says nothing but that merges go by rank, the library for ranks encodes, to the same ids in a fifth of the time."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    letters = {c: v for v, c in byte_letters().items()}
    names = {v: k for k, v in made.get_vocab().items()}
    spelled = [bytes(map(letters.__getitem__, names[k])) if k in names and letters.keys() >= set(names[k]) else b"" for k in range(max(names) + 1)]
    file = json.loads(made.to_str())
    model, cut_by = file["model"], file["pre_tokenizer"] or {}
    special = {x["id"] for x in file["added_tokens"]}
    ids = [model["vocab"]["".join(m)] for m in model["merges"]]
    others = [model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
    if model["type"] == "BPE" and not others and not file["normalizer"] and cut_by.get("type") == "ByteLevel" and cut_by["use_regex"] and not cut_by["add_prefix_space"] and ids == sorted(ids) and len(ids) + 256 + len(special) == len(names):
        import tiktoken

        ranks = {b: k for k, b in enumerate(spelled) if k not in special}
        encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return spelled, lambda texts: list(map(encoding.encode_ordinary, texts))
    return spelled, lambda texts: [x.ids for x in made.encode_batch_fast(texts, add_special_tokens=False)]


class Pair:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, a: str, b: str):
        from sentencepiece import SentencePieceProcessor

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.a_bytes, self.a = byte_level(a)
        self.b = SentencePieceProcessor(model_file=b)
        self.b_bytes = [self._piece(k) for k in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))

    def _piece(self, k: int) -> bytes:
        piece = self.b.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace(BLANK, " ").encode()

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Each text's ids by A (of a space and the text) and by B (which adds the space); None where they don't spell the text."""
        a = self.a([" " + t for t in texts])
        b = self.b.encode(texts, num_threads=1)
        for text, x, y in zip(texts, a, b):
            spelled = b" " + text.encode()
            if text and b"".join(map(self.a_bytes.__getitem__, x)) == spelled and b"".join(map(self.b_bytes.__getitem__, y)) == spelled:
                yield np.array(x, np.int64), np.array(y, np.int64)
            else:
                yield None


def cuts(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of A's and B's tokens that end at the same byte, in order. Every token has a byte at least."""
    _, i, j = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
    return i, j


class Interned:
    """Numbers for distinct groups, in order of arrival."""

    def __init__(self):
        self.number: dict = {}
        self.names: list[str] = []
        self.held = 0

    def numbers(self, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[int]:
        """The group of each cut: A's ids up to i and B's up to j, from the cut before on."""
        number, names, out = self.number, self.names, []
        a_list, b_list, s, t = a.tolist(), b.tolist(), 0, 0
        for p, q in zip((i + 1).tolist(), (j + 1).tolist()):
            # most groups are one id over one: their key is a number
            key = a_list[s] << 32 | b_list[t] if p - s == 1 == q - t else (*a_list[s:p], -1, *b_list[t:q])
            n = number.get(key)
            if n is None:
                n = number[key] = len(names)
                names.append(f"{','.join(map(str, a_list[s:p]))}|{','.join(map(str, b_list[t:q]))}")
            out.append(n)
            s, t = p, q
        return out


def _aligned(docs: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """Rows of texts (``name`` null) and of the chunks' dictionaries (``name`` set, ``row`` its number, ``n_a`` how often)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, group, total, chunk = Pair(a, b), Interned(), np.zeros(0, np.int64), TaskContext.get().partitionId() << 32
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            start = 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and (end == start or size + len(texts[end] or "") <= TOGETHER):
                    size += len(texts[end] or "")
                    end += 1
                rows, used = [], np.zeros(0, np.int64)
                for ids in pair.encode([t or "" for t in texts[start:end]]):
                    if ids is None:
                        rows.append((0, 0, 0, "", [], []))
                        continue
                    x, y = ids
                    i, j = cuts(np.cumsum(pair.a_size[x]), np.cumsum(pair.b_size[y]))
                    numbers = group.numbers(x, y, i, j)
                    names = group.names
                    digest = hashlib.sha256(";".join([names[n] for n in numbers]).encode()).hexdigest()
                    own, times = np.unique(np.array(numbers, np.int32), return_counts=True)
                    rows.append((len(x), len(y), len(numbers), digest, own, times.astype(np.int32)))
                    if len(total) < len(names):
                        total = np.concatenate([total, np.zeros(len(names), np.int64)])
                    total[own] += times
                    group.held += len(own)
                yield _rows(keys.slice(start, end - start), chunk, rows)
                start = end
                if len(group.names) > DISTINCT or group.held > HELD:
                    yield from _dictionary(keys.type, chunk, group.names, total)
                    group, total, chunk = Interned(), np.zeros(0, np.int64), chunk + 1
        if group.names:
            yield from _dictionary(keys.type, chunk, group.names, total)

    return docs.select(key, "text").mapInArrow(run, f"key {kind}, {ROW}, name string")


def _batch(keys: pa.Array, chunk: int, row: np.ndarray, n_a, n_b, n_groups, digest, own, times, name) -> pa.RecordBatch:
    ints = pa.list_(pa.int32())
    columns = [keys, pa.array(np.full(len(keys), chunk)), pa.array(row.astype(np.int32)), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(n_groups, pa.int64()), pa.array(digest, pa.string()), pa.array(own, ints), pa.array(times, ints), pa.array(name, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["key", *[c.split()[0] for c in ROW.split(", ")], "name"])


def _rows(keys: pa.Array, chunk: int, rows: list[tuple]) -> pa.RecordBatch:
    return _batch(keys, chunk, np.zeros(len(rows)), *map(list, zip(*rows)), [None] * len(rows))


def _dictionary(kind: pa.DataType, chunk: int, names: list[str], total: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(names), 1 << 16):
        part = names[at : at + (1 << 16)]
        none = [None] * len(part)
        yield _batch(pa.nulls(len(part), kind), chunk, np.arange(at, at + len(part)), total[at : at + len(part)], none, none, none, none, none, part)


def worth(dictionary: DataFrame) -> DataFrame:
    """name, links, best, counts of every distinct group, from rows (name, n).

    Of each group the last ids end together, so a group has one link; ties for a B id's highest count all count.
    The table of id pairs is bounded by the vocabularies (see above), so it may be broadcast: a pair that ends very many groups is no hot key."""
    last = lambda side: F.element_at(F.split(F.element_at(F.split("name", r"\|"), side), ","), -1).cast("int")
    links = cut(dictionary.groupBy("name").agg(F.sum("n").alias("n")).select("name", "n", last(1).alias("a"), last(2).alias("b")))
    pairs = links.groupBy("a", "b").agg(F.sum("n").alias("count"))
    highest = pairs.groupBy("b").agg(F.max("count").alias("highest"))
    pairs = cut(pairs.join(highest, "b").select("a", "b", "count", (F.col("count") == F.col("highest")).cast("long").alias("best")))
    return links.join(F.broadcast(pairs), ["a", "b"]).select("name", F.lit(1).cast("long").alias("links"), "best", F.col("count").alias("counts"))


def _summed(rows: pa.Table, groups: pa.Table) -> pa.Table:
    """A chunk's rows with n_links, n_best and count_sum, from what its groups (by number) are worth."""
    order = np.argsort(groups["row"].to_numpy())
    own, times = (rows[c].combine_chunks() for c in ("own", "times"))
    ends = np.concatenate([[0], np.cumsum(np.diff(own.offsets.to_numpy()))])
    numbers, n = own.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    out = {c: rows[c] for c in ("key", "n_a", "n_b", "n_groups")}
    for c, name in (("links", "n_links"), ("best", "n_best"), ("counts", "count_sum")):
        upto = np.concatenate([[0], np.cumsum(groups[c].to_numpy()[order][numbers] * n if len(numbers) else np.zeros(0, np.int64))])
        out[name] = pa.array(np.diff(upto[ends]).astype(np.int64))
    return pa.table(out | {"groups_sha256": rows["groups_sha256"]})


def align(docs: DataFrame, a: str, b: str, key: str = "doc_id") -> DataFrame:
    """``key``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    ``a`` is the file of a byte-level vocabulary, ``b`` that of a piece vocabulary with byte fallback."""
    made = cut(_aligned(docs, a, b, key))
    dictionary = made.where("name is not null").select("chunk", "row", "name", F.col("n_a").alias("n"))
    known = dictionary.join(worth(dictionary), "name").select("chunk", "row", "links", "best", "counts")
    rows = made.where("name is null").select("chunk", "key", "n_a", "n_b", "n_groups", "groups_sha256", "own", "times")
    kind = docs.schema[key].dataType.simpleString()
    rows, known = rows.toDF(*rows.columns), known.toDF(*known.columns)  # distinct, though both come from one table
    out = rows.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_summed, f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("key", key)


def id_pairs(docs: DataFrame, a: str, b: str, key: str = "doc_id") -> DataFrame:
    """a, b, count, highest: every linked id pair of the corpus, and whether its count is the highest of its B id."""
    x = worth(_aligned(docs, a, b, key).where("name is not null").select("name", F.col("n_a").alias("n")))
    last = lambda side: F.element_at(F.split(F.element_at(F.split("name", r"\|"), side), ","), -1).cast("int")
    return x.select(last(1).alias("a"), last(2).alias("b"), F.col("counts").alias("count"), (F.col("best") == 1).alias("highest")).distinct()
