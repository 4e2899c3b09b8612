"""Best-fit packing: vector best-fit over residual token, document-count and attention-cost capacities.

Pieces of equal length are alike, so the choice of bins works on the histogram of lengths
(at most ``capacity`` rows, however large the input): lengths in falling order go to the
open bins whose state scores best under every constraint. Bins in the same state are one
group, held as a range of sequence numbers. Each piece then finds its place from its rank
among the pieces of its length, which tasks count by themselves and whose offsets one
small aggregation adds up. No piece passes the driver and no task holds a whole group.

Defined results: null or empty text is one piece with only the closing id; repeated rows
are packed each; a null doc_id is packed like any other; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

CACHE = 400_000
#: White space to str.split() but not to the tokenizer's patterns.
ODD_SPACES = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Latin letters, then ASCII punctuation without an apostrophe: what the tokenizer's patterns cut in two and change no further than to lower case.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a printable character: itself, or the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Cache(dict):
    """Keeps what ``make`` gives for a key; forgets all when it holds CACHE keys."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        x = self[key] = self.make(key)
        return x


class _Ids:
    """Texts to ids, as little-endian unsigned 32-bit numbers. No id spans white space, so a text's ids are those of its words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.letters = Tokenizer.from_file(path), byte_letters()
        self.parts, self.words = _Cache(self._part), _Cache(self._word)

    def encode(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        """What the patterns leave whole goes to the tokenizer's model directly, which spares most of the time."""
        return np.asarray([x.id for x in self.tokenizer.model.tokenize(part.encode().decode("latin-1").translate(self.letters))], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        m = PLAIN.fullmatch(word)
        if not m:
            return self.encode(word)
        return self.parts[m[1].lower()] + self.parts[m[2]] if m[2] else self.parts[m[1].lower()]

    def text(self, text: str) -> bytes:
        if any(c in text for c in ODD_SPACES):
            return self.encode(text)
        return b"".join(map(self.words.__getitem__, text.split()))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; task and rank number the pieces of a length within a task."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, task = _Ids(tokenizer), TaskContext.get().partitionId()
        used = np.zeros(capacity + 1, np.int64)
        for b in batches:
            rows, owners = [], []
            for row, text in enumerate(b.column("text").to_pylist()):
                ids = ids_of.text(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    rows.append((k, at // 4, n, zlib.crc32(part), task, used[n]))
                    owners.append(row)
                    used[n] += 1
            x = np.array(rows, np.int64).reshape(-1, 6)
            columns = [pa.array(np.ascontiguousarray(x[:, k])) for k in range(6)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(owners, pa.int32())), columns[0].cast(pa.int32()), *columns[1:]], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task long, rank long")


def plan(lengths: dict[int, int], capacity: int, max_docs: int, max_cost: int, rule: str = "residual_norm", weights=(1.0, 1.0, 1.0)) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, first sequence, bins, copies a bin, offset): where the pieces of each length go.

    A piece of length l takes (l, 1, l * l) of a bin. ``residual_norm`` picks the group of bins
    with the least weighted norm of what stays free, ``dot_product`` the one whose free
    capacity is most along the piece. No group that lacks any capacity is a candidate.
    """
    caps, w = np.array([capacity, max_docs, max_cost], float), np.asarray(weights, float)
    first, count, free, filled = [], [], [], []
    out, opened = [], 0
    for length in sorted(lengths, reverse=True):
        left, rank = lengths[length], 0
        item = np.array([length, 1, length * length], float)
        if np.any(item > caps):
            raise ValueError(f"a piece of {length} tokens doesn't fit in an empty bin")
        while left:
            best = -1
            if free:
                f = np.asarray(free)
                fits = np.flatnonzero((f >= item).all(1))
                if len(fits):
                    share = f[fits] / caps
                    value = (w * ((f[fits] - item) / caps) ** 2).sum(1) if rule == "residual_norm" else -(w * share * (item / caps)).sum(1)
                    best = fits[np.argmin(value)]
            if best < 0:  # open as many bins as the rest of this length needs
                each = int(min(caps // item))
                n = -(-left // each)
                first.append(opened)
                count.append(n)
                free.append(caps.copy())
                filled.append(0)
                opened += n
                best = len(first) - 1
            each = min(int(min(free[best] // item)), left)
            n = min(count[best], left // each)
            out.append((length, rank, first[best], n, each, filled[best]))
            rank, left = rank + n * each, left - n * each
            rest, to = free[best] - each * item, filled[best] + each * length
            if n < count[best]:  # the other bins keep their state
                first.append(first[best] + n)
                count.append(count[best] - n)
                free.append(free[best])
                filled.append(filled[best])
            if rest[0] < 1 or rest[1] < 1 or rest[2] < 1:
                for x in (first, count, free, filled):
                    x.pop(best)
            else:
                count[best], free[best], filled[best] = n, rest, to
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, max_docs: int | None = None, max_cost: int | None = None, rule: str = "residual_norm", weights=(1.0, 1.0, 1.0)) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``max_docs`` and ``max_cost`` (the sum of squared lengths) bound a sequence besides its
    tokens; by default they can't bind."""
    made = cut(pieces(docs, tokenizer, capacity, end_id))
    counts = made.groupBy("task", "length").agg(F.count("*").alias("n"))
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    if not lengths:
        return made.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    steps = np.array(plan(lengths, capacity, max_docs or capacity, max_cost or capacity * capacity, rule, weights), np.int64)
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    keys = steps[:, 0] << 40 | steps[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        _, start, seq, _, each, filled = steps[np.searchsorted(keys, length << 40 | rank, "right") - 1].T
        k = rank - start
        return pd.DataFrame({"sequence_id": seq + k // each, "offset": filled + k % each * length})

    order = np.argsort(keys, kind="stable")
    steps, keys = steps[order], keys[order]
    ranked = made.join(before.select("task", "length", "before"), ["task", "length"])
    return ranked.withColumn("at", place("length", F.col("rank") + F.coalesce("before", F.lit(0)))).select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
