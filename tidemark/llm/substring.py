"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

Every document's windows of ``window`` words are shared out into blocks: consecutive windows
with the same rarest-hash gram (their anchor) are one block, so equal windows meet under
equal anchors wherever they stand. The index holds, of each block, its first place: the smallest
doc_id, there the first word. A document is parsed against it from left to right: a block that
stands in an earlier document continues the factor at hand if it goes on at the next place of the
same reference, and else begins the next factor. Where a factor meets a block that only shares its anchor
with other blocks, the factor's boundary runs through that block, and its windows are looked up one
by one, so a factor ends at the very word where its reference stops matching. Factors of at least
``window`` words are duplicate spans; what they cover goes.

Blocks and windows are compared by two 64-bit polynomial hashes of their words.

Defined results: null text has no words; a row with null doc_id is neither reference nor
judged, so it stays whole; rows with one doc_id are no references to each other, and each is judged by its own text;
texts shorter than the window stay whole; ids of any type come back as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, done

GRAM, CACHE, STEP = 12, 300_000, 1 << 16
KEY = ["doc_id", "v"]
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class _Hashes(dict):
    """A word's two hashes as 16 bytes; forgets all when it holds CACHE words."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh128_digest(word)
        return h


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class _Text:
    """The words of a text with prefix sums, from which any run of words has a position-free hash."""

    def __init__(self, words: list[bytes], hashes: _Hashes):
        h = np.frombuffer(b"".join(map(hashes.__getitem__, words)), "<u8").reshape(-1, 2)
        self.n = len(words)
        self.back = _powers(INVERSE, self.n + 1)
        power = _powers(BASE, self.n)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(h[:, k] * power, dtype=np.uint64)]) for k in (0, 1)]

    def runs(self, start: np.ndarray, length, which: int) -> np.ndarray:
        s = self.sums[which]
        h = (s[start + length] - s[start]) * self.back[start]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def _anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """Of each window, the place of its smallest gram, the first of equals."""
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    return np.concatenate([view[a : a + STEP].argmin(1) + np.arange(a, min(a + STEP, len(view))) for a in range(0, len(view), STEP)])


def _table(source: pa.RecordBatch, rows: list[int], columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The keys of these rows of ``source``, as they are, beside new columns."""
    at = pa.array(rows, pa.int32())
    return pa.RecordBatch.from_arrays([*(source.column(k).take(at) for k in KEY), *columns.values()], [*KEY, *columns])


def _keys(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, v long"


def blocks(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, v, anchor, b1, b2, start, n: the blocks of every document; n windows from word ``start`` on. ``docs``: doc_id, v, text, no nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            rows, owners = [], []
            for row, text in enumerate(b.column("text").to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split()
                if len(words) < window:
                    continue
                t = _Text(words, hashes)
                grams = t.runs(np.arange(t.n - GRAM + 1), GRAM, 0)
                at = _anchors(grams, window - GRAM + 1)
                start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                n = np.diff(np.concatenate([start, [len(at)]]))
                shift = (at[start] - start).astype(np.uint64) * np.uint64(BASE)
                b1, b2 = (t.runs(start, n + window - 1, k) ^ shift ^ n.astype(np.uint64) for k in (0, 1))
                rows.append(np.column_stack([grams[at[start]].view(np.int64), b1.view(np.int64), b2.view(np.int64), start, n]))
                owners += [row] * len(start)
            if rows:
                x = np.concatenate(rows)
                kinds = (("anchor", np.int64), ("b1", np.int64), ("b2", np.int64), ("start", np.int32), ("n", np.int32))
                yield _table(b, owners, {c: pa.array(np.ascontiguousarray(x[:, k], kind)) for k, (c, kind) in enumerate(kinds)})

    return docs.select(*KEY, "text").mapInArrow(run, f"{_keys(docs)}, anchor long, b1 long, b2 long, start int, n int")


def _windows(docs: DataFrame, open_blocks: DataFrame, window: int) -> DataFrame:
    """doc_id, v, w1, w2, start of every window in blocks where a factor may end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            for row, (text, start, n) in enumerate(zip(*(b.column(c).to_pylist() for c in ("text", "start", "n")))):
                t = _Text(text.encode("utf-8", "surrogatepass").split(), hashes)
                at = np.unique(np.concatenate([np.arange(s, s + k) for s, k in zip(start, n)]))
                yield _table(b, [row] * len(at), {"w1": pa.array(t.runs(at, window, 0).view(np.int64)), "w2": pa.array(t.runs(at, window, 1).view(np.int64)), "start": pa.array(at.astype(np.int32))})

    need = open_blocks.groupBy(*KEY).agg(F.collect_list(F.struct("start", "n")).alias("s")).select(*KEY, F.col("s.start").alias("start"), F.col("s.n").alias("n"))
    return docs.join(need, KEY).select(*KEY, "text", "start", "n").mapInArrow(run, f"{_keys(docs)}, w1 long, w2 long, start int")


def pieces(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, v, start, n, ref, ref_start: runs of n windows from word ``start`` that stand, from word ``ref_start``, in the earlier document ``ref`` too."""
    docs = docs.select(*KEY, "text")
    made = cut(blocks(docs, window))
    key = ["anchor", "b1", "b2"]
    place = F.struct("doc_id", "start").alias("place")
    kinds = made.groupBy(*key).agg(F.min(place).alias("first"))
    shared = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("first.doc_id").alias("least"), F.max("first.doc_id").alias("most"))
    index = kinds.join(shared, "anchor").select(*key, "first", ((F.col("kinds") > 1) & (F.col("least") < F.col("most"))).alias("open"))
    whole = F.col("doc_id") > F.col("first.doc_id")
    found = cut(made.join(index, key).where(whole | F.col("open")).select(*KEY, "start", "n", F.when(whole, F.col("first")).alias("first")))
    done(made)
    windows = cut(_windows(docs, found.where("first is null"), window))
    least = windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id < last").drop("last")
    single = windows.join(least, ["w1", "w2"]).where("doc_id > first.doc_id").select(*KEY, "start", F.lit(1).alias("n"), "first")
    out = cut(found.where("first is not null").unionByName(single).select(*KEY, "start", "n", F.col("first.doc_id").alias("ref"), F.col("first.start").alias("ref_start")))
    done(found, windows)
    return out


def parse(start: list[int], n: list[int], ref: list, ref_start: list[int], window: int) -> list[tuple]:
    """Factors (start, words, ref, ref_start), from left to right: a piece lengthens the factor if it continues it at the next place of its reference."""
    out: list[list] = []
    for s, k, r, p in sorted(zip(start, n, ref, ref_start)):
        last = out[-1] if out else None
        if last and last[2] == r and s == last[0] + last[1] - window + 1 and p == last[3] + s - last[0]:
            last[1] += k
        else:
            out.append([s, k + window - 1, r, p])
    return [tuple(x) for x in out if x[1] >= window]


def dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (the kept words joined by one space), kept_sha256, factors."""
    base = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    once = base.groupBy("doc_id").count().where("count > 1").isEmpty()
    v = F.lit(0).cast("bigint") if once else F.xxhash64("text")
    base = base.withColumn("v", v)
    columns = ("start", "n", "ref", "ref_start")
    found = pieces(base if once else base.dropDuplicates(KEY), window).groupBy(*KEY).agg(F.collect_list(F.struct(*columns)).alias("s")).select(*KEY, *[F.col(f"s.{c}").alias(c) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, *found in zip(*(b.column(c).to_pylist() for c in ("text", *columns))):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                total = len(words)
                spans = parse(*found, window) if found[0] else []
                if spans:
                    step = np.zeros(total + 1, np.int64)
                    np.add.at(step, [x[0] for x in spans], 1)
                    np.add.at(step, [x[0] + x[1] for x in spans], -1)
                    words = [w for w, covered in zip(words, np.cumsum(step).tolist()) if not covered]
                kept = b" ".join(words)
                rows.append((total, total - len(words), kept.decode("utf-8", "surrogatepass"), hashlib.sha256(kept).hexdigest(), len(spans)))
            n_words, n_removed, text, sha, factors = zip(*rows) if rows else ((),) * 5
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), long(n_words), long(n_removed), pa.array(text, pa.string()), pa.array(sha, pa.string()), long(factors)], names)

    names = ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256", "factors"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    x = docs.select("doc_id", "text").withColumn("v", v).join(found, KEY, "left").select("doc_id", "text", *columns)
    return x.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_text string, kept_sha256 string, factors long")
