"""Importance resampling towards a target distribution, over hashed n-grams.

Features are the runs of one to ``longest`` words. Each task keeps a trie of words: a node is a run, its parent the run without
its last word. A node holds its count and its CRC-32 state, which its children carry on from, so a run's bucket
costs only its last word's bytes. When a trie holds enough nodes or bytes, its counts go to the task's bucket
totals and it starts anew: memory is bounded, and only one row for each task and bucket is shuffled.

With both corpora's totals merged, every bucket has a gain, the floored logarithm of the ratio of its smoothed shares.
Documents are then scored by walking the same kind of trie, whose nodes have their bucket's gain attached; a document's weight
is the mean over its features. Gumbel noise from a hash of the key turns the largest scores into a sample without replacement.
The ranks of the sampled rows come from range partitions; nothing but bucket totals passes the driver.

Inside a task all this works on arrays: an Arrow batch's words become node numbers level by level, one lookup for each
distinct (parent, word).

Defined results: null, empty and wordless texts have no features and weight 0; repeated rows are scored each, and share a key's
noise; a null key has noise of its own and ranks last among ties; an empty target or corpus has totals of 0; an empty
table gives no rows; other columns don't matter to ``score`` and pass through ``resample``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Per byte: A-Z to lower case, ASCII that isn't a letter or digit to a space, all others as they are.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and not (48 <= b <= 57 or 97 <= b <= 122) else b for b in range(256))
#: A trie starts anew beyond so many nodes, or bytes of words.
NODES, BYTES = 1 << 20, 1 << 26
#: Words whose texts are taken together; one text isn't cut.
TOGETHER = 1 << 20


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class Trie:
    """Nodes by number, a level for each length of run; the first level's parent is the root."""

    def __init__(self, buckets: int, longest: int, gains: np.ndarray | None = None):
        self.buckets, self.longest, self.gains = buckets, longest, gains
        self.totals = np.zeros(buckets, np.int64)
        self._clear()

    def _clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.spelled: list[bytes] = []
        self.children: list[dict[int, int]] = [{} for _ in range(self.longest - 1)]
        self.bytes = 0
        self.state = np.zeros(1024, np.int64)  # of every node, in the order of their numbers
        self.value = np.zeros(1024, np.int64)  # its count, or its gain
        self.n = 0

    def _grow(self, states: list[int]) -> int:
        """Nodes with these CRC states; the number of the first."""
        first, self.n = self.n, self.n + len(states)
        if self.n > len(self.state):
            more = max(self.n, 2 * len(self.state)) - len(self.state)
            self.state, self.value = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (self.state, self.value))
        self.state[first : self.n] = states
        if self.gains is not None:
            self.value[first : self.n] = self.gains[self.state[first : self.n] % self.buckets]
        return first

    def _firsts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of every word its number as a word, and its node as a run of one."""
        known, spelled = self.words, self.spelled
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        if fresh:
            first = self._grow([zlib.crc32(w) for w in fresh])
            for k, w in enumerate(fresh):
                known[w] = len(spelled) << 32 | first + k
                spelled.append(w)
            self.bytes += sum(map(len, fresh))
        x = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        return x >> 32, x & 0xFFFFFFFF

    def _longer(self, level: int, parents: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The nodes of runs that carry ``parents`` on by a word."""
        keys, which = np.unique(parents << 32 | last, return_inverse=True)
        known = self.children[level]
        found = np.fromiter((known.get(k, -1) for k in keys.tolist()), np.int64, len(keys))
        fresh = np.flatnonzero(found < 0)
        if len(fresh):
            spelled, made = self.spelled, keys[fresh]
            states = [zlib.crc32(b" " + spelled[w], s) for w, s in zip((made & 0xFFFFFFFF).tolist(), self.state[made >> 32].tolist())]
            first = self._grow(states)
            found[fresh] = np.arange(first, self.n)
            known.update(zip(made.tolist(), range(first, self.n)))
        return found[which]

    def walk(self, texts: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length of run: the nodes of all runs in these texts, and the text of each."""
        n = np.array([len(t) for t in texts], np.int64)
        word, node = self._firsts([w for t in texts for w in t])
        left = np.repeat(np.cumsum(n), n) - np.arange(len(word))  # words to the end of the text, this one included
        owner = np.repeat(np.arange(len(texts)), n)
        at = np.arange(len(word))
        yield node, owner
        for level in range(self.longest - 1):
            on = left[at] > level + 1
            at, node = at[on], node[on]
            node = self._longer(level, node, word[at + level + 1])
            yield node, owner[at]

    def full(self) -> bool:
        return self.n > NODES or self.bytes > BYTES

    def count(self, texts: list[list[bytes]]) -> None:
        for node, _ in self.walk(texts):
            self.value[: self.n] += np.bincount(node, minlength=self.n)
        if self.full():
            self.flush()

    def flush(self) -> None:
        np.add.at(self.totals, self.state[: self.n] % self.buckets, self.value[: self.n])
        self._clear()

    def sums(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's number of features and sum of gains."""
        n, total = np.zeros((2, len(texts)), np.int64)
        for node, owner in self.walk(texts):
            n += np.bincount(owner, minlength=len(texts))
            # sums of integers below 2**53: exact in doubles
            total += np.bincount(owner, self.value[node], len(texts)).astype(np.int64)
        if self.full():
            self._clear()
        return n, total


def split(column: pa.Array) -> Iterator[list[list[bytes]]]:
    """The words of a batch's texts, in groups of about ``TOGETHER`` words."""
    group, n = [], 0
    for text in column.to_pylist():
        group.append(words_of(text))
        n += len(group[-1])
        if n >= TOGETHER:
            yield group
            group, n = [], 0
    if group:
        yield group


def bucket_totals(texts: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """How many features of all texts each bucket has; ``buckets`` rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(buckets, longest)
        for b in batches:
            for group in split(b.column(0)):
                trie.count(group)
        trie.flush()
        used = np.flatnonzero(trie.totals)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(trie.totals[used])], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of every bucket: floor(1000 * ln) of its target share over its corpus share, one added to each count."""
    s, t = corpus.astype(float), target.astype(float)
    ratio = (t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def noise(key: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise) from a hash of the key."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _weighed(trie: Trie, texts: pa.Array) -> dict[str, np.ndarray]:
    words, parts = [], [np.zeros((2, 0), np.int64)]
    for group in split(texts):
        words += [len(t) for t in group]
        parts.append(np.stack(trie.sums(group)))
    n, total = np.concatenate(parts, 1)
    return {"n_words": np.array(words, np.int64), "n_features": n, "weight": total // np.maximum(n, 1)}


def weights(docs: DataFrame, gain: np.ndarray, longest: int, key: str = "doc_id") -> DataFrame:
    """``key``, n_words, n_features and weight of every row."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(buckets, longest, gain)
        for b in batches:
            x = _weighed(trie, b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column(key), *(pa.array(v) for v in x.values())], [key, *x])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, n_words long, n_features long, weight long")


def score(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 2, percent: int = 25, min_words: int = 20, seed: int = 7, key: str = "doc_id") -> DataFrame:
    """``key``, n_features, weight, score and rank of every row; rank is null where the row isn't drawn.

    Of the rows with at least ``min_words`` words, ``percent`` of a hundred are drawn, by falling score and then rising key."""
    gain = gains(bucket_totals(docs, buckets, longest), bucket_totals(target, buckets, longest))
    # written: dealing out by ranges looks at its rows twice, and the texts are to be scored once
    x = cut(weights(docs, gain, longest, key)).withColumn("score", F.col("weight") + noise(F.col(key), seed))
    order = [F.col("fits").desc(), F.col("score").desc(), F.col(key).asc_nulls_last(), F.col("n_features"), F.col("spread")]
    x = x.select(key, "n_features", "weight", "score", (F.col("n_words") >= min_words).alias("fits"), F.rand(seed).alias("spread"))
    dealt = cut(x.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    parts = dealt.groupBy("part").agg(F.count_if("fits").alias("n"))  # one row a partition
    every = Window.orderBy("part")
    parts = parts.select("part", F.coalesce(F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    rank = F.col("before") + F.col("own")
    drawn = F.col("fits") & (rank <= F.floor(F.col("all") * percent / 100))
    return dealt.withColumn("own", own).join(parts, "part").select(key, "n_features", "weight", "score", F.when(drawn, rank).cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 2, percent: int = 25, min_words: int = 20, seed: int = 7, key: str = "doc_id") -> DataFrame:
    """The drawn rows of ``docs``, with all columns. The last drawn row is the bar, so rows equal to it in score and key all stay."""
    scored = score(docs, target, buckets, longest, percent, min_words, seed, key)
    bar = scored.where("rank is not null").agg(F.max_by(F.struct("score", key), "rank").alias("last")).first()["last"]
    if bar is None:
        return docs.limit(0)
    gain = gains(bucket_totals(docs, buckets, longest), bucket_totals(target, buckets, longest))

    @F.pandas_udf("n_words long, weight long")
    def weighed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie = Trie(buckets, longest, gain)
        for b in batches:
            x = _weighed(trie, pa.Array.from_pandas(b, type=pa.string()))
            yield pd.DataFrame({c: x[c] for c in ("n_words", "weight")})

    x = docs.select(F.struct("*").alias("row"), weighed("text").alias("w"), noise(F.col(key), seed).alias("noise"))
    value = F.col("w.weight") + F.col("noise")
    same = F.lit(True) if bar[key] is None else F.coalesce(F.col("row").getField(key) <= F.lit(bar[key]), F.lit(False))
    return x.where((F.col("w.n_words") >= min_words) & ((value > bar["score"]) | ((value == bar["score"]) & same))).select("row.*")
