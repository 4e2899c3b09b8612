"""Quality rules: counted base rules, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word and punctuation unigrams and bigrams are compared: the
trusted target's (labelled rows of quality 1, a bounded sample of ``max_docs`` rows, the
lowest hashes of doc_id) and the raw corpus's (every document). A document's sum of log
ratios is divided by its number of n-grams; a fixed threshold decides on every document.

Defined results: null or empty text has no words and fails the base rules; a text without
n-grams has ratio 0; without trusted rows every ratio is 0, so only the base rules
decide. Labels with null doc_id or quality are ignored. Repeated rows are judged each.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
CACHE = 200_000
TOKEN = re.compile(r"\w+|[^\w\s]+")
SYMBOLS = str.maketrans("", "", "#*$%&|<>")


class _Hashes(dict):
    """Token to hash; forgets all when it holds CACHE tokens."""

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[token] = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        return h


def _buckets(text: str, hashes: _Hashes) -> np.ndarray:
    """Buckets of a text's unigrams and bigrams; unigrams have the lower half."""
    h = np.fromiter(map(hashes.__getitem__, TOKEN.findall(text)), np.int64)
    half = BUCKETS // 2
    pairs = (h[:-1] * 0x9E3779B1 + h[1:]) & 0x7FFFFFFFFFFF
    return np.concatenate([h % half, half + (pairs ^ (pairs >> 17)) % half])


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n, hashes = np.zeros(BUCKETS, np.int64), _Hashes()
    for b in batches:
        for t in b["text"]:
            n += np.bincount(_buckets(t, hashes), minlength=BUCKETS)
    yield pd.DataFrame({"bucket": np.flatnonzero(n), "n": n[n > 0]})


def _counts(texts: DataFrame) -> np.ndarray:
    """At most BUCKETS rows reach the driver."""
    x = texts.mapInPandas(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS)
    out[x["bucket"].to_numpy(int)] = x["n"]
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray, smoothing: float = 0.5) -> np.ndarray:
    """Of each bucket, log of its smoothed share in the target over that in the raw corpus; each half is one distribution."""
    out = np.zeros(BUCKETS)
    for half in (slice(0, BUCKETS // 2), slice(BUCKETS // 2, BUCKETS)):
        p, q = target[half] + smoothing, raw[half] + smoothing
        out[half] = np.log(p / p.sum()) - np.log(q / q.sum())
    return out


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 20_000) -> np.ndarray:
    trusted = (
        labels.where("doc_id is not null and quality = 1").select("doc_id").distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    target = _counts(texts.join(F.broadcast(trusted), "doc_id").select("text"))  # at most max_docs ids
    if not target.any():
        return np.zeros(BUCKETS)
    return log_ratios(target, _counts(texts.select("text")))


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines, dup = set(), 0
    for line in text.split("\n"):
        if line in lines:
            dup += 1
        elif line.strip("\x20\x09\x0a\x0b\x0c\x0d"):
            lines.add(line)
    chars = len(text) - sum(text.count(c) for c in "\x20\x09\x0a\x0b\x0c\x0d")
    grams = list(zip(words, words[1:], words[2:]))
    seen, repeat, upto = Counter(grams), 0, 0
    if len(seen) < len(grams):
        for i, g in enumerate(grams):
            if seen[g] > 1:
                repeat += i + 3 - max(i, upto)
                upto = i + 3
    return len(words), chars, len(text) - len(text.translate(SYMBOLS)), dup, repeat


def verdict_udf(ratios: np.ndarray, spark, threshold: float):
    """A pandas UDF from text to the base counts, base_failed, the ratio and kept."""
    shared = spark.sparkContext.broadcast(ratios)
    kind = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"

    @F.pandas_udf(kind)
    def verdict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes, r = _Hashes(), shared.value
        for texts in batches:
            rows = []
            for t in texts:
                t = t or ""
                n, chars, symbols, dup, repeat = base_counts(t)
                failed = n < 50 or 100 * repeat > 50 * n
                b = _buckets(t, hashes)
                llr = float(r[b].mean()) if len(b) else 0.0
                rows.append((n, chars, symbols, dup, repeat, failed, llr, not failed and llr >= threshold))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in kind.split(", ")])

    return verdict


def quality(docs: DataFrame, labels: DataFrame, threshold: float = -0.25, max_docs: int = 20_000) -> DataFrame:
    """Every document's doc_id, counts, base_failed, kept and llr."""
    v = verdict_udf(fit(docs, labels, max_docs), docs.sparkSession, threshold)
    return docs.select("doc_id", v(F.col("text")).alias("v")).select("doc_id", "v.*")


def keep(docs: DataFrame, labels: DataFrame, threshold: float = -0.25, max_docs: int = 20_000) -> DataFrame:
    """The documents that pass, with all their columns."""
    v = verdict_udf(fit(docs, labels, max_docs), docs.sparkSession, threshold)
    passed: Column = v(F.col("text"))["kept"]
    return docs.where(passed)
