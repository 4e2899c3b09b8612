"""Toxicity by class-conditional Kneser-Ney models of words' spelling.

Two models spell every different word of a text out, symbol by symbol to its end, each symbol given up to
``ORDER`` - 1 before it in the word: one model has the counts of toxic labelled texts, one those of ordinary
ones. Each discounts its class's counts and hands the mass that frees to a backoff that both share:
the counts of both classes together, in turn discounted towards Kneser-Ney's continuation counts (of how
many different symbols stand before a run), down to single symbols. An expression (a run of symbols) whose
share of documents in its context doesn't differ beyond chance, and that leads to none whose does, is
rare as evidence: all of its mass is the backoff's, so it has the ratio of what came before it.

A word's log-likelihood ratio is the sum over its symbols. A text's is the sum over its different words,
counted from the median word, so that its language or subject as a whole decides nothing; it is normalised by
the number of words and by its root, and calibrated to a score by logistic regression on labelled rows
that the calibrated models haven't seen.

The models are fitted on a bounded sample of labelled rows (``max_docs`` of each class, the lowest hashes
of doc_id), which bounds what the driver gets and sends; of rows of one class whose least four-word hash is
the same, near copies as a rule, one counts. Every text is scored whole.

Symbols are lower-cased letters; those beyond Latin scripts share 126 codes by hash.

Defined results: null or empty text scores as a text of no words; labels with null doc_id or toxic are
ignored, of several labels for one doc_id the largest counts; without labels of both classes every score
is 0. Repeated rows are scored each; ids of any type come back as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, drop

BITS, ORDER = 9, 7
EDGE, WIDE = 1, 386
SLICE = 500_000
#: Runs that fewer documents of the sample hold aren't counted.
FEWEST = 2
#: Likelihood-ratio statistic of a run in its context below which the classes' counts differ by chance (p of about 0.001).
CHANCE = 11.0
#: Ratios nearer to the text's median word than this say nothing (a factor of about 1.6).
EVEN = 0.5
#: Likelihood-ratio statistic of a run in its context below which the classes' counts differ by chance (p of about 0.001).
CHANCE = 11.0
#: Ratios nearer to the text's median word than this say nothing (a factor of about 1.6).
EVEN = 0.5


def _alphabet() -> np.ndarray:
    """Code point (65,535 stands for all above) to symbol: 0 is none, EDGE is white space, then the Latin blocks one by one, others by hash."""
    cp = np.arange(65536, dtype=np.int64)
    t = WIDE + (cp * 40503 >> 4) % ((1 << BITS) - WIDE)
    t[:384] = np.arange(384) + 2
    t[[*range(9, 14), *range(28, 33), 133, 160]] = EDGE
    return t


ALPHABET = _alphabet()


def words_of(text: str) -> list[str]:
    """The different words of a text, in a fixed order."""
    return sorted(set(text.lower().split()))


def runs(words: list[str]) -> np.ndarray:
    """Of every symbol of every word, its end included, the run of up to ORDER symbols that it ends.

    A run is a number whose digits are its symbols, the last one lowest; a run that reaches its word's start begins with EDGE."""
    cp = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    sym = ALPHABET[np.minimum(cp, 65535)]
    at = np.arange(len(sym))
    last = np.maximum.accumulate(np.where(sym == EDGE, at, 0))
    place = at - np.concatenate([[0], last[:-1]])  # from 1 in each word; the edge before is 0
    run = np.zeros(len(sym), np.int64)
    for k in range(ORDER):
        run[k:] |= np.where(place[k:] >= k, sym[: max(len(sym) - k, 0)] << (BITS * k), 0)
    return run[1:] if words else run[:0]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(fold, toxic, text) to this task's (fold, toxic, run, n, docs): how often its documents' words have the run, and how many documents; run -1 counts all."""
    held: dict[tuple[int, int], list[tuple[np.ndarray, ...]]] = {}
    for b in batches:
        for (fold, toxic), g in b.groupby(["fold", "toxic"]):
            found = held.setdefault((fold, toxic), [])
            for text in g["text"]:
                own, n = np.unique(runs(words_of(text)), return_counts=True)
                found.append((np.append(own, -1), np.append(n, 0), np.ones(len(own) + 1, np.int64)))
            found[:] = [_summed(found)]
    for (fold, toxic), found in held.items():
        run, n, docs = found[0]
        yield pd.DataFrame({"fold": fold, "toxic": toxic, "run": run, "n": n, "docs": docs})


def _summed(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    run, at = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
    return run, *(np.bincount(at, np.concatenate([x[k] for x in found])).astype(np.int64) for k in (1, 2))


def _length(run: np.ndarray) -> np.ndarray:
    """Symbols of each run."""
    return sum((run >> (BITS * k) > 0).astype(np.int64) for k in range(ORDER))


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, at = np.unique(keys, return_inverse=True)
    return unique, at


def discount(n: np.ndarray) -> float:
    """Kneser and Ney's estimate of the absolute discount, from how many counts are 1 and 2."""
    once, twice = (n == 1).sum(), (n == 2).sum()
    return float(once / (once + 2 * twice)) if once else 0.5


def _mask(symbols: int) -> np.int64:
    return np.int64((1 << (BITS * symbols)) - 1)


def continuation(run: np.ndarray) -> np.ndarray:
    """The shared backoff: of each run, the probability of its last symbol after the others without the first.

    Level by level from single symbols up: a run of k symbols counts the different symbols seen before it."""
    length, out = _length(run), np.zeros(len(run))
    level = np.unique(run & _mask(1))
    base = np.full(len(level), 1 / (len(level) + 1))
    for k in range(1, ORDER):
        longer = np.unique(run[length > k] & _mask(k + 1))
        n = np.bincount(np.searchsorted(level, longer & _mask(k)), minlength=len(level))
        d = discount(n)
        context, at = _groups(level >> BITS)
        total, kinds = np.bincount(at, n)[at], np.bincount(at, n > 0)[at]
        p = np.where(total > 0, (np.maximum(n - d, 0) + d * kinds * base) / np.maximum(total, 1), base)
        here = length == k + 1
        out[here] = p[np.searchsorted(level, run[here] & _mask(k))]
        base, level = p[np.searchsorted(level, longer & _mask(k))], longer
    return out


def _g2(k: np.ndarray, n: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Of k out of n, the part of the likelihood-ratio statistic against a common share."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * (np.where(k > 0, k * np.log(k / (n * share)), 0) + np.where(k < n, (n - k) * np.log((n - k) / (n * (1 - share))), 0))


def _g2(k: np.ndarray, n: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Of k out of n, the part of the likelihood-ratio statistic against a common share."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * (np.where(k > 0, k * np.log(k / (n * share)), 0) + np.where(k < n, (n - k) * np.log((n - k) / (n * (1 - share))), 0))


def kneser_ney(run: np.ndarray, counts: list[np.ndarray], docs: list[np.ndarray], chance: float = CHANCE) -> dict[str, tuple]:
    """Log-likelihood ratios of runs, and of what a context gives to runs it hasn't.

    ``counts``, and ``docs`` for how many documents hold them: of the toxic, then the ordinary class."""
    context, at = _groups(run >> BITS)
    summed = lambda n: np.bincount(at, n, len(context))

    def mixed(n: np.ndarray, cut: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = summed(n)
        free = np.where(total > 0, summed(cut) / np.maximum(total, 1), 1.0)
        return (n - cut) / np.maximum(total, 1)[at] + free[at] * low, free

    pool = counts[0] + counts[1]
    shared = mixed(pool, np.minimum(pool, discount(pool)), continuation(run))[0]
    totals = [summed(n)[at] for n in docs]
    share = (docs[0] + docs[1]) / (totals[0] + totals[1])
    sure = sum(_g2(n, total, share) for n, total in zip(docs, totals)) >= chance
    way = run[sure]
    for _ in range(ORDER - 2):  # what leads to such a run is spelled by class, too
        way = way >> BITS
        sure |= np.isin(run, way)
    (toxic, free_toxic), (ordinary, free_ordinary) = (mixed(n, np.where(sure, np.minimum(n, discount(n)), n), shared) for n in counts)
    value, rest = np.log(toxic / ordinary), np.log(np.maximum(free_toxic, 1e-6) / np.maximum(free_ordinary, 1e-6))
    far = np.abs(value - rest[at]) > 1e-9
    return {"runs": (run[far], value[far]), "contexts": (context[rest != 0], rest[rest != 0])}


def _models(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All counts of the sample, which is bounded, to the trial (0) and the final (1) model's entries (model, part, key, value)."""
    x = pd.concat(list(batches)).sort_values("run")
    for model, late in ((0, (0,)), (1, (0, 1))):
        n, docs = ([sum(x[f"{of}{c}{k}"].to_numpy() for k in late) for c in (1, 0)] for of in ("n", "docs"))
        if not (len(x) and docs[0][0] and docs[1][0]):  # the first row counts documents
            continue
        some = (docs[0] + docs[1] >= FEWEST) & (x["run"].to_numpy() >= 0)
        for part, (key, value) in kneser_ney(x["run"].to_numpy()[some], [k[some] for k in n], [k[some] for k in docs]).items():
            yield pd.DataFrame({"model": model, "part": part, "key": key, "value": value})


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def _packed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An open hash table, at most a quarter full: keys, and values of one number more for what isn't there."""
    bits = max(4, int(4 * len(keys)).bit_length())
    held, out = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float32)
    left, at = np.arange(len(keys)), _slot(keys, bits)
    while len(left):
        free = held[at] < 0
        held[at[free]] = keys[left[free]]
        put = held[at] == keys[left]
        out[at[put]] = values[left[put]]
        left, at = left[~put], (at[~put] + 1) & ((1 << bits) - 1)
    return held, out


def look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key's value, and whether the table has it."""
    held, values = table
    at = _slot(keys, len(held).bit_length() - 1)
    out, known = np.zeros(len(keys)), np.zeros(len(keys), bool)
    left = np.arange(len(keys))
    while len(left):
        there = held[at]
        hit = there == keys[left]
        out[left[hit]], known[left[hit]] = values[at[hit]], True
        on = ~hit & (there >= 0)
        left, at = left[on], (at[on] + 1) & (len(held) - 1)
    return out, known


def _ratios(words: list[str], model: dict) -> np.ndarray:
    """Log-likelihood ratios of words."""
    run = runs(words)
    value, known = look_up(model["runs"], run)
    value[~known] = look_up(model["contexts"], run[~known] >> BITS)[0]
    return np.diff(np.cumsum(value)[run & _mask(1) == EDGE], prepend=0.0)


def measure(texts: list[str], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the sum of its words' ratios beyond their median, and the number of its words."""
    llr, count = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words, size = words_of(text), 0
        if not words:
            continue
        cuts = [0]
        for k, w in enumerate(words):  # a very long text goes part by part
            size += len(w)
            if size >= SLICE:
                cuts.append(k + 1)
                size = 0
        value = np.concatenate([_ratios(words[a:b], model) for a, b in zip(cuts, [*cuts[1:], len(words)]) if a < b])
        value -= np.median(value)
        llr[i], count[i] = value[np.abs(value) >= EVEN].sum(), len(words)
    return llr, count


def _features(llr: np.ndarray, words: np.ndarray) -> np.ndarray:
    n = np.maximum(words, 1)
    return np.column_stack([np.ones(len(n)), 10 * llr / n, llr / np.sqrt(n)])


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method."""
    b, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [1e-2] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(b)), x.T @ (w * (y - p)) - ridge @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def training_rows(docs: DataFrame, labels: DataFrame, folds, held_out: int, max_docs: int) -> tuple[DataFrame, dict[int, float]]:
    """(fold, toxic, text) of the sample, and what each of its rows of a class stands for."""
    known = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .withColumn("fold", F.crc32(F.col("doc_id").cast("string")) % folds).where(F.col("fold") != held_out)
    )
    have = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    part = lambda c: known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    # at most 2 * max_docs rows of three numbers, so the broadcast has a fixed bound
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(part(0).union(part(1))), "doc_id")
    words = F.split(F.lower("text"), SPACE)
    grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - 4, F.lit(0))), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(4)]))
    rows = rows.withColumn("words", words).withColumn("group", F.array_min(grams))
    rows = rows.groupBy("toxic", "group").agg(F.min_by(F.struct("fold", "text"), F.struct("doc_id", F.xxhash64("text"))).alias("r")).select("r.fold", "toxic", "r.text")
    return rows, {c: n / min(n, max_docs) for c, n in have.items()}


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, max_docs: int = 20_000) -> dict | None:
    """Fit on labelled rows outside fold ``held_out``; the last other fold calibrates models fitted on the rest, then all of them make the final models."""
    rows, stands = training_rows(docs, labels, folds, held_out, max_docs)
    if len(stands) < 2:
        return None
    rows = cut(rows)
    last = max(f for f in range(folds) if f != held_out)
    summed = lambda of, c, late: F.sum(F.when((F.col("toxic") == c) & (F.col("fold") == last if late else F.col("fold") != last), F.col(of)).otherwise(0))
    columns = [summed(of, c, late).cast("int").alias(f"{of}{c}{int(late)}") for of in ("n", "docs") for c in (1, 0) for late in (False, True)]
    wide = rows.mapInPandas(_count, "fold long, toxic int, run long, n long, docs long").groupBy("run").agg(*columns)
    # one task fits: runs of the sample's documents, so bounded with it; the driver gets the entries where the classes differ
    entries = wide.where(f"run = -1 or docs00 + docs01 + docs10 + docs11 >= {FEWEST}").coalesce(1).mapInPandas(_models, "model int, part string, key long, value double").toPandas()

    def model(which: int) -> dict:
        own = entries[entries["model"] == which]
        return {p: _packed(own["key"][own["part"] == p].to_numpy(np.int64), own["value"][own["part"] == p].to_numpy(float)) for p in ("runs", "contexts")}

    trial = docs.sparkSession.sparkContext.broadcast(model(0))

    def features(batches):
        for b in batches:
            llr, words = measure(b["text"].tolist(), trial.value)
            yield pd.DataFrame({"toxic": b["toxic"], "llr": llr, "words": words})

    seen = rows.where(F.col("fold") == last).mapInPandas(features, "toxic int, llr double, words long").toPandas()
    drop(rows)
    y = seen["toxic"].to_numpy(float)
    if 0 < y.sum() < len(y):
        w = np.where(y == 1, stands[1], stands[0])
        weights = _logistic(_features(seen["llr"].to_numpy(), seen["words"].to_numpy()), y, w)
    else:  # too few labels to calibrate
        weights = np.array([-2.0, 1.0, 0.5])
    return {"model": model(1), "weights": weights}


def score(docs: DataFrame, model: dict | None, threshold: float = 0.3) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, score, predicted and the length-normalised ratio behind them."""
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0.0).alias("llr_per_word"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            llr, words = measure(b["text"].to_pylist(), m["model"])
            s = 1 / (1 + np.exp(-np.clip(_features(llr, words) @ m["weights"], -30, 30)))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(llr / np.maximum(words, 1))], ["doc_id", "score", "predicted", "llr_per_word"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int, llr_per_word double")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, max_docs: int = 20_000, threshold: float = 0.3) -> DataFrame:
    return score(docs, fit(docs, labels, folds, held_out, max_docs), threshold)
