"""Peak calling: broad peaks are smoothed, cut at valleys the forest splits at, and each summit gets a p-value.

Membership, smoothing, slopes, maxima and valleys are joins and window frames over (peak, position). What depends on its own
outcome, merging and splitting neighbouring valleys until nothing changes, is one small function over a peak's arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import kept
from .fdr import significant
from .intervals import overlap_join
from .models import Forest
from .mvlaplace import TAIL, laplace_boxes
from .noise import covariance
from .smoothing import derivative, local_maxima, smooth

# Fixed values of the method.
WIDE, RATIO, NARROW, TRIM, CUT = 300, 2, 5, 10, 0.5
OFFSETS = [(-4, -2, 0, 2, 4), (-2, 0, 2, 4, 6), (-6, -4, -2, 0, 2), (-8, -6, -4, -2, 0), (0, 2, 4, 6, 8)]
SUMMIT = "start bigint, stop bigint, score double, smooth_mode bigint, original_mode bigint, centroid bigint, five array<double>"


class Counters:
    """What a run of peak calling did: p-values worked out and normal boxes integrated for them, added up over all tasks.

    A task that is run again counts again, so the sums are exact only where no task was lost."""

    def __init__(self, spark: SparkSession):
        self._tests, self._boxes = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def add(self, tests: int, boxes: int) -> None:
        self._tests += tests
        self._boxes += boxes

    @property
    def tests(self) -> int:
        return self._tests.value

    @property
    def boxes(self) -> int:
        return self._boxes.value


def valley_features(x: np.ndarray, y: np.ndarray, gaps: list[tuple[int, int, int]]) -> np.ndarray:
    """Of valleys (left maximum, right maximum, lowest point): widths, heights and depths."""
    left, right, low = np.array(gaps).T
    a, b, v = y[left], y[right], y[low]
    d1, d2 = np.abs(a - b), np.minimum(a, b) - v
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.column_stack([x[right] - x[left], x[low] - x[left], x[right] - x[low], a, b, np.maximum(a, b), d1, d2, v, d2 / (d1 + v)]).astype(float)


def split_points(x: np.ndarray, y: np.ndarray, maxima: np.ndarray, forest: Forest) -> list[int]:
    """Valleys that stay splits once neighbouring merges have been joined, each join judged anew."""
    gaps = [(a, b, a + int(np.argmin(y[a : b + 1]))) for a, b in zip(maxima[:-1], maxima[1:])]
    split: list[bool | None] = [None] * len(gaps)
    while None in split:
        asked = [i for i, s in enumerate(split) if s is None]
        for i, p in zip(asked, forest.predict(valley_features(x, y, [gaps[i] for i in asked]))):
            split[i] = bool(p > CUT)
        pair = next((i for i in range(len(split) - 1) if split[i] is False and split[i + 1] is False), None)
        if pair is None:
            break
        (a, _, low), (_, b, other) = gaps[pair : pair + 2]
        gaps[pair : pair + 2] = [(a, b, other if y[other] <= y[low] else low)]
        split[pair : pair + 2] = [None]
    return [g[2] for g, s in zip(gaps, split) if s]


def sample(y: np.ndarray, left: int, right: int, peak: int) -> np.ndarray:
    """Five points around a summit: the highest five of a narrow region, else the first pattern of steps of 2 that fits."""
    if right - left < 9:
        top = np.argsort(-y[left : right + 1], kind="stable")[:5]
        return left + np.sort(top)
    return next(peak + np.array(o) for o in OFFSETS if peak + o[0] >= left and peak + o[-1] <= right)


def summits(x: np.ndarray, y: np.ndarray, raw: np.ndarray, maxima: np.ndarray, forest: Forest, floor: float) -> list[tuple]:
    """The summits of one peak (positions x, smoothed and raw scores, indexes of the smoothed maxima), each ended by the five
    scores that its p-value is of, or None where it is too narrow for one."""
    edges = [0, *split_points(x, y, maxima, forest), len(x) - 1]
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        above = a + np.flatnonzero(y[a : b + 1] > floor)
        if not len(above):
            continue
        left, right = int(above[0]), int(above[-1])
        peak = left + int(np.argmax(y[left : right + 1]))
        score = float(raw[left : right + 1].max())
        if right - left < NARROW:
            out.append((int(x[left]), int(x[right]), score, int(x[peak]), 0, 0, None))
            continue
        before, after = x[peak] - x[left], x[right] - x[peak]
        if before > RATIO * after and after > WIDE:
            before = RATIO * after
        if RATIO * before < after and before > WIDE:
            after = RATIO * before
        heights = y[left : right + 1]
        center = (heights * np.arange(1, len(heights) + 1)).sum() / heights.sum()
        centroid = round(float(center / (right - left) * (x[right] - x[left]))) + x[left]
        mode = int(x[left + int(np.argmax(raw[left : right + 1]))])
        out.append((int(x[peak] - before + TRIM), int(x[peak] + after - TRIM), score, int(x[peak]), mode, int(centroid), y[sample(y, left, right, peak)]))
    return out


def profiles(dense: DataFrame, broad: DataFrame, floor: Column | float, width: int = 4, kind: int = 2) -> DataFrame:
    """Every candidate peak's arrays: x, y (smoothed), raw, and the indexes of its maxima."""
    spans = broad.where(F.col("max") >= floor).select("chrom", F.col("start").alias("span_start"), F.col("end").alias("span_end"))
    x = overlap_join(dense.select("chrom", "start", "score"), spans).withColumn("peak", F.struct("chrom", "span_start"))
    size = x.groupBy("peak").agg(F.count("*").alias("n"), F.max("score").alias("top")).where((F.col("n") > 3) & (F.col("top") > floor))
    x = kept(x.join(size.select("peak", "n"), "peak").select("peak", "start", "score", "n"))

    def shaped(rows: DataFrame, w: int) -> DataFrame:
        rows = derivative(smooth(rows, "peak", "start", "score", "y", w, kind), "peak", "start", "y", "slope")
        return smooth(rows, "peak", "start", "slope", "turn", w, kind) if width > 1 else rows.withColumn("turn", F.col("slope"))

    x = kept(shaped(x.where(F.col("n") > width), width).unionByName(shaped(x.where(F.col("n") <= width), 3)))
    top = local_maxima(x, "peak", "start", "y", "turn", floor).select("peak", F.col("start").alias("at"))
    maxima = top.groupBy("peak").agg(F.array_sort(F.collect_list("at")).alias("maxima"))
    rows = x.groupBy("peak").agg(F.array_sort(F.collect_list(F.struct("start", "y", "score"))).alias("p"))
    return rows.join(maxima, "peak").select("peak.chrom", F.col("peak.span_start").alias("peak"), F.col("p.start").alias("x"), F.col("p.y").alias("y"), F.col("p.score").alias("raw"), "maxima")


def covariance_matrix(dense: DataFrame, order: int = 5) -> np.ndarray:
    """The covariance as one small array on the driver."""
    out = np.zeros((order, order))
    for r in covariance(dense, order=order).collect():
        out[r["i"], r["j"]] = r["cov"]
    return out


def found_summits(dense: DataFrame, broad: DataFrame, floor: float, forest: Forest, width: int = 4, kind: int = 2) -> DataFrame:
    """chrom, start, end, score, smooth_mode, original_mode, centroid of every summit, and ``five``: the scores that its p-value is of, null where it is too narrow to test."""
    shared = dense.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf(f"array<struct<{SUMMIT.replace(' ', ':')}>>".replace(",:", ","))
    def find(x: pd.Series, y: pd.Series, raw: pd.Series, maxima: pd.Series) -> pd.Series:
        names = [c.split()[0] for c in SUMMIT.split(", ")]
        out = [[dict(zip(names, s)) for s in summits(a, b, c, np.searchsorted(a, m), shared.value, floor)] for a, b, c, m in zip(x, y, raw, maxima)]
        return pd.Series(out, dtype=object)

    x = profiles(dense, broad, floor, width, kind).select("chrom", F.explode(find("x", "y", "raw", "maxima")).alias("s"))
    return x.select("chrom", F.col("s.start"), F.col("s.stop").alias("end"), "s.score", "s.smooth_mode", "s.original_mode", "s.centroid", "s.five")


def raw_peaks(dense: DataFrame, broad: DataFrame, floor: float, forest: Forest, cov: np.ndarray, width: int = 4, kind: int = 2, tail: float = TAIL, counters: Counters | None = None) -> DataFrame:
    """chrom, start, end, score, prob, smooth_mode, original_mode, centroid of every summit; prob -1 where it is too narrow to test.

    Summits are dealt out by number for their p-values (few bytes, but much work a row); those of an Arrow batch are worked out
    together, exact but for mixing values of mass ``tail``."""

    @F.pandas_udf("double")
    def p(fives: pd.Series) -> pd.Series:
        out, tested = np.full(len(fives), -1.0), np.flatnonzero(fives.notna().to_numpy())
        if len(tested):
            inside, _, boxes = laplace_boxes(np.stack(fives.to_numpy()[tested]), cov, tail)
            out[tested] = 1 - inside
            if counters is not None:
                counters.add(len(tested), boxes)
        return pd.Series(out)

    found = kept(found_summits(dense, broad, floor, forest, width, kind))
    tasks = 4 * dense.sparkSession.sparkContext.defaultParallelism
    return found.repartition(tasks).select("chrom", "start", "end", "score", p("five").alias("prob"), "smooth_mode", "original_mode", "centroid")


def call_peaks(dense: DataFrame, broad: DataFrame, floor: float, forest: Forest, width: int = 4, kind: int = 2, method: str = "fdr", threshold: float = 0.05, cov: np.ndarray | None = None, tail: float = TAIL, counters: Counters | None = None) -> tuple[DataFrame, DataFrame]:
    """All summits, and the significant ones as chrom, start, end, score, prob, center."""
    cov = covariance_matrix(dense) if cov is None else cov
    raw = kept(raw_peaks(dense, broad, floor, forest, cov, width, kind, tail, counters))
    found = significant(raw, method, threshold)
    return raw, found.select("chrom", "start", "end", "score", F.col("adj_p").alias("prob"), F.col("original_mode").alias("center"))
