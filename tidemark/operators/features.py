"""Multi-scale features of positions: binned signal around a center on both strands, logistically scaled."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import FLOOR_VALUE
from .scan import dealt

TILE = 1 << 20


def reach(windows, halves) -> int:
    return max(w * h for w, h in zip(windows, halves))


def logistic(bins: np.ndarray) -> np.ndarray:
    top = bins.max(1, keepdims=True)
    m = np.where(top == 0, 1.0, 0.05 * top)
    return 1 / (1 + np.exp(-math.log(1 / FLOOR_VALUE - 1) / m * (bins - m)))


def binned(prefix: np.ndarray, at: np.ndarray, windows, halves) -> np.ndarray:
    """Of one strand: sums of each window size left and right of the centers (which aren't counted), from prefix sums over bases."""
    out = []
    for w, h in zip(windows, halves):
        left = at[:, None] - w * h + w * np.arange(h + 1)
        right = at[:, None] + 1 + w * np.arange(h + 1)
        out.append(logistic(np.concatenate([np.diff(prefix[left], axis=1), np.diff(prefix[right], axis=1)], 1)))
    return np.concatenate(out, 1)


def with_features(positions: DataFrame, track: DataFrame, windows, halves, use: Callable[[np.ndarray], dict] | None = None, schema: str = "features array<double>", tile: int = TILE) -> DataFrame:
    """positions (chrom, start) with what ``use`` makes of their feature matrix (plus strand's features, then minus).

    Signal goes to each tile it can reach, so a tile's positions see all they need. Intervals of the same bases are summed there before
    Python sees them: memory is one tile and its margins, however large the chromosome and deep the signal, and the vectors themselves needn't be shuffled if ``use`` scores them here."""
    far = reach(windows, halves)
    p = positions.select("chrom", "start", F.floor(F.col("start") / tile).alias("tile"))
    tiles = F.sequence(F.greatest(F.floor((F.col("start") - far - 1) / tile), F.lit(0)), F.floor((F.col("end") + far) / tile))
    s = track.where("end > start").select("chrom", F.explode(tiles).alias("tile"), "start", "end", F.abs("value").cast("double").alias("value"), "strand")
    of = lambda k: F.coalesce(F.sum(F.when(F.col("strand") == k, F.col("value"))), F.lit(0.0))
    s = dealt(s, "chrom", "tile").groupBy("chrom", "tile", "start", "end").agg(of("+").alias("plus"), of("-").alias("minus"))
    use = use or (lambda x: {"features": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), x.ravel())})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        centers = left["start"].to_numpy()
        lo = (int(left["tile"][0].as_py()) * tile) - far - 1 if len(centers) else 0
        n = tile + 2 * far + 3
        signal = {k: np.zeros(n + 1) for k in "+-"}
        if right.num_rows:
            start, end, *values = (right[c].to_numpy(zero_copy_only=False) for c in ("start", "end", "plus", "minus"))
            a, b = np.clip(start - lo, 0, n), np.clip(end - lo, 0, n)
            for k, value in zip("+-", values):
                np.add.at(signal[k], a, value)
                np.add.at(signal[k], b, -value)
        prefix = [np.concatenate([[0.0], np.cumsum(np.cumsum(signal[k]))]) for k in "+-"]
        order = np.argsort(centers, kind="stable")
        parts = [np.concatenate([binned(x, centers[order[i : i + 4096]] - lo, windows, halves) for x in prefix], 1) for i in range(0, len(order), 4096)]
        x = np.concatenate(parts) if parts else np.zeros((0, 2 * sum(2 * h for h in halves)))
        return pa.table({"chrom": left["chrom"].take(order), "start": left["start"].take(order), **use(x)})

    # signal without positions in its tile makes no rows
    # toDF makes the two sides distinct where both come from one track
    p, s = p.toDF(*p.columns), s.toDF(*s.columns)
    out = p.groupBy("chrom", "tile").cogroup(s.groupBy("chrom", "tile")).applyInArrow(lambda a, b: run(a, b) if a.num_rows else _none(use, halves), f"chrom string, start bigint, {schema}")
    return out


def _none(use, halves) -> pa.Table:
    empty = use(np.zeros((0, 2 * sum(2 * h for h in halves))))
    return pa.table({"chrom": pa.array([], pa.string()), "start": pa.array([], pa.int64()), **{k: pa.array([], pa.list_(pa.float64()) if k == "features" else pa.float64()) for k in empty}})


def scored(positions: DataFrame, track: DataFrame, model, backend: str = "numpy64") -> DataFrame:
    """chrom, start, end, score: features and regressor in one pass over each tile."""
    from .models import scorer, stored

    model = stored(model, positions.sparkSession)  # tasks read it block by block; nothing of its size is broadcast

    def use(x: np.ndarray) -> dict:
        return {"score": scorer(model, backend).predict(x) if len(x) else np.zeros(0)}

    out = with_features(positions, track, model.windows, model.halves, use, "score double")
    return out.withColumn("end", F.col("start") + 1).select("chrom", "start", "end", "score")


def features_of_center(signal: Callable[[str, int, int], np.ndarray], center: int, windows, halves) -> np.ndarray:
    """One position's vector by plain sums, for tests; signal(strand, from, to) gives bases."""
    out = []
    for strand in "+-":
        for w, h in zip(windows, halves):
            sums = [np.abs(signal(strand, center - w * h + w * i, center - w * h + w * (i + 1))).sum() for i in range(h)]
            sums += [np.abs(signal(strand, center + 1 + w * i, center + 1 + w * (i + 1))).sum() for i in range(h)]
            out.append(logistic(np.array([sums]))[0])
    return np.concatenate(out)
