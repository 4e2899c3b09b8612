"""Multiple-testing correction with ranks over range partitions: no task sorts all p-values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import ranked, running_extreme

METHODS = ("fdr", "BH", "BY", "bonferroni", "holm", "hochberg", "hommel", "none")


def adjust(tests: DataFrame, method: str = "fdr", p: str = "p") -> DataFrame:
    """``tests`` with adj_p. A null or NaN p is no test: it doesn't count and its adj_p is null."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {', '.join(METHODS)}")
    real = tests.where(F.col(p).isNotNull() & ~F.isnan(p))
    none = tests.where(F.col(p).isNull() | F.isnan(p)).withColumn("adj_p", F.lit(None).cast("double"))
    if method == "none":
        done = real.withColumn("adj_p", F.col(p))
    elif method == "bonferroni":
        done = real.withColumn("adj_p", F.least(F.col(p) * real.agg(F.count("*")).scalar(), F.lit(1.0)))
    elif method == "hommel":
        done = _hommel(real, p)
    else:
        x = ranked(real, F.col(p))
        m, r = F.col("m"), F.col("rank")
        value: Column = F.col(p) * m / r
        if method == "BY":
            harmonic = x.agg(F.sum(1.0 / F.col("rank"))).scalar()
            value = value * harmonic
        elif method in ("holm", "hochberg"):
            value = F.col(p) * (m - r + 1)
        x = running_extreme(x.withColumn("__v", value), "__v", "__adj", method != "holm")
        done = x.withColumn("adj_p", F.least("__adj", F.lit(1.0))).drop("__v", "__adj", "rank", "m", "part")
    return done.unionByName(none)


def _envelope(slope: np.ndarray, intercept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of some lines that are the highest somewhere right of 0, by rising slope."""
    order = np.lexsort((intercept, slope))
    a, b = slope[order], intercept[order]
    last = np.append(a[1:] != a[:-1], True)
    keep: list[tuple[float, float]] = []
    for m, c in zip(a[last].tolist(), b[last].tolist()):
        while len(keep) > 1 and (keep[-2][1] - c) * (keep[-1][0] - keep[-2][0]) <= (keep[-2][1] - keep[-1][1]) * (m - keep[-2][0]):
            keep.pop()
        keep.append((m, c))
    return np.array([k[0] for k in keep]), np.array([k[1] for k in keep])


def _hommel(real: DataFrame, p: str) -> DataFrame:
    """Closed testing with Simes' test: adj_p of p is the greatest over s of min(s * p, q(s)), q(s) being Simes' p-value of the s largest.

    s / q(s) is the greatest over ranks k of (s - (m - k)) / p_k: the upper envelope of one line a p-value. Partitions send the driver
    only the lines of their own envelope. q falls with s while s * p rises, so each p finds its s by bisection."""
    x = ranked(real, F.col(p)).withColumnRenamed(p, "__p")
    first = x.select("m").first()
    if first is None:
        return real.withColumn("adj_p", F.lit(None).cast("double"))
    m = first["m"]
    zeros = x.where(F.col("__p") == 0).count()

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = np.zeros(0), np.zeros(0)
        for x in batches:
            v, rest = x["__p"].to_numpy(float), (x["m"] - x["rank"]).to_numpy(float)
            a, b = _envelope(np.append(a, 1 / v), np.append(b, -rest / v))
        yield pd.DataFrame({"a": a, "b": b})

    lines = x.where(F.col("__p") > 0).select("__p", "rank", "m").mapInPandas(edges, "a double, b double").toPandas()
    if lines.empty:
        return x.withColumn("adj_p", F.lit(0.0)).select(*[F.col("__p").alias(c) if c == p else F.col(c) for c in real.columns], "adj_p")
    a, b = _envelope(lines["a"].to_numpy(), lines["b"].to_numpy())
    turns = (b[:-1] - b[1:]) / (a[1:] - a[:-1]) if len(a) > 1 else np.zeros(0)
    most = m - zeros  # beyond, the s largest hold a zero and q is 0

    @F.pandas_udf("double")
    def adjusted(v: pd.Series) -> pd.Series:
        v = v.to_numpy(float)

        def q(s: np.ndarray) -> np.ndarray:
            k = np.searchsorted(turns, s, "left")
            with np.errstate(divide="ignore", invalid="ignore"):
                return np.where(s <= most, s / (a[k] * s + b[k]), 0.0)

        low, high = np.zeros(len(v)), np.full(len(v), float(most))  # low: s * p <= q(s) still holds
        while (low < high).any():
            mid = np.ceil((low + high) / 2)
            holds = mid * v <= q(mid)
            low, high = np.where(holds, mid, low), np.where(holds, high, mid - 1)
        return pd.Series(np.minimum(1.0, np.maximum(low * v, np.where(low < m, q(low + 1), 0.0))))

    return x.withColumn("adj_p", F.when(F.col("__p") == 0, F.lit(0.0)).otherwise(adjusted("__p"))).select(*[F.col("__p").alias(c) if c == p else F.col(c) for c in real.columns], "adj_p")


def significant(peaks: DataFrame, method: str = "fdr", threshold: float = 0.05) -> DataFrame:
    """Peaks (chrom, start, end, score, prob, ...) whose adjusted prob is at most ``threshold``; prob -1 marks a peak too narrow to test."""
    return adjust(peaks.where("prob <> -1"), method, "prob").where(F.col("adj_p") <= threshold)
