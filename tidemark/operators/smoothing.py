"""Smoothing and extrema of ordered profiles as window frames; ``key`` names one profile (a peak), ``at`` its order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def half_even(x: float) -> int:
    return round(x)


def boxcar(df: DataFrame, key: str, at: str, value: str, out: str, width: int, progressive_ends: bool = False) -> DataFrame:
    """Moving mean of ``width`` rows. Rows too near the ends are 0, or with ``progressive_ends`` means of what there is around them."""
    half = half_even(width / 2)
    by = Window.partitionBy(key).orderBy(at)
    every = Window.partitionBy(key)
    x = df.withColumn("__i", F.row_number().over(by)).withColumn("__n", F.count("*").over(every))
    mean = F.sum(value).over(by.rowsBetween(-(half - 1), width - half)) / width
    inside = (F.col("__i") >= half) & (F.col("__i") <= F.col("__n") - (width - half))
    x = x.withColumn(out, F.when(inside, mean).otherwise(0.0))
    if progressive_ends:
        # a row whose k-th neighbour is the profile's end takes the mean of k rows on either side; the end itself that of two rows
        around = lambda lo, hi: F.sum(value).over(by.rowsBetween(lo, hi)) / (hi - lo + 1)
        ends, i, n = (width + 1) // 2 - 1, F.col("__i"), F.col("__n")
        first, last = F.when(i == 1, around(0, 1)), F.when(i == n, around(-1, 0))
        for k in range(1, ends):
            first, last = first.when(i - 1 == k, around(-k, k)), last.when(n - i == k, around(-k, k))
        x = x.withColumn(out, F.when(i <= ends, first).when(n - i < ends, last).otherwise(F.col(out)))
    return x.drop("__i", "__n")


def smooth(df: DataFrame, key: str, at: str, value: str, out: str, width: int, kind: int = 2) -> DataFrame:
    """``kind`` passes of boxcar (1 rectangular, 2 triangular, 3 and 4 nearly Gaussian); 5: widths of 1.6, 1.4, 1.2 and 1 times ``width``."""
    widths = [half_even(width * f) for f in (1.6, 1.4, 1.2, 1.0)] if kind == 5 else [width] * kind
    x, source = df, value
    for i, w in enumerate(widths):
        x = boxcar(x, key, at, source, f"__pass{i}", w)
        source = f"__pass{i}"
    x = x.withColumn(out, F.col(source))
    return x.drop(*[f"__pass{i}" for i in range(len(widths))])


def segmented(df: DataFrame, key: str, at: str, value: str, out: str, widths: list[int], kind: int = 1) -> DataFrame:
    """The profile in ``len(widths)`` segments of equal length (rounded half to even), each taken from the whole profile smoothed at its width.

    Rows beyond the last segment, and a segment that would run over the end, are 0."""
    x = df
    for i, w in enumerate(widths):
        x = smooth(x, key, at, value, f"__width{i}", w, kind)
    each, n = len(widths), F.count("*").over(Window.partitionBy(key))
    length = F.bround(n / each, 0).cast("bigint")
    x = x.withColumn("__length", length).withColumn("__rows", n).withColumn("__i", F.row_number().over(Window.partitionBy(key).orderBy(at)) - 1)
    segment = F.floor(F.col("__i") / F.greatest(F.col("__length"), F.lit(1)))
    whole = (segment < each) & ((segment + 1) * F.col("__length") <= F.col("__rows")) & (F.col("__length") > 0)
    picked = F.get(F.array(*[f"__width{i}" for i in range(each)]), segment.cast("int"))
    return x.withColumn(out, F.when(whole, picked).otherwise(0.0)).drop("__i", "__length", "__rows", *[f"__width{i}" for i in range(each)])


def derivative(df: DataFrame, key: str, at: str, value: str, out: str) -> DataFrame:
    """Half the difference of the neighbours; at the ends the difference to the one neighbour."""
    by = Window.partitionBy(key).orderBy(at)
    v, before, after = F.col(value), F.lag(value).over(by), F.lead(value).over(by)
    return df.withColumn(out, F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2))


def local_maxima(df: DataFrame, key: str, at: str, value: str, slope: str, floor: float) -> DataFrame:
    """Rows where the slope turns from up to down and the value exceeds ``floor``."""
    before = F.lag(slope).over(Window.partitionBy(key).orderBy(at))
    return df.withColumn("__before", before).where((F.col(slope) < 0) & (F.col("__before") > 0) & (F.col(value) > floor)).drop("__before")


def top_by_value(df: DataFrame, key: str, at: str, value: str, k: int = 5) -> DataFrame:
    """The ``k`` largest rows of each profile, the earlier of equals first."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(value).desc(), at))
    return df.withColumn("__r", rank).where(F.col("__r") <= k).drop("__r")


def valley(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """key, at and value of the least row of each profile, the first of equals."""
    return df.groupBy(key).agg(F.min(F.struct(value, at)).alias("m")).select(key, F.col(f"m.{at}").alias(at), F.col(f"m.{value}").alias(value))


def centroid(df: DataFrame, key: str, index: str, value: str) -> DataFrame:
    """key, centroid: the value-weighted mean index, rounded half to even."""
    return df.groupBy(key).agg(F.bround(F.sum(F.col(value) * F.col(index)) / F.sum(value), 0).cast("bigint").alias("centroid"))
