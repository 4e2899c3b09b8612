"""Comparing result sets: paired scores, histograms, five-number summaries, ratios of timings."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import grouped_quantiles, ranked_values


def paired_scores(a: DataFrame, b: DataFrame) -> DataFrame:
    """chrom, start, a, b where both tracks have a finite score."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    x = a.select("chrom", "start", F.col("score").alias("a")).join(b.select("chrom", "start", F.col("score").alias("b")), ["chrom", "start"])
    return x.where(finite("a") & finite("b"))


def agreement(pairs: DataFrame) -> DataFrame:
    """One row: n, max_diff, median_diff, r."""
    d = F.abs(F.col("a") - F.col("b"))
    median = ranked_values(pairs.select(d.alias("d")), "d", 0.5)[0]
    return pairs.agg(F.count("*").alias("n"), F.max(d).alias("max_diff"), F.lit(median).cast("double").alias("median_diff"), F.corr("a", "b").alias("r"))


def histogram2d(pairs: DataFrame, width: float) -> DataFrame:
    return pairs.groupBy(F.floor(F.col("a") / width).alias("x"), F.floor(F.col("b") / width).alias("y")).agg(F.count("*").alias("n"))


def five_numbers(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Quartiles, the outermost values within 1.5 quartile ranges of them, and how many lie beyond."""
    q, x = grouped_quantiles(df, value, list(keys), [0.25, 0.5, 0.75])
    q = q.select(*keys, *[F.col("q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))])
    # a key's rows meet its quantiles by range partition, so that a key with many rows isn't one task's
    same = lambda a, b: reduce(and_, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys], F.lit(True))
    parts = x.select("part", *keys).distinct()
    dealt = parts.alias("p").join(q.alias("q"), same("p", "q")).select("p.part", "q.*") if keys else parts.join(F.broadcast(q))
    x = x.alias("x").join(dealt.alias("d"), (F.col("x.part") == F.col("d.part")) & same("x", "d")).select(F.col(f"x.{value}").alias("__v"), *[f"d.{c}" for c in q.columns])
    step = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("__v") >= F.col("q1") - step) & (F.col("__v") <= F.col("q3") + step)
    found = x.groupBy(*q.columns).agg(F.min(F.when(inside, F.col("__v"))).alias("low"), F.max(F.when(inside, F.col("__v"))).alias("high"), F.count_if(~inside).alias("outliers"))
    none = q.where("median is null").select(*q.columns, *[F.lit(None).cast(df.schema[value].dataType).alias(c) for c in ("low", "high")], F.lit(0).cast("bigint").alias("outliers"))
    return found.unionByName(none)


def paired_ratio(df: DataFrame, key: str, side: str, first: str, second: str, value: str) -> DataFrame:
    """One row: median, least and greatest ratio of ``first``'s value to ``second``'s over the keys that have both."""
    a = df.where(F.col(side) == first).select(key, F.col(value).alias("a"))
    b = df.where(F.col(side) == second).select(key, F.col(value).alias("b"))
    ratios = a.join(b, key).where("b <> 0").select((F.col("a") / F.col("b")).alias("ratio"))
    median = ranked_values(ratios, "ratio", 0.5)[0]
    return ratios.agg(F.lit(median).cast("double").alias("median"), F.min("ratio").alias("least"), F.max("ratio").alias("greatest"), F.count("*").alias("n"))


def time_logs(lines: DataFrame) -> DataFrame:
    """wall_seconds and rss_kb of ``/usr/bin/time -v`` reports: rows (file, value) of text lines."""
    wall = F.regexp_extract("value", r"Elapsed \(wall clock\) time.*: ([0-9:.]+)\s*$", 1)
    parts = F.reverse(F.split(F.col("wall"), ":"))
    seconds = F.aggregate(F.transform(parts, lambda p, i: p.cast("double") * F.pow(F.lit(60), i)), F.lit(0.0), lambda a, b: a + b)
    x = lines.select("file", F.nullif(wall, F.lit("")).alias("wall"), F.nullif(F.regexp_extract("value", r"Maximum resident set size \(kbytes\): (\d+)", 1), F.lit("")).alias("rss"))
    return x.groupBy("file").agg(F.max(F.when(F.col("wall").isNotNull(), seconds)).alias("wall_seconds"), F.max(F.col("rss").cast("bigint")).alias("rss_kb"))
