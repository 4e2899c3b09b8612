"""Interval algebra: joins by overlap, merging, intersection, adding of tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running_sum, with_neighbours


def overlap_join(points: DataFrame, spans: DataFrame, bucket: int = 1 << 14) -> DataFrame:
    """Rows of ``points`` (chrom, start, ...) joined with the ``spans`` (chrom, span_start, span_end, ...) that hold their start.

    Spark has no range join: a span stands once in each bucket of the axis it touches, so the join is an equi-join on (chrom, bucket)."""
    p = points.withColumn("__bucket", F.floor(F.col("start") / bucket))
    s = spans.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("span_start") / bucket), F.floor((F.col("span_end") - 1) / bucket))))
    return p.join(s, ["chrom", "__bucket"]).where("span_start <= start and start < span_end").drop("__bucket")


def raw_values(track: DataFrame, ranges: DataFrame) -> DataFrame:
    """chrom, start, end, pos, value: the track's value at every base of ``ranges`` (chrom, start, end); 0 where it has none, beyond a chrom's ends, and on a chrom it lacks."""
    wanted = ranges.select("chrom", "start", "end").distinct()
    bases = wanted.select("chrom", F.col("start").alias("range_start"), F.col("end").alias("range_end"), F.explode(F.when(F.col("end") > F.col("start"), F.sequence("start", F.col("end") - 1)).otherwise(F.array().cast("array<bigint>"))).alias("start"))
    spans = track.where("end > start").select("chrom", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "value")
    keys = ["chrom", "range_start", "range_end", "start"]
    found = overlap_join(bases, spans).groupBy(*keys).agg(F.sum("value").alias("value"))
    x = bases.join(found, keys, "left")
    return x.select("chrom", F.col("range_start").alias("start"), F.col("range_end").alias("end"), F.col("start").alias("pos"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))


def _most_so_far(x: DataFrame, value: str, out: str, last: int) -> DataFrame:
    """``x`` (with __tile) with ``out``: the greatest ``value`` of its chrom up to ``last`` rows from here. A tile takes one row from those before it."""
    tiles = x.groupBy("chrom", "__tile").agg(F.max(value).alias("__m"))
    before = F.max("__m").over(Window.partitionBy("chrom").orderBy("__tile").rowsBetween(Window.unboundedPreceding, -1))
    own = F.max(value).over(Window.partitionBy("chrom", "__tile").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, last))
    x = x.withColumn(out, own).join(tiles.select("chrom", "__tile", before.alias("__before")), ["chrom", "__tile"])
    return x.withColumn(out, F.greatest(out, "__before")).drop("__before")


def merged(spans: DataFrame, gap: int = 0, tile: int = 1 << 22) -> DataFrame:
    """chrom, start, end: spans that overlap, or lie at most ``gap`` apart, as one. An island's name is its first start."""
    x = spans.select("chrom", "start", "end").withColumn("__tile", F.floor(F.col("start") / tile))
    x = _most_so_far(x, "end", "__reach", -1)
    x = x.withColumn("__new", F.when(F.col("__reach").isNull() | (F.col("start") > F.col("__reach") + gap), F.col("start")))
    x = _most_so_far(x, "__new", "__island", 0)
    return x.groupBy("chrom", "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


def jaccard(a: DataFrame, b: DataFrame, bucket: int = 1 << 14) -> DataFrame:
    """One row: bases in both, bases in either, their ratio, and how many pairs of merged spans meet."""
    a, b = merged(a), merged(b)

    def bucketed(x: DataFrame, side: str) -> DataFrame:
        return x.select("chrom", F.col("start").alias(f"{side}s"), F.col("end").alias(f"{side}e"), F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket))).alias("bk"))

    start, end = F.greatest("as", "bs"), F.least("ae", "be")
    met = bucketed(a, "a").join(bucketed(b, "b"), ["chrom", "bk"]).where((start < end) & (F.floor(start / bucket) == F.col("bk")))
    met = met.agg(F.coalesce(F.sum(end - start), F.lit(0)).alias("intersection"), F.count("*").alias("n_intersections"))
    length = lambda x: x.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0))).scalar()
    x = met.withColumn("union", length(a) + length(b) - F.col("intersection"))
    return x.select("intersection", "union", F.when(F.col("union") > 0, F.col("intersection") / F.col("union")).otherwise(F.lit(0.0)).alias("jaccard"), "n_intersections")


def merge_add(*tracks: DataFrame) -> DataFrame:
    """chrom, start, end, value: the sum of tracks as a step function; stretches of value 0 are left out."""
    steps = None
    for t in tracks:
        x = t.select("chrom", F.explode(F.array(F.struct(F.col("start").alias("at"), F.col("value").alias("d")), F.struct(F.col("end").alias("at"), (-F.col("value")).alias("d")))).alias("e")).select("chrom", "e.at", "e.d")
        steps = x if steps is None else steps.unionByName(x)
    steps = steps.groupBy("chrom", "at").agg(F.sum("d").alias("d"))
    x = running_sum(with_neighbours(steps, "chrom", "at", ["at"]), "chrom", "at", "d", "value")
    return x.where("value <> 0 and next is not null").select("chrom", F.col("at").alias("start"), F.col("next.at").alias("end"), "value")
