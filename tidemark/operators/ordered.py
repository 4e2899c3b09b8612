"""Ordered operations that don't put a whole key, or all rows, in one task.

Rows are cut into tiles of their order column (or range partitions). A window works inside
each tile; one row a tile carries what the tiles before (or after) contribute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept

TILE = 1 << 22


def with_neighbours(df: DataFrame, key: str, at: str, columns: list[str], tile: int = TILE) -> DataFrame:
    """``df`` with structs ``prev`` and ``next``: ``columns`` of the rows before and after in the order of ``at`` within ``key`` (null at the ends)."""
    here = F.struct(*columns)
    x = df.withColumn("__tile", F.floor(F.col(at) / tile))
    ends = x.groupBy(key, "__tile").agg(F.min_by(here, at).alias("__first"), F.max_by(here, at).alias("__last"))
    by_key = Window.partitionBy(key).orderBy("__tile")
    ends = ends.select(key, "__tile", F.lag("__last").over(by_key).alias("__before"), F.lead("__first").over(by_key).alias("__after"))
    own = Window.partitionBy(key, "__tile").orderBy(at)
    x = x.withColumn("prev", F.lag(here).over(own)).withColumn("next", F.lead(here).over(own)).join(ends, [key, "__tile"])
    return x.withColumn("prev", F.coalesce("prev", "__before")).withColumn("next", F.coalesce("next", "__after")).drop("__tile", "__before", "__after")


def running_sum(df: DataFrame, key: str, at: str, value: str, out: str, tile: int = TILE) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` up to this row in the order of ``at`` within ``key``."""
    x = df.withColumn("__tile", F.floor(F.col(at) / tile))
    sums = x.groupBy(key, "__tile").agg(F.sum(value).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.partitionBy(key).orderBy("__tile").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.join(sums.select(key, "__tile", before.alias("__before")), [key, "__tile"])
    own = Window.partitionBy(key, "__tile").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn(out, F.sum(value).over(own) + F.col("__before")).drop("__tile", "__before")


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``rank`` (from 1, over all rows in ``order``), ``m`` (all rows) and ``part`` (its range partition).

    The partitions have a number, so that they aren't merged at run time, and are written: both readers see the same ones.
    Equal rows are ordered by a random number, so that they spread over as many partitions as their share of the rows; nothing
    that is made of ranks here depends on which of them comes first."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = (*order, F.col("__tie"))
    x = kept(df.withColumn("__tie", F.rand(0)).repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    every = Window.orderBy("part")  # one row a partition
    parts = x.groupBy("part").agg(F.count("*").alias("__n"))
    parts = parts.select("part", F.coalesce(F.sum("__n").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("m"))
    own = Window.partitionBy("part").orderBy(*order)
    return x.join(parts, "part").withColumn("rank", F.row_number().over(own) + F.col("__before")).drop("__before", "__tie")


def running_extreme(df: DataFrame, value: str, out: str, least: bool) -> DataFrame:
    """Of rows from ``ranked``: the least ``value`` from this rank on, or the greatest up to this rank.

    The order runs the way the extreme does, so that every frame grows by a row and nothing is looked at twice."""
    f = F.min if least else F.max
    along = lambda c: F.col(c).desc() if least else F.col(c)
    parts = df.groupBy("part").agg(f(value).alias("__x"))
    parts = parts.select("part", f("__x").over(Window.orderBy(along("part")).rowsBetween(Window.unboundedPreceding, -1)).alias("__x"))
    own = f(value).over(Window.partitionBy("part").orderBy(along("rank")).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, own).join(parts, "part").withColumn(out, (F.least if least else F.greatest)(out, "__x")).drop("__x")


def ranked_values(df: DataFrame, value: str, *at: float) -> list[float | None]:
    """The exact quantiles of ``value`` (no nulls), interpolated between neighbours: two ranks each, instead of all values in one task."""
    x = ranked(df.select(value), F.col(value))
    first = x.select("m").first()
    if first is None:
        return [None] * len(at)
    places = [q * (first["m"] - 1) for q in at]
    needed = sorted({int(p) + k for p in places for k in (1, 2)})
    known = {r["rank"]: r[value] for r in x.where(F.col("rank").isin(needed)).select("rank", value).collect()}  # two rows a quantile
    low = [known[int(p) + 1] for p in places]
    return [a + (known.get(int(p) + 2, a) - a) * (p - int(p)) for a, p in zip(low, places)]


def grouped_quantiles(df: DataFrame, value: str, keys: list[str], at: list[float]) -> tuple[DataFrame, DataFrame]:
    """(``keys`` and an array ``q`` of exact quantiles of ``value``, interpolated between neighbours; ``df``'s rows with a value, ``part`` added).

    All keys' rows are ranked together by (key, value), so a key's rows spread over range partitions and each quantile is a look at two
    ranks. Nulls are no values; a key without values has null quantiles."""
    counts = df.groupBy(*keys).agg(F.count(value).alias("__n"))
    x = ranked(df.where(F.col(value).isNotNull()), *[F.col(k) for k in keys], F.col(value))
    first = x.groupBy(*keys).agg(F.min("rank").alias("__first"), F.count("*").alias("__n"))
    q = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(at)]))
    asked = first.select(*keys, "__first", "__n", q.alias("__q")).withColumn("__at", F.col("__q.p") * (F.col("__n") - 1)).withColumn("__low", F.floor("__at"))
    ends = F.explode(F.array(F.lit(0), F.lit(1))).alias("__end")
    asked = asked.select("*", ends).withColumn("__rank", F.col("__first") + F.least(F.col("__low") + F.col("__end"), F.col("__n") - 1))
    share = F.col("__at") - F.col("__low")
    weight = F.when(F.col("__end") == 1, share).otherwise(1 - share)
    found = asked.join(x.select(F.col("rank").alias("__rank"), F.col(value).alias("__v")), "__rank")  # ranks are different: no hot key
    # the neighbour of a whole rank weighs nothing, and must not make NaN of infinity
    part = F.when(weight == 0, F.lit(0.0)).otherwise(F.col("__v") * weight)
    found = found.groupBy(*keys, F.col("__q.i").alias("__i")).agg(F.sum(part).alias("__v"))
    found = found.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__v"))), lambda s: s["__v"]).alias("q"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"c.{k}").eqNullSafe(F.col(f"f.{k}"))
    if not keys:
        return found, x.drop("rank", "m")
    every = counts.alias("c").join(found.alias("f"), same, "left").select(*[F.col(f"c.{k}").alias(k) for k in keys], "f.q")
    return every, x.drop("rank", "m")
