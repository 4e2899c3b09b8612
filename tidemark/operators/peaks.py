"""From scored positions to broad peaks: gap filling, merging, summaries, a denser grid, and the loop that puts them together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import overlap_join
from .noise import min_score
from .ordered import running_sum, with_neighbours

# Fixed values of the method.
PAD, JOIN, GRID, STEP, FLOOR = 50, 500, 10, 50, 0.05

Scorer = Callable[[DataFrame], DataFrame]


def _true(c: Column) -> Column:
    """NaN compares greater than anything in Spark, so every score test asks for a number first."""
    return c & ~F.isnan("score")


def gap_lengths(positions: DataFrame) -> DataFrame:
    """chrom, start, gap: bases to the next position of the chrom (none for the last)."""
    x = with_neighbours(positions, "chrom", "start", ["start"])
    return x.where("next is not null").select("chrom", "start", (F.col("next.start") - F.col("start")).alias("gap"))


def gap_fill(scored: DataFrame, threshold: float | Column) -> DataFrame:
    """chrom, start, end: new positions in gaps beside positions that score above the threshold.

    A gap under 500 bases is filled at every 50; a longer one by as many steps as the score is
    above the threshold in units of 0.05, from the one side, the other, or both. The steps count
    from 1 to that number, downwards if it is 0."""
    x = with_neighbours(scored.select("chrom", "start", "score"), "chrom", "start", ["start", "score"]).where("next is not null")
    x = x.withColumn("t", F.lit(threshold) if isinstance(threshold, float | int) else threshold)
    t = F.col("t")
    x = x.withColumn("gap", F.col("next.start") - F.col("start")).where(F.col("gap") > STEP)

    def steps(score: Column) -> Column:
        n = F.when(F.col("gap") < JOIN, F.floor((F.col("gap") - STEP) / STEP)).otherwise(F.ceil((score - t) / 0.05))
        return F.sequence(F.lit(1).cast("bigint"), n.cast("bigint"))

    def side(score: Column, base: Column, sign: int) -> Column:
        some = (score > t) & ~F.isnan(score)
        return F.when(some, F.transform(steps(F.when(some, score)), lambda k: base + k * (sign * STEP))).otherwise(F.array().cast("array<bigint>"))

    new = x.select("chrom", F.explode(F.concat(side(F.col("score"), F.col("start"), 1), side(F.col("next.score"), F.col("next.start"), -1))).alias("start")).distinct()
    return new.join(scored.select("chrom", "start"), ["chrom", "start"], "left_anti").withColumn("end", F.col("start") + 1)


def broad_peaks(scored: DataFrame, threshold: float = FLOOR, join: int = JOIN, drop_last: bool = True) -> DataFrame:
    """chrom, start, end: runs of positions scoring at least ``threshold`` with less than ``join`` between their padded ends.

    Runs of one position, and each chrom's last run (``drop_last``), are left out."""
    x = scored.where(_true(F.col("score") >= threshold)).select("chrom", (F.col("start") - PAD).alias("start"), (F.col("end") + PAD).alias("end"))
    x = with_neighbours(x, "chrom", "start", ["end"]).withColumn("break", F.when(F.col("start") - F.col("prev.end") >= join, 1).otherwise(0))
    x = running_sum(x.drop("prev", "next"), "chrom", "start", "break", "run")
    runs = x.groupBy("chrom", "run").agg(F.min("start").alias("start"), F.max_by("end", "start").alias("end"), F.count("*").alias("n"))
    if drop_last:
        last = runs.groupBy("chrom").agg(F.max("run").alias("last"))
        runs = runs.join(last, "chrom").where("run < last")
    return runs.where("n > 1").select("chrom", "start", "end")


def summary(scored: DataFrame, peaks: DataFrame) -> DataFrame:
    """chrom, start, end, min, max, mean, sum, stdev, count over all positions inside each peak."""
    spans = peaks.select("chrom", F.col("start").alias("span_start"), F.col("end").alias("span_end"))
    x = overlap_join(scored.select("chrom", "start", "score"), spans).groupBy("chrom", "span_start", "span_end")
    x = x.agg(F.min("score").alias("min"), F.max("score").alias("max"), F.avg("score").alias("mean"), F.sum("score").alias("sum"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("stdev"), F.count("*").alias("count"))
    return x.withColumnsRenamed({"span_start": "start", "span_end": "end"})


def densify_grid(scored: DataFrame, peaks: DataFrame, step: int = GRID) -> DataFrame:
    """chrom, start, end: every ``step`` bases of each peak and its end, less the positions already there."""
    grid = F.array_union(F.sequence(F.col("start"), F.col("end") - 1, F.lit(step).cast("bigint")), F.array("end"))
    new = peaks.select("chrom", F.explode(grid).alias("start")).distinct()
    return new.join(scored.select("chrom", "start"), ["chrom", "start"], "left_anti").withColumn("end", F.col("start") + 1)


def dense_positions(scored: DataFrame, score: Scorer) -> tuple[DataFrame, DataFrame, Column]:
    """Scored positions with gaps filled and broad peaks densified (infp 1 for the first, 0 for added ones), the broad peaks, and the noise floor.

    ``score`` maps (chrom, start, end) to the same with score. The frames should be cached or written before they're read more than once."""
    least = min_score(scored)
    dense = scored.withColumn("infp", F.lit(1)).unionByName(score(gap_fill(scored, least)).withColumn("infp", F.lit(0)))
    broad = summary(dense, broad_peaks(dense))
    more = score(densify_grid(dense, broad.where(F.col("max") >= least))).where(_true(F.col("score") > FLOOR))
    return dense.unionByName(more.withColumn("infp", F.lit(0))), broad, least
