"""The noise model of scores: Laplace scale and floor, neighbour correlations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import laplace_quantile
from .ordered import ranked, ranked_values, with_neighbours

TAIL = 0.001


def noise_counts(scored: DataFrame) -> DataFrame:
    """One row: negative, zero and noise (each negative, its mirror image, each zero) counts."""
    x = scored.where(~F.isnan("score")).agg(F.count_if(F.col("score") < 0).alias("negative"), F.count_if(F.col("score") == 0).alias("zero"))
    return x.withColumn("noise", 2 * F.col("negative") + F.col("zero"))


def laplace_sigma(scored: DataFrame) -> DataFrame:
    """One row, sigma: the mean absolute noise after values beyond 5 standard deviations are left out.

    Noise is each negative score, its mirror image, and each zero; sums over it follow from sums over
    the scores at or below zero. Null without noise."""
    x = scored.where("score <= 0").select(F.abs("score").alias("d"), F.when(F.col("score") < 0, 2).otherwise(1).alias("times"))
    std = x.agg(math.sqrt(2) * F.sum(F.col("d") * F.col("times")) / F.sum("times")).scalar()
    kept = x.where(~(F.col("d") > 5 * std))
    return kept.agg((F.sum(F.col("d") * F.col("times")) / F.sum("times")).alias("sigma"))


def min_score_row(scored: DataFrame) -> DataFrame:
    """One row: sigma and the score that noise exceeds with probability 0.001 / 2."""
    return laplace_sigma(scored).withColumn("min_score", laplace_quantile(F.lit(1 - TAIL / 2), 0.0, F.col("sigma")))


def min_score(scored: DataFrame) -> Column:
    return min_score_row(scored).select("min_score").scalar()


def quantiles(scored: DataFrame) -> DataFrame:
    """One row: q01, q50, q99, min, max of the scores that aren't null."""
    q = ranked_values(scored.where("score is not null"), "score", 0.01, 0.5, 0.99)
    named = [F.lit(v).cast("double").alias(c) for v, c in zip(q, ("q01", "q50", "q99"))]
    return scored.agg(F.min("score").alias("min"), F.max("score").alias("max")).select(*named, "min", "max")


def thinned(scored: DataFrame, distance: int = 20) -> DataFrame:
    """idx, score: positions whose second predecessor lies ``distance`` bases before, every other one, numbered over all chroms.

    The second predecessor is the predecessor's predecessor, so a window over whole chroms isn't needed."""
    x = with_neighbours(scored.select("chrom", "start", "score"), "chrom", "start", ["start"])
    x = with_neighbours(x.select("chrom", "start", "score", F.col("prev.start").alias("p")), "chrom", "start", ["start", "p"])
    x = x.where(F.col("start") - F.col("prev.p") == distance).select("chrom", "start", "score")
    x = ranked(x, F.col("chrom"), F.col("start"))
    return x.where("rank % 2 = 1").select(((F.col("rank") + 1) / 2).cast("bigint").alias("idx"), "score")


def lag_correlations(scored: DataFrame, distance: int = 20, order: int = 5) -> DataFrame:
    """lag, rho for lags 1 to order - 1: each is an equi-join of the series with itself, shifted."""
    x = thinned(scored, distance)
    pairs = x.select((F.col("idx")).alias("i"), F.explode(F.array(*[F.lit(k) for k in range(1, order)])).alias("lag"), F.col("score").alias("a")).withColumn("idx", F.col("i") - F.col("lag"))
    return pairs.join(x, "idx").groupBy("lag").agg(F.corr("a", "score").alias("rho"))


def truncated_variance(scored: DataFrame, bound: float = 0.5, distance: int = 20) -> DataFrame:
    return thinned(scored, distance).where(F.abs("score") <= bound).agg(F.var_samp("score").alias("variance"))


def covariance(scored: DataFrame, distance: int = 20, order: int = 5) -> DataFrame:
    """i, j, cov: the Toeplitz covariance of ``order`` neighbours."""
    rho = lag_correlations(scored, distance, order).unionByName(scored.sparkSession.range(1).select(F.lit(0).alias("lag"), F.lit(1.0).alias("rho")))
    cells = scored.sparkSession.range(order * order).select((F.col("id") / order).cast("int").alias("i"), (F.col("id") % order).cast("int").alias("j")).withColumn("lag", F.abs(F.col("i") - F.col("j")))
    return cells.join(rho, "lag").select("i", "j", (truncated_variance(scored, distance=distance).scalar() * F.col("rho")).alias("cov"))
