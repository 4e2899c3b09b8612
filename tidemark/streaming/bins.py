"""Fine bins of tracks that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import STEP


def fine_bin_updates(track: DataFrame, step: int = STEP) -> DataFrame:
    """chrom, bin, plus, minus so far, for a streaming (or static) track; write it in update or complete mode.

    The state is one row a bin that has signal; the scan's passes read it as they read bins of a table."""
    x = track.where("end > start").select("chrom", "start", "end", "value", "strand", F.explode(F.sequence(F.expr(f"start div {step}"), F.expr(f"(`end` - 1) div {step}"))).alias("bin"))
    covered = F.least("end", (F.col("bin") + 1) * step) - F.greatest("start", F.col("bin") * step)
    part = lambda s: F.coalesce(F.sum(F.when(F.col("strand") == s, F.col("value") * covered)), F.lit(0))
    return x.groupBy("chrom", "bin").agg(part("+").alias("plus"), part("-").alias("minus"))
