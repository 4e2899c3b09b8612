"""The whole analysis: scan, score, densify, call, write."""

from __future__ import annotations

import argparse
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import calling, features, peaks, scan
from ..operators.models import Forest, Svr, stored
from ..operators.mvlaplace import TAIL
from ..sources import sinks, tensors, tracks
from ..sources.shared import kept


@dataclass
class Result:
    dense: DataFrame
    raw: DataFrame
    peaks: DataFrame
    min_score: float
    counts: dict[str, int]  # rows of each step; p-values worked out and normal boxes integrated for them


def run(track: DataFrame, svr: Svr, forest: Forest, sizes: DataFrame | None = None, method: str = "fdr", threshold: float = 0.05, width: int = 4, backend: str = "numpy64", or_depth: float = 2, tail: float = TAIL) -> Result:
    """Frames of dense positions, all summits and significant peaks; empty frames where there are none.

    p-values leave out mixing values of mass ``tail``; 0 is exact. Rows are counted as they are written, at no extra pass."""
    seen = {}

    def counted(df: DataFrame, name: str) -> DataFrame:
        seen[name] = Observation(name)
        return kept(df.observe(seen[name], F.count(F.lit(1)).alias("n")))

    svr = stored(svr, track.sparkSession)  # once for all three scorings
    positions = scan.informative_positions(track, sizes, or_depth)
    score = lambda p: kept(features.scored(p, track, svr, backend))
    dense, broad, floor = peaks.dense_positions(counted(features.scored(positions, track, svr, backend), "informative"), score)
    dense, broad = counted(dense, "dense"), counted(broad, "broad")
    least = dense.sparkSession.range(1).select(floor.alias("f")).first()["f"]
    if least is None or least != least:
        raise ValueError("no score lies at or below zero, so there is no noise to set a floor by")
    done = calling.Counters(dense.sparkSession)
    raw, found = calling.call_peaks(dense, broad, float(least), forest, width, 2, method, threshold, tail=tail, counters=done)
    raw, found = counted(raw, "summits"), counted(found, "peaks")
    return Result(dense, raw, found, float(least), {k: v.get["n"] for k, v in seen.items()} | {"p_values": done.tests, "boxes": done.boxes})


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Find peaks in a pair of strand-specific signal tracks (bigWig, by the ending .bw or .bigWig, or bedGraph).")
    p.add_argument("plus")
    p.add_argument("minus")
    p.add_argument("prefix")
    p.add_argument("--svr", required=True, help="regressor file")
    p.add_argument("--forest", required=True, help="split forest file")
    p.add_argument("--sizes", help="chrom and size, tab-separated")
    p.add_argument("--backend", default="numpy64", choices=["numpy64", "numpy32"])
    p.add_argument("--smoothwidth", type=int, default=4)
    p.add_argument("--pv-adjust", default="fdr")
    p.add_argument("--pv-threshold", type=float, default=0.05)
    p.add_argument("--pv-tail", type=float, help=f"mass of mixing values that p-values leave out, {TAIL:g} by default")
    p.add_argument("--pv-exact", action="store_true", help="leave out none; --pv-tail goes before it")
    p.add_argument("-v", "--verbose", action="store_true", help="say how many rows each step had")
    p.add_argument("--track-format", default="bedgraph", choices=["bedgraph", "bigwig"], help="of the score tracks written")
    p.add_argument("--checkpoint-dir", help="folder that the driver and all executors share; spark.checkpoint.dir by default")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.checkpoint_dir:
        spark.sparkContext.setCheckpointDir(a.checkpoint_dir)
    track = tracks.strand_file(spark, a.plus, "+").unionByName(tracks.strand_file(spark, a.minus, "-"))
    if a.sizes:
        sizes = tracks.chrom_sizes(spark, a.sizes)
    else:
        sizes = tracks.bigwig_sizes(spark, a.plus) if tracks.is_bigwig(a.plus) else scan.sizes_of(track)
    tail = a.pv_tail if a.pv_tail is not None else 0.0 if a.pv_exact else TAIL
    r = run(track, tensors.load_svr(a.svr), tensors.load_forest(a.forest), sizes, a.pv_adjust, a.pv_threshold, a.smoothwidth, a.backend, tail=tail)
    if a.verbose:
        print("\n".join(f"{name}: {n}" for name, n in r.counts.items()), file=sys.stderr)
    print("\n".join(sinks.write_outputs(a.prefix, r.dense, r.raw, r.peaks, sizes, a.track_format)))


if __name__ == "__main__":
    main()
