"""Writers: BED and bigWig as single files that tasks write in pieces, bedGraph as folders of range-partitioned parts, gzip-compressed.

bedGraph parts follow the order of chrom and start, so their concatenation is one sorted file; no task writes more than its range."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_bed(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """One BED file in gzip blocks, sorted by chrom and start, coordinates as whole numbers, and its range index at ``path``.tbi, or ``path``.csi where coordinates exceed 2**29."""
    from .bgzf import IndexedBed, shift_for

    if not path.endswith(".bed.gz"):
        raise ValueError("a BED path ends in .bed.gz")
    df.sparkSession.dataSource.register(IndexedBed)
    x = df.select(*(columns or df.columns))
    a, start, end = x.columns[:3]
    x = x.withColumn(start, F.col(start).cast("long")).withColumn(end, F.col(end).cast("long"))
    longest = x.agg(F.max(end)).first()[0]
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in x.columns])
    x = x.select(F.col(a).alias("chrom"), F.col(start).alias("start"), F.col(end).alias("end"), line.alias("line"))
    x.repartitionByRange("chrom", "start", "end").sortWithinPartitions("chrom", "start", "end").write.format("indexed_bed").option("shift", shift_for(longest or 0)).mode("overwrite").save(path)


def write_bedgraph(df: DataFrame, path: str, value: str, sizes: DataFrame | None = None) -> None:
    """chrom, start, end and a value; rows beyond a chrom's size, or on a chrom without one, are left out."""
    x = df.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col(value).cast("double").alias("value"))
    if sizes is not None:
        x = x.join(sizes, "chrom").where("end <= size").select("chrom", "start", "end", "value")
    x.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start").write.mode("overwrite").option("compression", "gzip").csv(path, sep="\t")


def write_bigwig(df: DataFrame, path: str, value: str, sizes: DataFrame) -> None:
    """One bigWig file of chrom, start, end and a value; rows beyond a chrom's size, on a chrom without one, or with a null value are left out."""
    from .bigwig import BigWig

    df.sparkSession.dataSource.register(BigWig)
    known = {r["chrom"]: r["size"] for r in sizes.collect()}  # one row a chrom
    x = df.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col(value).cast("double").alias("value"))
    few = df.sparkSession.createDataFrame(list(known.items()), "chrom string, size bigint")
    x = x.join(F.broadcast(few), "chrom").where("end <= size and value is not null").select("chrom", "start", "end", "value")  # not dealt by chrom
    x = x.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start")
    x.write.format("bigwig").mode("overwrite").option("sizes", json.dumps(known)).save(path)


def write_outputs(prefix: str, dense: DataFrame, raw: DataFrame, peaks: DataFrame, sizes: DataFrame | None = None, tracks: str = "bedgraph") -> list[str]:
    """The standard outputs; peak files only where there are peaks. Returns the paths written. Score tracks as ``bedgraph`` folders or ``bigwig`` files."""
    if tracks == "bigwig" and sizes is None:
        raise ValueError("a bigWig file needs its chroms' sizes")
    write_track, ending = (write_bigwig, "bw") if tracks == "bigwig" else (write_bedgraph, "bedgraph")
    done = [f"{prefix}.infp.{ending}"]
    write_track(dense, done[0], "score", sizes)
    if not raw.isEmpty():
        done.append(f"{prefix}.raw.peak.bed.gz")
        write_bed(raw, done[-1])
    if not peaks.isEmpty():
        prob = peaks.withColumn("prob", 1 - F.col("prob"))
        for name, df, columns in (("full", peaks, None), ("score", peaks, ["chrom", "start", "end", "score"]), ("prob", prob, ["chrom", "start", "end", "prob"])):
            done.append(f"{prefix}.peak.{name}.bed.gz")
            write_bed(df, done[-1], columns)
        for name, df in (("score", peaks), ("prob", prob)):
            done.append(f"{prefix}.peak.{name}.{ending}")
            write_track(df, done[-1], name, sizes)
    return done
