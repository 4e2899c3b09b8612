"""Tracks from files and tables. A track has columns chrom, start, end, value, strand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRACK = T.StructType([T.StructField("chrom", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("strand", T.StringType())])
SIZES = T.StructType([T.StructField("chrom", T.StringType()), T.StructField("size", T.LongType())])
BED = T.StructType([T.StructField("chrom", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def bedgraph(spark: SparkSession, path: str, strand: str) -> DataFrame:
    """One strand from a bedGraph (plain or gzipped); track and browser lines are skipped."""
    schema = T.StructType(TRACK.fields[:4])
    x = spark.read.csv(path, sep="\t", schema=schema, comment="#", mode="DROPMALFORMED")
    return x.where("start is not null").withColumn("strand", F.lit(strand))


def bigwig(spark: SparkSession, path: str, strand: str, **options) -> DataFrame:
    """One strand from a bigWig file or a folder of them. Filters on chrom, start and end reach the file's range tree."""
    x = _bigwig(spark).options(**options).load(path)
    return x.withColumn("strand", F.lit(strand))


def bigwig_sizes(spark: SparkSession, path: str) -> DataFrame:
    """chrom and size from a bigWig's header."""
    return _bigwig(spark).option("table", "sizes").load(path).distinct()


def _bigwig(spark: SparkSession):
    from .bigwig import BigWig

    spark.dataSource.register(BigWig)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("bigwig")


def is_bigwig(path: str) -> bool:
    return path.lower().endswith((".bw", ".bigwig"))


def strand_file(spark: SparkSession, path: str, strand: str) -> DataFrame:
    """One strand from a bigWig or bedGraph file, told apart by the ending."""
    return bigwig(spark, path, strand) if is_bigwig(path) else bedgraph(spark, path, strand)


def two_strands(plus: DataFrame, minus: DataFrame) -> DataFrame:
    one = lambda x, s: x.select("chrom", "start", "end", "value").withColumn("strand", F.lit(s))
    return one(plus, "+").unionByName(one(minus, "-"))


def chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=SIZES)


def bed(spark: SparkSession, path: str) -> DataFrame:
    """The first three columns of a BED file; bgzip is gzip to Spark."""
    x = spark.read.csv(path, sep="\t", comment="#")
    a, b, c = x.columns[:3]
    return x.select(F.col(a).alias("chrom"), F.col(b).cast("long").alias("start"), F.col(c).cast("long").alias("end")).where("start is not null")


def indexed_bed(spark: SparkSession, path: str, schema: str = "chrom string, start bigint, end bigint", **options) -> DataFrame:
    """A BED file that has a range index beside it, first columns as in ``schema``. Filters on chrom, start and end choose the blocks that are read."""
    from .bgzf import IndexedBed

    spark.dataSource.register(IndexedBed)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("indexed_bed").schema(schema).options(**options).load(path)


def events_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as signal: type as chrom, seconds of 2024 as position, cents as value, the user's parity as strand."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return e.select(F.col("event_type").alias("chrom"), at.alias("start"), (at + 1).alias("end"), F.round(F.col("value") * 100).cast("bigint").alias("value"), F.when(F.col("user_id") % 2 == 0, "+").otherwise("-").alias("strand"))


def lineitem_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as signal: return flag as chrom, order and line as position, quantity as value, status as strand."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    at = F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 10
    return x.select(F.col("l_returnflag").alias("chrom"), at.alias("start"), (at + 1).alias("end"), F.col("l_quantity").cast("bigint").alias("value"), F.when(F.col("l_linestatus") == "F", "+").otherwise("-").alias("strand"))


def proxy_scores(positions: DataFrame) -> DataFrame:
    """A deterministic score for positions, for queries that need scores without a model: half negative, half up to 1."""
    h = F.expr("((start div 50) * 7919) % 1000")
    return positions.withColumn("score", F.when(h < 500, -h / 50000.0).otherwise((h - 500) / 500.0))
