"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a local session may do without: it gets a folder of its own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: the lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the tables of ``cut`` that no later step reads."""
    for x in frames:
        spark = x.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(x.cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def done(*frames: DataFrame) -> None:
    """``drop``, and let go of finished steps' shuffle files.

    Spark removes the files of a shuffle once the driver's garbage collector finds its plan unused, by itself at most every
    half hour. A job of many steps would hold all of them until then."""
    drop(*frames)
    gc.collect()
    for _ in range(2):  # Spark's listeners let go of the finished plan a while after it; on a busy driver the first wait can be too short
        time.sleep(0.5)
        SparkSession.active()._jvm.System.gc()


def text_or_empty(c: Column | str = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
