"""Mixing sources to target weights by systematic sampling.

Each source's target is a share of the whole, capped at ``cap`` times its own size; the
excess goes to the others by weight. A document's expected copies are its source's target
over its source's size. Within a source, documents in order of size carry the prefix sum of
expected copies; with one random offset a source, a document is emitted once for each
integer that its part of the sum crosses. Because neighbours in the order have like
sizes, the words taken stay within about one document of the target.

Ranks come from range partitions: each counts its own rows of a source, and a small window
over (partition, source) counts adds up what lies before. A hot source spreads over many.

Defined results: null text has size 0; the null source is a source of its own, last; rows
that share doc_id and source (nulls included) are taken together, each as often as the
others; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size), one row a source, to the same with target.

    The water level is the largest over sources, in order of cap by weight, of what is left
    after the earlier ones' caps over the weights from there on."""
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", F.get(pattern, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
    w = w.withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    w = w.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return w.select("source", "source_size", F.least("most", F.col("level") * F.col("weight")).alias("target"))


def offset(seed: int = 0):
    """The source's random offset in [0, 1): the first 8 hex digits of an MD5."""
    key = F.concat(F.lit(f"{seed}:"), F.when(F.col("source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("source "), "source")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def copies(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 0) -> DataFrame:
    """One row for each doc_id and source: its row count, size, source_size, target and copies of each row."""
    base = docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    units = base.groupBy("doc_id", "source").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    order = [F.col("source"), F.col("size"), F.col("doc_id")]
    dealt = cut(units.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    parts = dealt.groupBy("part", "source").agg(F.count("*").alias("n"), F.sum("size").alias("sum"))
    before = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    goal = targets(parts.groupBy("source").agg(F.sum("sum").alias("source_size")), weights, share, cap).withColumn("u", offset(seed))
    known = before.alias("b").join(goal.alias("g"), F.expr("b.source <=> g.source")).select("b.part", F.col("b.source").alias("src"), "before", "source_size", "target", "u")
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("part", "source").orderBy("size", "doc_id")))
    x = ranked.alias("d").join(known.alias("k"), F.expr("d.part = k.part and d.source <=> k.src"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = F.col("before") + F.col("rank")
    n = F.floor(rate * upto + F.col("u")) - F.floor(rate * (upto - 1) + F.col("u"))
    return x.select("doc_id", F.col("d.source").alias("source"), "rows", "size", "source_size", "target", n.cast("int").alias("copies"))


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document; of rows that share doc_id and source, one."""
    return copies(docs, **options).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows, with all columns of ``docs``, each as often as it is taken."""
    n = copies(docs, **options).where("copies > 0").select(F.col("doc_id").alias("id"), F.col("source").alias("src"), "copies")
    x = docs.alias("d").join(n.alias("n"), F.expr("d.doc_id <=> n.id and d.source <=> n.src"))
    return x.select("d.*", F.explode(F.sequence(F.lit(1), F.col("n.copies"))).alias("__copy")).drop("__copy")
