"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. ``sf_dir`` is where a stage finds other tables (labels).

Defined results: an empty table gives no rows at every stage. Null or empty texts fail the quality rules; given to a later
stage by themselves, they have no lines, are near-duplicates of one another, have size 0 in the mix and pack as their closing
id. Rows with null doc_id are judged like others, lose no lines, and leave one row of each group of near-duplicates. Repeated
rows lose the same lines and are near-duplicates; unlike texts under one doc_id are documents of their own up to the mix, which
takes rows that share doc_id and source equally often. Extra columns pass through unchanged until packing, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import lines, mixing, packing, quality, simhash
from tidemark.llm.common import cut, done, table
from tidemark.llm.queries import word_tokenizer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


CORE = ("doc_id", "text", "lang", "source", "n_chars")


def apart(stage: Stage) -> Stage:
    """The stage with the columns that aren't those of documents in one struct meanwhile, so that no name of theirs meets one of an operator's."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        extra = [c for c in docs.columns if c not in CORE]
        if not extra:
            return stage(spark, docs, sf_dir)
        held = docs.select(*[c for c in docs.columns if c in CORE], F.struct(*[F.col(f"`{c}`") for c in extra]).alias("extra"))
        out = stage(spark, held, sf_dir)
        return out.select(*[F.col("extra").getField(c).alias(c) if c in extra else F.col(c) for c in docs.columns])

    return run


@apart
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the log-likelihood ratio go."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


@apart
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines with an earlier match go; n_chars follows the text."""
    kept = lines.dedup(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("long"))


@apart
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


@apart
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's target weight says."""
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack(docs, word_tokenizer())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("source mixing", source_mixing),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        done(*[before] if k else [])  # the stage's input, unless it is the documents themselves
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenizing, hashing and fitted models are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None
