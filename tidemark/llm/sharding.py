"""Sharding by jump consistent hashing.

A row's key decides its shard: a 64-bit hash of the key is stepped through a linear congruential
sequence, each step jumping to a later shard, and the last one before ``shards`` is taken. There is
no ring and no table; with one shard more a row either stays or goes to the new shard, as about one row in
``shards + 1`` does. All of it is built-in functions on the row, so nothing is shuffled to choose a shard.

Slots number a shard's rows without gaps, by key and then by content. A shard can be far larger than
a task, so ranks come from range partitions over (shard, key, ...), which a shard spreads over; one row
for each partition and shard carries what lies before. Equal rows are spread by a random number at
the end of the order: which of them has which slot makes no difference to the result.

``write`` deals the rows of each shard out to as many tasks as its bytes ask for; ``moves`` lists what an
appended shard takes.

Defined results: null text has no bytes (size 8, crc32 0); rows that share a key, and all those
whose key is null, go to the same shard; repeated rows have a slot each; an empty table gives no rows;
other columns don't matter to ``assign``, and pass through ``write`` and ``moves`` unless they have the name
``shard``, ``from_shard`` or ``to_shard``, which is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

# Fixed values of the method: the sequence's factor, 2**31, 2**33 and 2**64.
FACTOR, HIGH_RANGE, LOW_RANGE, WORD_RANGE = 2862933555777941757, 2147483648, 8589934592, 18446744073709551616
#: So many jumps are made for all rows. A row needs more about once in 10**20 times; it then goes on in a second expression.
USUAL = 64


def key_hash(key: Column, seed: int = 0) -> Column:
    """The first 16 hex digits of an MD5, as a decimal from 0 to 2**64 - 1; null is a key of its own."""
    text = F.when(key.isNull(), F.lit("null")).otherwise(F.concat(F.lit("key "), key.cast("string")))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), text)), 1, 16), 16, 10).cast("decimal(20,0)")


def _decimal(v: int) -> Column:
    return F.lit(str(v)).cast(f"decimal({len(str(v))},0)")


def _jumped(state: Column, shards: int, first: int, last: int) -> Column:
    """``state`` (k, b, j) after jumps number ``first`` to ``last``, or as many as start below ``shards``.

    Decimals hold the product of two 64-bit numbers exactly, whatever the session does on overflow."""

    def step(s: Column) -> Column:
        k = ((s["k"] * _decimal(FACTOR) + _decimal(1)) % _decimal(WORD_RANGE)).cast("decimal(20,0)")
        high = ((k - k % _decimal(LOW_RANGE)) / _decimal(LOW_RANGE)).cast("bigint")
        j = F.floor((s["j"] + 1) * (F.lit(float(HIGH_RANGE)) / (high + 1)))
        return F.struct(k.alias("k"), s["j"].alias("b"), j.cast("bigint").alias("j"))

    return F.aggregate(F.sequence(F.lit(first), F.lit(last)), state, lambda s, _: F.when(s["j"] >= shards, s).otherwise(step(s)))


def jump(hashed: Column, shards: int) -> Column:
    """The shard, from 0 to ``shards`` - 1, of a hash from 0 to 2**64 - 1; exact for every hash and number of shards.

    Each jump goes at least one shard on, so ``shards`` jumps always do."""
    if shards < 1:
        raise ValueError("there must be a shard")
    start = F.struct(hashed.alias("k"), F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"))
    usual = _jumped(start, shards, 1, min(USUAL, shards))
    if shards <= USUAL:
        return usual["b"].cast("int")
    rest = lambda s: F.when(s["j"] >= shards, s["b"]).otherwise(_jumped(s, shards, USUAL + 1, shards)["b"])
    return F.transform(F.array(usual), rest)[0].cast("int")


def shard_of(key: str, shards: int, seed: int = 0) -> Column:
    return jump(key_hash(F.col(key), seed), shards)


def assign(docs: DataFrame, shards: int, key: str = "doc_id", seed: int = 0) -> DataFrame:
    """``key``, size, text_crc32, law, shard, slot, grown_shard (with one shard more) of every row."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    x = docs.select(F.col(key), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key_hash(F.col(key), seed).alias("hashed"))
    x = x.select("*", jump(F.col("hashed"), shards).alias("shard"), jump(F.col("hashed"), shards + 1).alias("grown_shard")).drop("hashed")
    order = ["shard", key, "size", "text_crc32", "spread"]
    dealt = cut(x.withColumn("spread", F.rand(seed)).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    parts = dealt.groupBy("part", "shard").agg(F.count("*").alias("n"))  # small: a partition has few shards
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("part", "shard").orderBy(*order[1:]))
    out = dealt.withColumn("own", own).join(parts.select("part", "shard", before.alias("before")), ["part", "shard"])
    return out.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("own") - 1).alias("slot"), "grown_shard")


def moves(docs: DataFrame, shards: int, grown: int, key: str = "doc_id", seed: int = 0) -> DataFrame:
    """The rows, with from_shard and to_shard, that change their shard when ``shards`` become ``grown``; no shuffle."""
    _free(docs, "from_shard", "to_shard")
    x = docs.withColumn("from_shard", shard_of(key, shards, seed)).withColumn("to_shard", shard_of(key, grown, seed))
    return x.where("from_shard <> to_shard")


def write(docs: DataFrame, path: str, shards: int, key: str = "doc_id", seed: int = 0, file_bytes: int = 1 << 28) -> None:
    """All rows and columns as Parquet under ``path``/shard=N, in files of about ``file_bytes`` bytes of text.

    A shard's rows are dealt out at random, so neither a large shard nor a hot key makes a large file."""
    _free(docs, "shard")
    x = docs.withColumn("shard", shard_of(key, shards, seed))
    size = F.octet_length(F.coalesce("text", F.lit("")).cast("binary")) + 8
    files = {r["shard"]: -(-r["bytes"] // file_bytes) for r in x.groupBy("shard").agg(F.sum(size).alias("bytes")).collect()}  # one row a shard
    counts = F.create_map(*[F.lit(v) for kv in files.items() for v in kv]) if files else F.create_map(F.lit(0), F.lit(1))
    deal = F.floor(F.rand(seed) * counts[F.col("shard")]).cast("int")
    x = x.withColumn("__deal", deal).repartition(max(1, sum(files.values())), "shard", "__deal").drop("__deal")
    x.write.mode("overwrite").partitionBy("shard").parquet(path)


def _free(docs: DataFrame, *names: str) -> None:
    if taken := set(names) & set(docs.columns):
        raise ValueError(f"columns {sorted(taken)} would be overwritten")
