"""Document fingerprints by winnowing.

A text's words give rolling ``k``-grams, each with a hash; of every ``window`` neighbouring
grams the one with the least hash is chosen, the rightmost of equals. So whatever run of
``k + window - 1`` words two texts share, they share a chosen gram of it; its position is kept.
A gram is one number: its hash above, the complement of its position below, so that least()
finds the least hash and among equals the rightmost. Likeness is the Jaccard index of the
chosen hashes. All of it is built-in functions over arrays, map-side.

The next document in descending doc_id is found from range partitions of the ids alone; its
needed text and its hashes travel to it in one join.

Defined results: null or empty text, or one without words, has an empty fingerprint; two
empty ones are alike (1), an empty and another are not (0). Fewer words than ``k`` are one
gram, fewer grams than a window are one window. Null doc_id comes last in the order. Rows
that share a doc_id have the same next document; of several rows with the next doc_id, the
one with the least text hash is the next. Of a single doc_id, it is its own next. Positions
from 2**24 - 1 on count as that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut

PLACE_BITS = 24
LAST_PLACE = (1 << PLACE_BITS) - 1
BLANKS = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def _grams(words: str, k: int) -> Column:
    """Of every k-gram of the words in column ``words``: 39 bits of its hash over the complement of its position."""
    w = F.col(words)

    def gram(i: Column) -> Column:
        h = F.xxhash64(*[F.get(w, i + j) for j in range(k)])
        return F.shiftleft(F.shiftrightunsigned(h, PLACE_BITS + 1), PLACE_BITS).bitwiseOR(F.lit(LAST_PLACE) - F.least(i, F.lit(LAST_PLACE)))

    return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))), lambda i: gram(i.cast("bigint"))))


def winnow(df: DataFrame, text: str, out: str, k: int = 5, window: int = 8) -> DataFrame:
    """``df`` with the chosen grams of column ``text`` as array<bigint> ``out``, by position.

    The least of every window is found by doubling: of 2 neighbours, of 4, and so on. Each
    step is a column of its own, so that Spark works it out once."""
    x = df.withColumn("__words", words_of(F.coalesce(F.col(text), F.lit(""))))
    x = x.withColumn("__grams", _grams("__words", k)).withColumn("__least", F.col("__grams"))
    width, g = 1, F.col("__least")
    while width < window:
        step = min(width, window - width)
        n = F.greatest(F.size("__grams") - (width + step - 1), F.lit(0))
        x = x.withColumn("__least", F.zip_with(F.slice(g, F.lit(1), n), F.slice(g, F.lit(step + 1), n), lambda a, b: F.least(a, b)))
        width += step
    every = F.when(F.size("__grams") > window, g).when(F.size("__grams") > 0, F.array(F.array_min("__grams"))).otherwise(F.col("__grams"))
    return x.withColumn(out, F.array_distinct(every)).drop("__words", "__grams", "__least")


def hashes(chosen: Column) -> Column:
    """The distinct hashes of chosen grams, all 39 bits that the fingerprint shows."""
    return F.array_distinct(F.transform(chosen, lambda g: F.shiftright(g, PLACE_BITS)))


def written(chosen: Column) -> Column:
    """The fingerprint as text: position:hash of every chosen gram."""
    return F.array_join(F.transform(chosen, lambda g: F.concat((F.lit(LAST_PLACE) - g.bitwiseAND(F.lit(LAST_PLACE))).cast("string"), F.lit(":"), F.lower(F.hex(F.shiftright(g, PLACE_BITS))))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays of distinct hashes; of two empty ones 1."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def next_ids(docs: DataFrame) -> DataFrame:
    """next, doc_id, need: which doc_id sends its text to doc_id, and how many code points of it at most."""
    ids = docs.groupBy("doc_id").agg(F.floor(F.max(F.length(F.coalesce("text", F.lit("")))) / 3).cast("int").alias("need"))
    order = F.col("doc_id").desc_nulls_last()
    dealt = cut(ids.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    # one row a partition in this window
    heads = dealt.groupBy("part").agg(F.max("doc_id").alias("head"))
    every = Window.orderBy("part")
    heads = heads.select("part", F.lead("part").over(every).alias("after"), F.lead("head").over(every).alias("lead"), F.first("head").over(every).alias("top"))
    heads = heads.select("part", F.when(F.col("after").isNull(), F.col("top")).otherwise(F.col("lead")).alias("beyond"))
    own = Window.partitionBy("part").orderBy(order)
    x = dealt.withColumn("last", F.lead("part").over(own).isNull()).withColumn("next", F.lead("doc_id").over(own)).join(heads, "part")
    return x.select(F.when(F.col("last"), F.col("beyond")).otherwise(F.col("next")).alias("next"), "doc_id", "need")


def fingerprints(docs: DataFrame, k: int = 5, window: int = 8) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))  # shuffled once: both joins read the same exchange
    to = next_ids(docs.select("doc_id", "text")).select(F.col("next"), F.col("doc_id").alias("to"), "need")
    sent = winnow(base.join(to, F.col("doc_id").eqNullSafe(F.col("next"))).select("to", "text", "need"), "text", "chosen", k, window)
    sent = sent.select("to", F.xxhash64("text").alias("h"), F.expr("substring(text, 1, need)").alias("start"), hashes(F.col("chosen")).alias("next_hashes"))
    sent = sent.groupBy("to").agg(F.min(F.struct("h", "start", "next_hashes")).alias("m")).select("to", "m.start", "m.next_hashes")
    x = base.join(sent, F.col("doc_id").eqNullSafe(F.col("to")))
    x = x.withColumn("n_chars", F.length("text").cast("long")).withColumn("third", F.floor(F.col("n_chars") / 3).cast("int"))
    x = x.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - third as int)), substring(start, 1, third))"))
    x = winnow(x, "text", "chosen", k, window).select("doc_id", "n_chars", "edited", "chosen", "next_hashes")
    x = winnow(x, "edited", "edited_chosen", k, window)
    x = x.withColumn("own_hashes", hashes(F.col("chosen"))).withColumn("edited_hashes", hashes(F.col("edited_chosen")))
    return x.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written(F.col("chosen")).alias("fingerprint"), written(F.col("edited_chosen")).alias("edited_fingerprint"),
        likeness(F.col("own_hashes"), F.col("edited_hashes")).alias("near_edited"), likeness(F.col("own_hashes"), F.col("next_hashes")).alias("near_next"),
    )
