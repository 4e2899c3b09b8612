"""Line dedup: an exact set-similarity join over all lines of all documents.

A line is the set of its words. Words have one order over all lines: by rarity, and by hash
among equals. Two lines with Jaccard index of at least ``similarity`` share one of their first
n - ceil(similarity * n) + 1 words in that order, the shorter one even within a shorter prefix. So
lines are posted under their prefixes' words and meet there, if their lengths, the common
word's places and their parity signatures (one bit a word, added without carry) allow the
similarity; the texts of those that may match are fetched and their whole sets compared.
A line with an earlier match (smaller doc_id, then earlier in the text) is removed.

Rarity comes from counts of all words of all different lines in SLOTS hashed slots, in steps of about 60 %.
A word that shares a slot with a frequent one stands later than it should, which costs some
candidates and no pair, since any one order finds every pair.

Of equal lines only the first goes on. Words of few lines (below COMMON) are met first: all their lines are joined at once, which is at most
256 comparisons a posting. Under each of the other words of its prefix every line is first held against the earliest
line there and its neighbour, which finds most matches in a few comparisons a line, in groups of near copies above
all. Lines are marked by both, then posted anew under those words: those without a match meet all others, those
that have one meet only those.

Joins are merged at every size: what one table is small enough to broadcast in a test grows with the data.

Defined results: null text has no lines and stays null; a line without words always stays;
rows with null doc_id stay whole and remove nothing; rows that share a doc_id are documents of
their own, in the order of their texts' hashes, but rows that share doc_id and text are one
document, and each of them loses the same lines. Words are compared by 57 bits of their hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, done

#: Slots of the word counts: a fixed number, whatever the input.
SLOTS, BLOCK = 1 << 19, 1 << 10
CLASS_BITS, CLASSES = 6, 64
#: Words below this are of class 0, the only ones of their slots: no other line has them, so they are posted nowhere.
ALONE = 1 << (63 - CLASS_BITS)
#: Words from here on may be in 256 lines or more (their slots are of class 12 at least); those below are in fewer.
COMMON = 12 << (63 - CLASS_BITS)
#: Lines of more words have signatures of 128 bits, whose halves, added without carry, are the 64 bits of others.
LONG = 96
DOC = ["doc_id", "v"]
LINE = [*DOC, "line_no"]
BLANKS = " \t\x0b\x0c\r"


def rarity(lines: DataFrame) -> Column:
    """The class of each slot's count, 0 for the rarest, as one constant array. ``lines`` come from ``lines_of``."""
    slot = F.xxhash64("word").bitwiseAND(F.lit(SLOTS - 1).cast("bigint")).cast("int")
    counts = lines.select(F.explode(F.split("line", " ")).alias("word")).select(slot.alias("slot")).groupBy("slot").agg(F.count("*").alias("n"))
    step = F.least(F.floor(1.5 * F.log2("n")), F.lit(CLASSES - 1)).cast("int").alias("step")
    every = lines.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot")).join(counts.select("slot", step), "slot", "left")
    in_block = F.sort_array(F.collect_list(F.struct((F.col("slot") % BLOCK).alias("i"), F.coalesce("step", F.lit(0)).alias("step"))))
    rows = every.groupBy((F.col("slot") / BLOCK).cast("int").alias("block")).agg(F.array_join(F.transform(in_block, lambda s: s["step"].cast("string")), ",").alias("steps"))
    steps = {r["block"]: r["steps"] for r in rows.collect()}  # SLOTS / BLOCK strings
    return F.split(F.lit(",".join(steps[b] for b in range(SLOTS // BLOCK))), ",").cast("array<int>")


def hashes(line: Column) -> Column:
    """The hashes of the words of a line from ``lines_of``."""
    return F.transform(F.split(line, " "), lambda w: F.xxhash64(w))


def ordered(words: Column, steps: Column) -> Column:
    """A line's distinct words, rarest first: the slot's class over the upper bits of the hash."""

    def key(h: Column) -> Column:
        step = F.coalesce(F.get(steps, h.bitwiseAND(F.lit(SLOTS - 1).cast("bigint")).cast("int")), F.lit(0)).cast("bigint")
        return F.shiftleft(step, 63 - CLASS_BITS).bitwiseOR(F.shiftrightunsigned(h, CLASS_BITS + 1))

    return F.array_distinct(F.sort_array(F.transform(words, key)))


def lines_of(docs: DataFrame, numbers: Column | None = None) -> DataFrame:
    """doc_id, v, line_no, line (its words, joined by one space) of every line with a word; of those in ``numbers``, which may name the array __lines."""
    if numbers is None:
        x = docs.select(*DOC, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    else:
        x = docs.withColumn("__lines", F.split("text", "\n")).select(*DOC, "__lines", numbers.alias("__numbers"), F.size("__lines").alias("__size"))
        each = F.transform(F.col("__numbers"), lambda i: F.struct(i.alias("line_no"), F.get(F.col("__lines"), i).alias("line")))
        x = x.select(*DOC, F.inline(each))
    x = x.withColumn("line", F.btrim("line", F.lit(BLANKS))).where("line <> ''")
    return normal(x)


def normal(lines: DataFrame) -> DataFrame:
    """``lines`` with single spaces between words."""
    odd = F.lit(False)
    for blank in ("  ", "\t", "\x0b", "\x0c", "\r"):  # few lines need the pattern, which costs as much as all else
        odd = odd | F.contains("line", F.lit(blank))
    return lines.withColumn("line", F.when(odd, F.regexp_replace("line", SPACE, " ")).otherwise(F.col("line")))


def _before(a: str, b: str) -> str:
    return f"struct({a}doc_id, {a}v, {a}line_no) < struct({b}doc_id, {b}v, {b}line_no)"


def _may(a: str, b: str, num: int, den: int) -> str:
    """Whether lengths, places of a common word and signatures allow num / den of similarity."""
    both = f"({a}n + {b}n)"
    return (
        f"{den} * least({a}n, {b}n) >= {num} * greatest({a}n, {b}n) and {num + den} * least({a}n - {a}at, {b}n - {b}at) >= {num} * {both}"
        f" and {num + den} * if(least({a}n, {b}n) > {LONG}, bit_count({a}sig ^ {b}sig) + bit_count({a}more ^ {b}more), bit_count({a}sig ^ {a}more ^ {b}sig ^ {b}more)) <= {den - num} * {both}"
    )


def _prefix(n: Column, num: int, den: int) -> Column:
    return (n - F.floor((num * n + (den - 1)) / den) + 1).cast("int")


def _posts(prefixes: DataFrame) -> DataFrame:
    """A row for each line and word of ``prefixes``, with the word's place in the line's order."""
    x = prefixes.select(*LINE, "n", "sig", "more", "matched", "alone", F.posexplode("prefix").alias("at", "word"))
    return x.withColumn("at", F.col("at") + F.col("alone")).drop("alone")


def _pairs(short: DataFrame, long: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (line, a) of a line without a match and an earlier one that a word joins and the filters leave; of the shorter one the word stands in its short prefix."""
    a = short.where(f"at <= n - ceil({2 * num} * n / {num + den})").select("word", *[F.col(c).alias(f"a_{c}") for c in (*LINE, "n", "at", "sig", "more", "matched")])
    order = f"(a_n < n or (a_n = n and {_before('a_', '')}))"  # each pair once
    x = a.join(long.hint("merge"), "word").where(f"{order} and {_may('a_', '', num, den)} and not if({_before('a_', '')}, matched, a_matched)")
    here, there = F.struct(*LINE), F.struct(*[F.col(f"a_{c}").alias(c) for c in LINE])
    return x.select(F.greatest(here, there).alias("line"), F.least(here, there).alias("a"), (F.col("n") + F.col("a_n")).alias("words"))


def _matched(pairs: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """The later lines of the pairs that are similar; texts: lines by key, at least those of the pairs."""
    keyed = texts.select(F.struct(*LINE).alias("line"), F.col("line").alias("text"))
    x = pairs.join(keyed.hint("merge"), "line").withColumnsRenamed({"line": "later", "text": "b"}).join(keyed.withColumnsRenamed({"line": "a", "text": "a_text"}).hint("merge"), "a")
    x = x.select("later", "words", F.size(F.array_intersect(hashes(F.col("a_text")), hashes(F.col("b")))).alias("both"))
    return x.where(f"{den} * both >= {num} * (words - both)").select("later.*").distinct()


def _texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, v, line_no, line of the lines in ``pairs``."""
    asked = pairs.select(F.explode(F.array("line", "a")).alias("x")).select("x.*").groupBy(*DOC).agg(F.collect_set("line_no").alias("asked"))
    return lines_of(docs.join(asked.hint("merge"), DOC), F.col("asked"))


def removed(docs: DataFrame, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """doc_id, v, line_no of every line with an earlier line of at least this similarity (a fraction). ``docs`` has doc_id, v (together unique) and text, no nulls."""
    num, den = similarity
    here = F.struct(*LINE)
    raw = docs.select(*DOC, F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.btrim("line", F.lit(BLANKS)) != "")
    hashed = cut(raw.select(*LINE, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")))  # lines that differ in blanks alone meet later
    repeated = hashed.groupBy("h1", "h2").agg(F.min(here).alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    equal = cut(hashed.join(repeated.hint("merge"), ["h1", "h2"]).where(here != F.col("first")).select(*LINE))
    copies = equal.groupBy(*DOC).agg(F.collect_list("line_no").alias("copies"))
    others = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.coalesce("copies", F.array().cast("array<int>")))
    done(hashed)
    lines = cut(lines_of(docs.join(copies.hint("merge"), DOC, "left"), others))
    done()

    steps = rarity(lines)
    x = lines.select(*LINE, ordered(hashes(F.col("line")), steps).alias("w"))
    x = x.select(*LINE, F.size("w").alias("n"), "w")
    bits = lambda some: F.expr(f"aggregate({some}, 0L, (s, x) -> s ^ shiftleft(1L, cast(x & 63 as int)))")
    half = lambda k: bits(f"filter(w, x -> x & 64 = {k})")
    x = x.withColumn("sig", F.when(F.col("n") <= LONG, bits("w")).otherwise(half(0))).withColumn("more", F.when(F.col("n") > LONG, half(64)).otherwise(F.lit(0).cast("bigint")))
    x = x.select(*LINE, "n", "sig", "more", F.slice("w", F.lit(1), _prefix(F.col("n"), num, den)).alias("prefix"))
    x = x.withColumn("alone", F.when(F.get("prefix", F.lit(0)) < ALONE, F.size(F.filter("prefix", lambda w: w < ALONE))).otherwise(0))
    prefixes = cut(x.withColumn("prefix", F.slice("prefix", F.col("alone") + 1, F.size("prefix"))))
    done(lines)

    # few lines have a rare word, so all of them meet at once
    posts = _posts(prefixes.withColumn("matched", F.lit(False)))
    rare, common = posts.where(F.col("word") < COMMON), posts.where(F.col("word") >= COMMON)
    met = cut(_pairs(rare, rare, num, den))
    done()

    here, entry, in_order = F.struct(*LINE), F.struct(*LINE, "n", "at", "sig", "more"), Window.partitionBy("word").orderBy(*LINE)
    x = common.withColumn("first", F.first(entry).over(in_order)).withColumn("last", F.lag(entry).over(in_order))
    x = x.select(*LINE, "n", "at", "sig", "more", F.explode(F.array("first", "last")).alias("a")).where(f"a is not null and {_before('a.', '')} and {_may('a.', '', num, den)}")
    x = x.select(here.alias("line"), F.struct(*[F.col(f"a.{c}").alias(c) for c in LINE]).alias("a"), F.expr("n + a.n").alias("words"))
    pairs = cut(met.unionByName(x).distinct())
    done(met)
    texts = cut(_texts(docs, pairs))
    found = cut(_matched(pairs, texts, num, den))
    done(texts)

    # marks go to lines, before these are posted
    marked = cut(prefixes.join(found.withColumn("m", F.lit(True)).hint("merge"), LINE, "left").withColumn("matched", F.col("m").isNotNull()).drop("m"))
    done(prefixes)
    posts = _posts(marked).where(F.col("word") >= COMMON)
    single, matched = posts.where("not matched"), posts.where("matched")
    to_single = cut(_pairs(posts, single, num, den))
    done()  # one meeting's shuffle at a time
    to_matched = cut(_pairs(single, matched, num, den))
    done(marked)
    more = to_single.unionByName(to_matched).distinct()
    more = cut(more.join(pairs.select("line", "a").hint("merge"), ["line", "a"], "left_anti"))
    done(pairs, to_single, to_matched)
    if more.isEmpty():
        return equal.unionByName(found)
    late = cut(_matched(more, _texts(docs, more), num, den))
    done(more)
    return equal.unionByName(found).unionByName(late)


def dedup(docs: DataFrame, similarity: tuple[int, int] = (4, 5), **options) -> DataFrame:
    """``docs`` with text less its removed lines, and the new columns n_lines and n_lines_removed, in place of any such."""
    base = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    once = base.groupBy("doc_id").count().where("count > 1").isEmpty()
    v = F.lit(0).cast("bigint") if once else F.xxhash64("text")
    base = base.withColumn("v", v)
    gone = removed(base if once else base.dropDuplicates(DOC), similarity, **options).groupBy(*DOC).agg(F.collect_set("line_no").alias("__gone")).withColumnRenamed("v", "__v")
    x = docs.drop("n_lines", "n_lines_removed").withColumn("__v", v).join(gone.hint("merge"), ["doc_id", "__v"], "left").withColumn("__lines", F.split("text", "\n"))
    x = x.withColumn("__keep", F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone")))
    x = x.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform("__keep", lambda i: F.get(F.col("__lines"), i)), "\n")))
    x = x.withColumn("n_lines", F.when(F.col("text").isNotNull(), F.size("__lines")).otherwise(0).cast("long")).withColumn("n_lines_removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
    return x.select(*[c for c in docs.columns if c not in ("n_lines", "n_lines_removed")], "n_lines", "n_lines_removed")
