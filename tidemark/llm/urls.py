"""URL filters: written rules, then trust and distrust propagated over the hosts' link graph.

A rule names a host and the start of a path and holds for the host's subdomains too; the
longest that fits decides. Where none fits, hosts decide: personalised PageRank from the
trusted hosts follows links, distrust from the blocked hosts follows them backwards (who
links to a blocked host shares in it), and a host is blocked if its distrust exceeds its trust
by more than ``margin``. A host is a trusted (blocked) seed if rules allow (block) more than
half of its pages. Hosts that neither reaches are allowed. Links are counted per pair of hosts
before anything is joined, so a hot host is one row per partner.

With ``threshold`` every page that a rule allows (blocks) is a seed of its host, so hosts seed in
proportion to them, and each host decides by its own size: both scores are counted in pages (without
links, just the host's allowed and blocked pages), and a host is blocked if distrust exceeds trust by
more than ``threshold`` of its pages.

Defined results: null url, or one without "://", has empty host and path, fits no rule and
is allowed; null html has no links; links to the own host don't count; repeated rows are judged
each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rules = tuple[tuple[str, str], ...]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def split_rule(rule: str) -> tuple[str, str]:
    host, _, path = rule.partition("/")
    return host, f"/{path}"


def longest_rule(rules: Rules, host: Column, path: Column, what: str) -> Column:
    """The longest fitting rule, or its verdict (``what``: "rule" or "verdict"); null if none fits."""
    out = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        h, p = split_rule(rule)
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        value = F.lit(rule if what == "rule" else verdict)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("string") if out is None else out


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: how many links lead from pages of one host to another host."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""), F.lit(1))
    to = F.regexp_extract(F.col("link"), r"//([^/?#]*)", 1)
    x = pages.where(F.instr(F.coalesce("html", F.lit("")), "//") > 0).select(host_of(F.col("url")).alias("src"), F.explode(links).alias("link"))
    x = x.select("src", F.translate(to, UPPER, LOWER).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return x.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-6) -> tuple[DataFrame, float]:
    """Personalised PageRank along ``edges`` (src, dst, n) from ``seeds`` (host, seed; the seeds sum to 1): host, score, and the
    share of all score that starts at seeds in each round.

    What hosts without links hold starts at seeds again, so the scores sum to 1. Each round is one join and one aggregation over
    hosts, written to the shared folder. It ends when the scores move by less than ``tolerance`` in all, at the latest when
    damping ** rounds is below half of it."""
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    share = cut(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("share")))
    if share.isEmpty() or seeds.isEmpty():
        return seeds.select("host", F.col("seed").alias("score")), 1.0
    start, state = 0.0, cut(seeds.select("host", F.col("seed").alias("flow"), F.lit(0.0).alias("seed")))
    while True:
        zero = F.lit(0.0)
        score = state.select("host", (F.col("flow") + F.lit(start) * F.col("seed")).alias("score"))
        flow = score.join(share, score["host"] == share["src"]).select(F.col("dst").alias("host"), (F.lit(damping) * F.col("score") * F.col("share")).alias("flow"), zero.alias("seed"), zero.alias("old"))
        base = seeds.select("host", zero.alias("flow"), "seed", zero.alias("old"))
        last = state.select("host", zero.alias("flow"), zero.alias("seed"), F.col("flow").alias("old"))
        both = cut(flow.unionByName(base).unionByName(last).groupBy("host").agg(F.sum("flow").alias("flow"), F.sum("seed").alias("seed"), F.sum("old").alias("old")))
        sums = both.agg(F.sum("flow").alias("flow"), F.sum(F.abs(F.col("flow") - F.col("old"))).alias("moved")).first()
        drop(state)
        state, moved, start = both.drop("old"), sums["moved"] + abs(1 - sums["flow"] - start), 1 - sums["flow"]
        state.cut_path = both.cut_path
        if moved < tolerance:
            return state.select("host", (F.col("flow") + F.lit(start) * F.col("seed")).alias("score")), start


def judge(pages: DataFrame, rules: Rules, damping: float = 0.85, margin: float = 0.0, threshold: float | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    url = F.col("url")
    seen = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    seen = seen.withColumn("rule", longest_rule(rules, F.col("host"), F.col("path"), "rule")).withColumn("ruled", longest_rule(rules, F.col("host"), F.col("path"), "verdict"))
    share = lambda verdict: F.avg(F.when(F.col("ruled") == verdict, 1.0).otherwise(0.0)) > 0.5
    count = lambda verdict: F.count_if(F.coalesce(F.col("ruled") == verdict, F.lit(False)))
    each = (lambda v: share(v).cast("long")) if threshold is None else count
    known = cut(seen.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), each("allow").alias("good"), each("block").alias("bad")))
    total = known.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()

    def seeds(column: str) -> DataFrame:
        return known.where(F.col(column) > 0).select("host", (F.col(column) / F.lit(float(max(total[column], 1)))).alias("seed"))

    edges = cut(host_edges(pages.select("url", "html")))
    trust, trust_start = propagate(edges, seeds("good"), damping)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust, distrust_start = propagate(back, seeds("bad"), damping)
    scores = trust.select("host", F.col("score").alias("trust"), F.lit(0.0).alias("distrust")).unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("score").alias("distrust")))
    scores = scores.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    if threshold is None:
        scores = scores.where(F.col("distrust") > F.col("trust") + margin)
    else:  # in pages; hosts without pages decide nothing
        worth = lambda column, n, start: F.col(column) * F.lit(n / start)
        scores = scores.join(known.select("host", "pages"), "host").where(worth("distrust", total["bad"], distrust_start) - worth("trust", total["good"], trust_start) > F.col("pages") * F.lit(threshold))
    blocked = scores.select(F.col("host").alias("blocked"))
    x = seen.join(blocked, F.col("host") == F.col("blocked"), "left")
    verdict = F.coalesce("ruled", F.when(F.col("blocked").isNotNull(), "block").otherwise("allow"))
    return x.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
