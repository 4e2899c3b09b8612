"""The queries of the signal operators over the test tables, each with its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import calling, evaluation, fdr, features, intervals, models, mvlaplace, noise, peaks, scan, smoothing
from .plans import pipeline
from .sources import sinks, tensors, tracks
from .sources.shared import fresh_path, kept

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

EV = "select event_type chrom, cast(floor(epoch(ts) - epoch(timestamp '2024-01-01')) as bigint) pos, case when user_id % 2 = 0 then '+' else '-' end strand, cast(round(value * 100) as bigint) v from events"
LI = "select l_returnflag chrom, l_orderkey * 1000 + l_linenumber * 10 pos, case when l_linestatus = 'F' then '+' else '-' end strand, cast(l_quantity as bigint) v from lineitem"


def _scan_sql(track: str, depth: int) -> str:
    """CTEs track, sz, fine, por, pand, infp."""
    return f"""track as ({track}),
sz as (select s.chrom, s.size, m.chrom is not null paired from (select chrom, max(pos) + 1 size from track where strand = '+' group by chrom) s
  left join (select distinct chrom from track where strand = '-') m using (chrom) where s.size > 2500),
fine as (select t.chrom, pos // 50 b, coalesce(sum(v) filter (strand = '+'), 0) p, coalesce(sum(v) filter (strand = '-'), 0) m
  from track t join (select chrom, max(pos) + 1 size from track where strand = '+' group by chrom) z using (chrom) where pos // 50 < size // 50 group by all),
por as (select chrom, cast(50 * (s + 1) as bigint) start from (select chrom, s, sum(p) p, sum(m) m from (select chrom, unnest([b, b - 1]) s, p, m from fine) where s >= 0 group by all)
  join sz using (chrom) where case when paired then p + abs(m) else abs(p) end > {depth} and s + 2 <= size // 50),
pand as (select chrom, cast(50 * s + 500 as bigint) start from (select chrom, b - k s, sum(p) p, sum(m) m from fine, range(0, 20) r(k) where b - k >= 0 and (b - k) % 20 <= 8 group by all)
  join sz using (chrom) where paired and p > 0 and abs(m) > 0 and s + 20 <= size // 50),
infp as (select * from por union select * from pand)"""


def _scored_sql(track: str, depth: int) -> str:
    return _scan_sql(track, depth) + """,
scored as (select chrom, start, start + 1 "end", case when h < 500 then -h / 50000.0::double else (h - 500) / 500.0::double end score from (select *, (start // 50 * 7919) % 1000 h from infp))"""


EV_SCAN, LI_SCAN = _scan_sql(EV, 2000), _scan_sql(LI, 2)
EV_SCORED = _scored_sql(EV, 2000)
SIGMA = """,
noise as (select abs(score) d, case when score < 0 then 2 else 1 end n from scored where score <= 0),
sd as (select sqrt(2) * sum(d * n) / sum(n) s from noise),
sig as (select sum(d * n) / sum(n) sigma from noise, sd where not d > 5 * s)"""
BROAD = """,
padded as (select chrom, start - 50 s, "end" + 50 e from scored where score >= 0.05),
marked as (select *, case when s - lag(e) over (partition by chrom order by s) >= 500 then 1 else 0 end k from padded),
runs as (select *, sum(k) over (partition by chrom order by s) g from marked),
broad as (select chrom, min(s) start, max(e) "end" from (select *, max(g) over (partition by chrom) lastg from runs) where g < lastg group by chrom, g having count(*) > 1)"""


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _ev_scored(spark: SparkSession, d: str) -> DataFrame:
    return tracks.proxy_scores(scan.informative_positions(tracks.events_track(spark, d), or_depth=2000))


def _sizes(track: DataFrame) -> DataFrame:
    return scan.sizes_of(track)


@query(f"with {LI_SCAN} select chrom, start, start + 1 \"end\" from infp")
def scan_informative(spark, d):
    return scan.informative_positions(tracks.lineitem_track(spark, d))


@query(f"with {EV_SCAN} select chrom, start, start + 1 \"end\" from infp")
def scan_informative_events(spark, d):
    return scan.informative_positions(tracks.events_track(spark, d), or_depth=2000)


@query(f"with {LI_SCAN} select chrom, b bin, cast(p as bigint) plus, cast(m as bigint) minus from fine")
def scan_fine_bins(spark, d):
    t = tracks.lineitem_track(spark, d)
    return scan.fine_bins(t, _sizes(t))


@query(f"""with track as ({LI}), z as (select chrom, max(pos) + 1 size from track where strand = '+' group by chrom)
select chrom, strand, (pos - 7) // 100 tile, (pos - 7) // 100 * 100 + 7 start, cast(sum(v) as bigint) total from track join z using (chrom)
where pos >= 7 and (pos - 7) // 100 < (size - 7) // 100 group by all""")
def scan_windowed_sum_phase(spark, d):
    t = tracks.lineitem_track(spark, d)
    return scan.tile_sums(t, _sizes(t), 100, 7)


@query(f"with {LI_SCAN} select * from por")
def scan_or_pass(spark, d):
    return scan.or_pass(*scan.surveyed(tracks.lineitem_track(spark, d)))


@query(f"with {LI_SCAN} select * from pand")
def scan_and_pass(spark, d):
    return scan.and_pass(*scan.surveyed(tracks.lineitem_track(spark, d)))


@query(f"with {_scan_sql(EV + " where not (event_type = (select min(event_type) from events) and user_id % 2 <> 0)", 2000)} select chrom, start, start + 1 \"end\" from infp")
def scan_plus_only_contig(spark, d):
    t = tracks.events_track(spark, d)
    alone = t.agg(F.min("chrom")).scalar()
    return scan.informative_positions(t.where(~((F.col("chrom") == alone) & (F.col("strand") == "-"))), or_depth=2000)


@query(f"with {EV_SCAN} select * from (select chrom, start, lead(start) over (partition by chrom order by start) - start gap from infp) where gap is not null")
def gap_lengths(spark, d):
    return peaks.gap_lengths(scan.informative_positions(tracks.events_track(spark, d), or_depth=2000))


@query(f"""with {EV_SCORED}, gaps as (select chrom, start, score, lead(start) over w nstart, lead(score) over w nscore from scored window w as (partition by chrom order by start)),
sides as (select chrom, start base, 1 sign, score s, nstart - start gap from gaps where nstart - start > 50 and score > 0.2
  union all select chrom, nstart, -1, nscore, nstart - start from gaps where nstart - start > 50 and nscore > 0.2),
steps as (select *, cast(case when gap < 500 then floor((gap - 50) / 50.0::double) else ceil((s - 0.2::double) / 0.05::double) end as bigint) r from sides),
cand as (select chrom, base + sign * 50 * k start from (select *, unnest(case when r >= 1 then generate_series(1, r) else generate_series(1, r, -1) end) k from steps))
select distinct chrom, start, start + 1 "end" from cand anti join scored using (chrom, start)""")
def gap_fill(spark, d):
    return peaks.gap_fill(_ev_scored(spark, d), 0.2)


@query(f"with {EV_SCORED}{BROAD} select * from broad")
def broad_peaks(spark, d):
    return peaks.broad_peaks(_ev_scored(spark, d))


@query(f"""with {EV_SCORED}{BROAD} select b.chrom, b.start, b."end", round(min(score), 9) "min", round(max(score), 9) "max", round(avg(score), 9) mean, round(sum(score), 6) "sum",
round(coalesce(stddev_samp(score), 0.0), 9) stdev, count(*) "count" from broad b join scored s on s.chrom = b.chrom and s.start >= b.start and s.start < b."end" group by all""")
def broad_peak_summary(spark, d):
    s = _ev_scored(spark, d)
    x = peaks.summary(s, peaks.broad_peaks(s))
    return x.select("chrom", "start", "end", *[F.round(c, 6 if c == "sum" else 9).alias(c) for c in ("min", "max", "mean", "sum", "stdev")], "count")


@query(f"""with {EV_SCORED}{BROAD}, grid as (select chrom, unnest(list_append(generate_series(start, "end" - 1, 10), "end")) start from broad)
select distinct chrom, start, start + 1 "end" from grid anti join scored using (chrom, start)""")
def densify_grid(spark, d):
    s = _ev_scored(spark, d)
    return peaks.densify_grid(s, peaks.broad_peaks(s))


@query(f"with {EV_SCORED}{SIGMA} select round(sigma, 9) sigma from sig")
def laplace_sigma(spark, d):
    return noise.laplace_sigma(_ev_scored(spark, d)).select(F.round("sigma", 9).alias("sigma"))


@query(f"with {EV_SCORED}{SIGMA} select round(-sigma * ln(2 * (1 - 0.9995::double)), 9) min_score from sig")
def min_score(spark, d):
    return noise.min_score_row(_ev_scored(spark, d)).select(F.round("min_score", 9).alias("min_score"))


@query(f"""with {EV_SCORED} select round(quantile_cont(score, 0.01), 9) q01, round(quantile_cont(score, 0.5), 9) q50, round(quantile_cont(score, 0.99), 9) q99, min(score) "min", max(score) "max" from scored""")
def score_quantiles(spark, d):
    x = noise.quantiles(_ev_scored(spark, d))
    return x.select(*[F.round(c, 9).alias(c) for c in ("q01", "q50", "q99")], "min", "max")


@query(f"with {EV_SCORED} select negative, zero, 2 * negative + zero noise from (select count(*) filter (score < 0) negative, count(*) filter (score = 0) zero from scored)")
def noise_counts(spark, d):
    return noise.noise_counts(_ev_scored(spark, d))


@query(f"""select chrom, pos start, pos + 1 "end", cast(sum(v) as double) "value", strand from ({LI}) group by all""")
def bigwig_round_trip(spark, d):
    """Each strand of the track written as a bigWig file, sizes in its header, and both read back."""
    base = ["chrom", "start", "end", "strand"]
    t = scan.dealt(tracks.lineitem_track(spark, d), *base).groupBy(*base).agg(F.sum("value").alias("value"))
    t, strands = kept(t), []
    for strand in "+-":
        path = fresh_path(spark, "bw")
        sinks.write_bigwig(t.where(F.col("strand") == strand), path, "value", t.groupBy("chrom").agg(F.max("end").alias("size")))
        strands.append(tracks.bigwig(spark, path, strand).join(F.broadcast(tracks.bigwig_sizes(spark, path)), "chrom").where("end <= size"))
    return strands[0].unionByName(strands[1]).select("chrom", "start", "end", "value", "strand")


THINNED = f"""with {EV_SCORED}, lagged as (select chrom, start, score, start - lag(start, 2) over (partition by chrom order by start) g from scored),
thin as (select score, (r + 1) // 2 idx from (select score, row_number() over (order by chrom, start) r from lagged where g = 100) where r % 2 = 1)"""


@query(THINNED + " select k lag, round(corr(a.score, b.score), 9) rho from range(1, 5) t(k) join thin a on true join thin b on b.idx = a.idx - k group by k")
def lag_corr(spark, d):
    return noise.lag_correlations(_ev_scored(spark, d), 100).select(F.col("lag").cast("bigint").alias("lag"), F.round("rho", 9).alias("rho"))


@query(THINNED + " select round(var_samp(score), 9) variance from thin where abs(score) <= 0.5")
def trunc_var(spark, d):
    return noise.truncated_variance(_ev_scored(spark, d), distance=100).select(F.round("variance", 9).alias("variance"))


@query(THINNED + """, rho as (select k, corr(a.score, b.score) r from range(1, 5) t(k) join thin a on true join thin b on b.idx = a.idx - k group by k union all select 0, 1.0)
select cast(i as integer) i, cast(j as integer) j, round(v * r, 9) cov from range(0, 5) x(i), range(0, 5) y(j), rho, (select var_samp(score) v from thin where abs(score) <= 0.5) where k = abs(i - j)""")
def toeplitz(spark, d):
    return noise.covariance(_ev_scored(spark, d), 100).select("i", "j", F.round("cov", 9).alias("cov"))


@query(f"""select chrom, pos start, pos + 1 "end", v::double as value, strand from ({LI}) where chrom = 'A' and pos >= 500000""")
def indexed_bed_range(spark, d):
    """The track written as a BED file in blocks with an index; the rows of a range read back."""
    path = fresh_path(spark, "bed.gz")
    sinks.write_bed(tracks.lineitem_track(spark, d), path)
    return tracks.indexed_bed(spark, path, "chrom string, start bigint, end bigint, value double, strand string").where("chrom = 'A' and start >= 500000")


DENSE_THINNED = f"""with {EV_SCORED}{BROAD}, grid as (select chrom, unnest(list_append(generate_series(start, "end" - 1, 10), "end")) start from broad),
added as (select *, (start // 50 * 7919) % 1000 h from (select distinct chrom, start from grid anti join scored using (chrom, start))),
dense as (select chrom, start, score from scored union all select chrom, start, case when h < 500 then -h / 50000.0::double else (h - 500) / 500.0::double end from added),
lagged as (select chrom, start, score, start - lag(start, 2) over (partition by chrom order by start) g from dense),
thin as (select score, (r + 1) // 2 idx from (select score, row_number() over (order by chrom, start) r from lagged where g = 20) where r % 2 = 1)"""


@query(DENSE_THINNED + """, rho as (select k, corr(a.score, b.score) r from range(1, 5) t(k) join thin a on true join thin b on b.idx = a.idx - k group by k union all select 0, 1.0)
select cast(i as integer) i, cast(j as integer) j, round(v * r, 9) cov from range(0, 5) x(i), range(0, 5) y(j), rho, (select var_samp(score) v from thin where abs(score) <= 0.5) where k = abs(i - j)""")
def toeplitz_dense(spark, d):
    """The covariance at the distance that peak calling uses, over positions densified to every 10 bases of broad peaks."""
    s = kept(_ev_scored(spark, d))
    dense = kept(s.unionByName(tracks.proxy_scores(peaks.densify_grid(s, peaks.broad_peaks(s)))))
    return noise.covariance(dense).select("i", "j", F.round("cov", 9).alias("cov"))


WINDOWS, HALVES = (10, 25, 50), (10, 10, 10)
LAYOUT = models.Svr.windows, models.Svr.halves


def _bins_sql(positions: str, windows, halves, tag: str = "") -> str:
    """CTEs zoom, hit, bins, top: the bins of every position (chrom, start) that hold signal, and each zoom's largest. An empty bin's feature is 0.01."""
    zooms = ", ".join(f"({z}, {w}, {h})" for z, (w, h) in enumerate(zip(windows, halves)))
    far = features.reach(windows, halves)
    return f"""zoom{tag} as (select * from (values {zooms}) z(z, w, hf)),
hit{tag} as (select i.chrom, i.start c, case when strand = '+' then 0 else 1 end o, z, case when pos < i.start then (pos - i.start + w * hf) // w else hf + (pos - i.start - 1) // w end h, abs(v) v
  from {positions} i join track t on t.chrom = i.chrom and t.pos >= i.start - {far} and t.pos <= i.start + {far} join zoom{tag} on pos <> i.start and pos >= i.start - w * hf and pos <= i.start + w * hf),
bins{tag} as (select chrom, c, o, z, h, sum(v)::double x from hit{tag} group by all),
top{tag} as (select chrom, c, o, z, h, 1 / (1 + exp(-ln(99.0::double) / m * (x - m))) f from (select *, case when mx = 0 then 1.0 else 0.05::double * mx end m from (select *, max(x) over (partition by chrom, c, o, z) mx from bins{tag})))"""


def _digest_sql(windows, halves) -> str:
    return f"""with {EV_SCAN}, {_bins_sql('infp', windows, halves)},
held as (select chrom, c, o, z, sum(f) s, sum(f * (h + 1)) t, count(*) n, sum(h + 1) k from top group by all)
select i.chrom, i.start, cast(z.o as integer) strand, z.z zoom, round(coalesce(s, 0) + 0.01::double * (2 * hf - coalesce(n, 0)), 6) total,
  round(coalesce(t, 0) + 0.01::double * (hf * (2 * hf + 1) - coalesce(k, 0)), 6) weighted
from infp i cross join (select * from zoom, range(0, 2) r(o)) z left join held d on d.chrom = i.chrom and d.c = i.start and d.o = z.o and d.z = z.z"""


def _digest(spark, d, windows, halves) -> DataFrame:
    """Of each position's feature vector, by strand and zoom: the sum of its values, and that of each value times its place."""
    t = tracks.events_track(spark, d)
    x = features.with_features(scan.informative_positions(t, or_depth=2000), t, windows, halves)
    at, parts = 0, []
    for strand in (0, 1):
        for zoom, half in enumerate(halves):
            parts.append(F.struct(F.lit(strand).alias("strand"), F.lit(zoom).alias("zoom"), F.slice("features", at + 1, 2 * half).alias("f")))
            at += 2 * half
    x = x.select("chrom", "start", F.explode(F.array(*parts)).alias("p")).select("chrom", "start", "p.*")
    added = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, b: a + b), 6)
    return x.select("chrom", "start", "strand", "zoom", added(F.col("f")).alias("total"), added(F.transform("f", lambda v, i: v * (i + 1))).alias("weighted"))


@query(_digest_sql(WINDOWS, HALVES))
def logistic_features(spark, d):
    return _digest(spark, d, WINDOWS, HALVES)


@query(_digest_sql(*LAYOUT))
def feature_layout(spark, d):
    """All 360 values of the standard layout, at every informative position."""
    return _digest(spark, d, *LAYOUT)


@query(f"""with {EV_SCAN}, {_bins_sql('infp', WINDOWS, HALVES)},
held as (select chrom, c, o * {2 * sum(HALVES)} + z * {2 * HALVES[0]} + h k, f from top)
select i.chrom, i.start, cast(r.k as integer) k, round(coalesce(f, 0.01::double), 9) f from infp i cross join range(0, {4 * sum(HALVES)}) r(k) left join held t on t.chrom = i.chrom and t.c = i.start and t.k = r.k""")
def logistic_features_all(spark, d):
    """Every value of every informative position's features."""
    t = tracks.events_track(spark, d)
    x = features.with_features(scan.informative_positions(t, or_depth=2000), t, WINDOWS, HALVES)
    return x.select("chrom", "start", F.posexplode("features").alias("k", "f")).withColumn("f", F.round("f", 9))


@query(f"with track as ({EV}), per_base as (select chrom, pos, sum(abs(v)) v from track group by all) select chrom, pos start, cast(sum(v) over (partition by chrom order by pos) as bigint) total from per_base")
def prefix_sum(spark, d):
    from .operators.ordered import running_sum

    t = tracks.events_track(spark, d).groupBy("chrom", "start").agg(F.sum(F.abs("value")).alias("value"))
    return running_sum(t, "chrom", "start", "value", "total", 1 << 18).select("chrom", "start", "total")


SVR_SQL = """with sv as (select ((vec_id * 37) % 11 - 5) / 10.0::double coef, embedding::double[] s from embeddings where vec_id < 32)
select vec_id, round(sum(coef * exp(-(list_sum(list_transform(list_zip(e, s), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) / 64.0::double)) - 0.1::double, 6) score from (select vec_id, embedding::double[] e from embeddings), sv group by vec_id"""


def _support(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id < 32")
    return e.select("vec_id", (((F.col("vec_id") * 37) % 11 - 5) / 10.0).alias("coef"), F.col("embedding").cast("array<double>").alias("sv"))


@query(SVR_SQL)
def svr_scores(spark, d):
    rows = _support(spark, d).orderBy("vec_id").collect()  # the model: 32 vectors
    model = models.Svr(np.array([r["sv"] for r in rows]), np.array([r["coef"] for r in rows]), 1 / 64, 0.1)
    return models.svr_scores(spark.read.parquet(f"{d}/embeddings.parquet"), model, "vec_id", "embedding").withColumn("score", F.round("score", 6))


@query(SVR_SQL)
def svr_scores_sql(spark, d):
    x = models.svr_scores_joined(spark.read.parquet(f"{d}/embeddings.parquet"), _support(spark, d).select("coef", "sv"), 1 / 64, 0.1, "vec_id", "embedding")
    return x.withColumn("score", F.round("score", 6))


@query("""with sv as (select ((vec_id * 37) % 11 - 5) / 10.0::double coef, embedding::double[] s from embeddings where vec_id < 32),
x as (select vec_id, list_transform(embedding::double[], lambda v, i: (v - (i - 1) / 640.0::double) / (1 + (i - 1) / 32.0::double)) e from embeddings)
select vec_id, round(3 + 2 * (sum(coef * exp(-(list_sum(list_transform(list_zip(e, s), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) / 64.0::double)) - 0.1::double), 6) score from x, sv group by vec_id""")
def svr_scores_packed(spark, d):
    """A regressor with centers and scales of its own, packed into a compressed model file and loaded from it."""
    rows = _support(spark, d).orderBy("vec_id").collect()  # the model: 32 vectors
    at = np.arange(len(rows[0]["sv"]) if rows else 0)
    path = fresh_path(spark, "svr.zst")
    tensors.save_svr(path, models.Svr(np.array([r["sv"] for r in rows]), np.array([r["coef"] for r in rows]), 1 / 64, 0.1, at / 640, 1 + at / 32, 3.0, 2.0))
    return models.svr_scores(spark.read.parquet(f"{d}/embeddings.parquet"), tensors.load_svr(path), "vec_id", "embedding").withColumn("score", F.round("score", 6))


def demo_forest() -> models.Forest:
    """Three trees of up to five nodes over two variables."""
    return models.Forest(
        np.array([[-3, -1, -3, -1, -1], [-3, -1, -1, 0, 0], [-1, 0, 0, 0, 0]]), np.array([[1, 0, 2, 0, 0], [2, 0, 0, 0, 0], [0, 0, 0, 0, 0]]),
        np.array([[5.0, 0, 100.0, 0, 0], [50.0, 0, 0, 0, 0], [0.0, 0, 0, 0, 0]]), np.array([[2, 0, 4, 0, 0], [2, 0, 0, 0, 0], [0, 0, 0, 0, 0]]),
        np.array([[3, 0, 5, 0, 0], [3, 0, 0, 0, 0], [0, 0, 0, 0, 0]]), np.array([[0, 0.1, 0, 0.4, 0.9], [0, 0.2, 0.7, 0, 0], [0.5, 0, 0, 0, 0]]),
    )


def _forest_values() -> str:
    f = demo_forest()
    return ", ".join(f"({t}, {k + 1}, {f.status[t, k]}, {f.variable[t, k]}, {f.split[t, k]}::double, {f.left[t, k]}, {f.right[t, k]}, {f.prediction[t, k]}::double)" for t in range(3) for k in range(5))


FOREST_SQL = f"""with recursive f as (select * from (values {_forest_values()}) v(tree, node, status, var, split, l, r, pred)),
x as (select event_id, (user_id % 10)::double a, value::double b from events where event_id is not null and value is not null and user_id is not null),
walk as (select event_id, a, b, tree, 1 node from x, (select distinct tree from f) union all
  select event_id, a, b, w.tree, case when (case when var = 1 then a else b end) <= split then l else r end from walk w join f on f.tree = w.tree and f.node = w.node where status = -3)
select event_id, round(avg(pred), 9) score from walk w join f on f.tree = w.tree and f.node = w.node where status = -1 group by event_id"""


def _forest_rows(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").where("event_id is not null and value is not null and user_id is not null")
    return e.select("event_id", (F.col("user_id") % 10).cast("double").alias("a"), F.col("value").cast("double").alias("b"))


@query(FOREST_SQL)
def forest_scores(spark, d):
    return models.forest_scores(_forest_rows(spark, d), demo_forest(), "event_id", ["a", "b"]).withColumn("score", F.round("score", 9))


@query(FOREST_SQL)
def forest_scores_packed(spark, d):
    """The forest packed into a model file and loaded from it."""
    path = fresh_path(spark, "forest")
    tensors.save_forest(path, demo_forest())
    return models.forest_scores(_forest_rows(spark, d), tensors.load_forest(path), "event_id", ["a", "b"]).withColumn("score", F.round("score", 9))


@query(FOREST_SQL)
def forest_scores_sql(spark, d):
    """The walk as a recursive query over the forest's table."""
    f = demo_forest()
    return models.forest_scores_walked(_forest_rows(spark, d), f.table(spark), "event_id", ["a", "b"], len(f.status), f.depth()).withColumn("score", F.round("score", 9))


PROFILE = "profile as (select user_id % 50 k, event_id i, cast(round(value * 100) as bigint)::double y from events)"


def _profile(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select((F.col("user_id") % 50).alias("k"), F.col("event_id").alias("i"), F.round(F.col("value") * 100).cast("bigint").cast("double").alias("y"))


def _boxcar_sql(source: str, column: str, out: str, w: int = 4) -> str:
    h = round(w / 2)
    return f"""{out} as (select k, i, y, case when r >= {h} and r <= n - {w - h} then s / {w} else 0.0 end {out}v from (
  select *, row_number() over (partition by k order by i) r, count(*) over (partition by k) n,
  sum({column}) over (partition by k order by i rows between {h - 1} preceding and {w - h} following) s from {source}))"""


@query(f"with {PROFILE}, {_boxcar_sql('profile', 'y', 'b1')} select k, i, round(b1v, 6) smooth from b1")
def boxcar_smooth(spark, d):
    return smoothing.boxcar(_profile(spark, d), "k", "i", "y", "smooth", 4).select("k", "i", F.round("smooth", 6).alias("smooth"))


@query(f"with {PROFILE}, {_boxcar_sql('profile', 'y', 'b1')}, {_boxcar_sql('b1', 'b1v', 'b2')} select k, i, round(b2v, 6) smooth from b2")
def triangular_smooth(spark, d):
    return smoothing.smooth(_profile(spark, d), "k", "i", "y", "smooth", 4).select("k", "i", F.round("smooth", 6).alias("smooth"))


WIDTHS5 = [round(4 * f) for f in (1.6, 1.4, 1.2, 1.0)]


@query(f"""with {PROFILE}, {_boxcar_sql('profile', 'y', 'b1')}, {_boxcar_sql('b1', 'b1v', 'b2')}, {_boxcar_sql('b2', 'b2v', 'b3')}, {_boxcar_sql('b3', 'b3v', 'b4')},
{_boxcar_sql('profile', 'y', 'w1', WIDTHS5[0])}, {_boxcar_sql('w1', 'w1v', 'w2', WIDTHS5[1])}, {_boxcar_sql('w2', 'w2v', 'w3', WIDTHS5[2])}, {_boxcar_sql('w3', 'w3v', 'w4', WIDTHS5[3])}
select 3 kind, k, i, round(b3v, 6) smooth from b3 union all select 4, k, i, round(b4v, 6) from b4 union all select 5, k, i, round(w4v, 6) from w4""")
def gaussian_smooth(spark, d):
    """The three nearly Gaussian kinds."""
    x = _profile(spark, d)
    out = None
    for kind in (3, 4, 5):
        part = smoothing.smooth(x, "k", "i", "y", "smooth", 4, kind).select(F.lit(kind).alias("kind"), "k", "i", F.round("smooth", 6).alias("smooth"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""with {PROFILE}, {_boxcar_sql('profile', 'y', 'b1', 4)}, {_boxcar_sql('profile', 'y', 'b2', 7)}, {_boxcar_sql('profile', 'y', 'b3', 3)},
n as (select k, i, row_number() over (partition by k order by i) - 1 r, count(*) over (partition by k) n from profile), s as (select *, cast(round_even(n / 3.0::double, 0) as bigint) l from n),
g as (select *, r // l g from s)
select k, i, round(case when g > 2 or (g + 1) * l > n then 0 when g = 0 then b1v when g = 1 then b2v else b3v end, 6) smooth from g join b1 using (k, i) join b2 using (k, i) join b3 using (k, i)""")
def segmented_smooth(spark, d):
    return smoothing.segmented(_profile(spark, d), "k", "i", "y", "smooth", [4, 7, 3]).select("k", "i", F.round("smooth", 6).alias("smooth"))


@query(f"""with track as ({EV}), z as (select distinct chrom from track), ranges as (select chrom, s, s + 600 e from z, (values (-100), (100000), (2591700)) r(s) union all select 'nowhere', 0, 50)
select r.chrom, cast(s as bigint) start, cast(e as bigint) "end", pos, coalesce(v, 0)::double as value from (select *, unnest(generate_series(s::bigint, e - 1)) pos from ranges) r
left join (select chrom, pos, sum(v) v from track where strand = '+' group by all) t using (chrom, pos)""")
def raw_values(spark, d):
    t = tracks.events_track(spark, d)
    z = t.select("chrom").distinct()
    ranges = z.select("chrom", F.explode(F.array(*[F.lit(s).cast("bigint") for s in (-100, 100000, 2591700)])).alias("start")).withColumn("end", F.col("start") + 600)
    ranges = ranges.unionByName(spark.range(1).select(F.lit("nowhere").alias("chrom"), F.lit(0).cast("bigint").alias("start"), F.lit(50).cast("bigint").alias("end")))
    return intervals.raw_values(t.where("strand = '+'"), ranges)


@query(f"with {PROFILE}, n as (select *, lag(y) over w a, lead(y) over w b from profile window w as (partition by k order by i)) select k, i, case when a is null then b - y when b is null then y - a else (b - a) / 2 end slope from n")
def derivative(spark, d):
    return smoothing.derivative(_profile(spark, d), "k", "i", "y", "slope").select("k", "i", "slope")


@query(f"""with {PROFILE}, n as (select *, lag(y) over w a, lead(y) over w b from profile window w as (partition by k order by i)),
s as (select *, case when a is null then b - y when b is null then y - a else (b - a) / 2 end slope from n)
select k, i, y from (select *, lag(slope) over (partition by k order by i) before from s) where slope < 0 and before > 0 and y > 100""")
def local_maxima(spark, d):
    x = smoothing.derivative(_profile(spark, d), "k", "i", "y", "slope")
    return smoothing.local_maxima(x, "k", "i", "y", "slope", 100).select("k", "i", "y")


@query(f"with {PROFILE} select k, i, y from profile qualify row_number() over (partition by k order by y desc, i) <= 5")
def top5_per_peak(spark, d):
    return smoothing.top_by_value(_profile(spark, d), "k", "i", "y")


@query(f"with {PROFILE} select k, i, y from profile qualify row_number() over (partition by k order by y, i) = 1")
def valley_argmin(spark, d):
    return smoothing.valley(_profile(spark, d), "k", "i", "y")


@query(f"with {PROFILE}, r as (select k, y, row_number() over (partition by k order by i) r from profile) select k, cast(round_even(sum(y * r) / sum(y), 0) as bigint) centroid from r group by k")
def centroid(spark, d):
    from pyspark.sql import Window

    x = _profile(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("i")))
    return smoothing.centroid(x, "k", "r", "y")


TESTS = "tests as (select o_orderkey id, ((o_orderkey * 7919) % 10007 + 1) / 10008.0::double p from orders), ranked as (select *, row_number() over (order by p, id) r, count(*) over () m from tests)"


def _tests(spark, d) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("id"), (((F.col("o_orderkey") * 7919) % 10007 + 1) / 10008.0).alias("p"))


def _adjusted(method: str, value: str, frame: str) -> None:
    f = "max" if method == "holm" else "min"
    sql = f"with {TESTS}, h as (select sum(1.0::double / r) h from ranked) select id, round(least({f}({value}) over (order by r {frame}), 1.0), 9) adj_p from ranked, h"

    def run(spark, d, method=method):
        return fdr.adjust(_tests(spark, d), method).select("id", F.round("adj_p", 9).alias("adj_p"))

    run.__name__ = {"BH": "bh_fdr", "BY": "by_fdr"}.get(method, method)
    query(sql)(run)


_adjusted("BH", "p * m / r", "rows between current row and unbounded following")
_adjusted("BY", "p * m / r * h", "rows between current row and unbounded following")
_adjusted("holm", "p * (m - r + 1)", "rows between unbounded preceding and current row")
_adjusted("hochberg", "p * (m - r + 1)", "rows between current row and unbounded following")
_adjusted("bonferroni", "p * m", "rows between current row and current row")


@query(f"""with {TESTS}, s as (select s.r s, min(s.r * k.p / (k.r - k.m + s.r)) q from ranked s join ranked k on k.r > k.m - s.r group by s.r)
select id, round(least(max(least(s * p, q)), 1.0), 9) adj_p from ranked, s group by id""")
def hommel(spark, d):
    return fdr.adjust(_tests(spark, d), "hommel").select("id", F.round("adj_p", 9).alias("adj_p"))


@query(f"with {TESTS} select id, round(p, 9) adj_p from ranked")
def unadjusted(spark, d):
    return fdr.adjust(_tests(spark, d), "none").select("id", F.round("adj_p", 9).alias("adj_p"))


@query(f"""with {TESTS}, a as (select id, p, least(min(p * m / r) over (order by r rows between current row and unbounded following), 1.0) adj from ranked where p > 0),
t as (select o_orderkey id, case when o_orderkey % 10 = 0 then -1.0 else ((o_orderkey * 7919) % 10007 + 1) / 10008.0::double / 50 end p from orders),
r as (select *, row_number() over (order by p, id) r, count(*) over () m from t where p <> -1)
select id, round(adj, 9) adj_p from (select id, least(min(p * m / r) over (order by r rows between current row and unbounded following), 1.0) adj from r) where adj <= 0.019""")
def sig_peaks(spark, d):
    x = _tests(spark, d).withColumn("prob", F.when(F.col("id") % 10 == 0, -1.0).otherwise(F.col("p") / 50))
    return fdr.significant(x, threshold=0.019).select("id", F.round("adj_p", 9).alias("adj_p"))


def _spans(strand: str) -> str:
    return f"""(select chrom, min(s) s, max(e) e from (select *, sum(case when lag_e is null or s > lag_e then 1 else 0 end) over (partition by chrom order by s, e) g from (
  select chrom, pos s, pos + 600 e, max(pos + 600) over (partition by chrom order by pos rows between unbounded preceding and 1 preceding) lag_e from track where strand = '{strand}')) group by chrom, g)"""


@query(f"""with track as ({EV}), a as {_spans('+')}, b as {_spans('-')},
m as (select coalesce(sum(least(a.e, b.e) - greatest(a.s, b.s)), 0) i, count(*) n from a join b on a.chrom = b.chrom and a.s < b.e and b.s < a.e),
u as (select (select sum(e - s) from a) + (select sum(e - s) from b) - i u, i, n from m)
select cast(i as bigint) intersection, cast(u as bigint) "union", round(i / u, 9) jaccard, n n_intersections from u""")
def interval_jaccard(spark, d):
    t = tracks.events_track(spark, d)
    side = lambda s: t.where(F.col("strand") == s).select("chrom", "start", (F.col("start") + 600).alias("end"))
    x = intervals.jaccard(side("+"), side("-"))
    return x.withColumn("jaccard", F.round("jaccard", 9))


@query(f"""with track as ({EV}), steps as (select chrom, pos p, v d from track where v is not null union all select chrom, pos + 600, -v from track where v is not null),
agg as (select chrom, p, sum(d) d from steps group by all), run as (select chrom, p start, lead(p) over w "end", sum(d) over w as value from agg window w as (partition by chrom order by p))
select chrom, start, "end", cast(value as bigint) as value from run where value <> 0 and "end" is not null""")
def track_merge_add(spark, d):
    t = tracks.events_track(spark, d).where("value is not null").withColumn("end", F.col("start") + 600)
    return intervals.merge_add(t.where("strand = '+'"), t.where("strand = '-'"))


PAIRS = f"with {EV_SCORED}, b as (select chrom, start, score * 0.5 + start % 7 / 100.0::double score from scored where start % 3 <> 0), pairs as (select s.chrom, s.start, s.score a, b.score b from scored s join b using (chrom, start))"


def _pairs(spark, d) -> DataFrame:
    s = _ev_scored(spark, d)
    b = s.where(F.col("start") % 3 != 0).withColumn("score", F.col("score") * 0.5 + F.col("start") % 7 / 100.0)
    return evaluation.paired_scores(s, b)


@query(PAIRS + " select chrom, start, round(a, 9) a, round(b, 9) b from pairs")
def paired_scores(spark, d):
    return _pairs(spark, d).select("chrom", "start", F.round("a", 9).alias("a"), F.round("b", 9).alias("b"))


@query(PAIRS + " select count(*) n, round(max(abs(a - b)), 9) max_diff, round(quantile_cont(abs(a - b), 0.5), 9) median_diff, round(corr(a, b), 9) r from pairs")
def score_agreement(spark, d):
    return evaluation.agreement(_pairs(spark, d)).select("n", *[F.round(c, 9).alias(c) for c in ("max_diff", "median_diff", "r")])


@query(PAIRS + " select cast(floor(a / 0.0625::double) as bigint) x, cast(floor(b / 0.0625::double) as bigint) y, count(*) n from pairs group by all")
def score_histogram2d(spark, d):
    return evaluation.histogram2d(_pairs(spark, d), 0.0625)


@query("""with q as (select event_type, quantile_cont(value, 0.25) q1, quantile_cont(value, 0.5) median, quantile_cont(value, 0.75) q3 from events group by event_type),
x as (select event_type, q1, median, q3, value v, value >= q1 - 1.5 * (q3 - q1) and value <= q3 + 1.5 * (q3 - q1) inside from events join q using (event_type))
select event_type, round(q1, 9) q1, round(median, 9) median, round(q3, 9) q3, min(v) filter (inside) low, max(v) filter (inside) high, count(*) filter (not inside) outliers from x group by event_type, x.q1, x.median, x.q3""")
def five_numbers(spark, d):
    x = evaluation.five_numbers(spark.read.parquet(f"{d}/events.parquet"), "value", "event_type")
    return x.select("event_type", *[F.round(c, 9).alias(c) for c in ("q1", "median", "q3")], "low", "high", "outliers")


@query("""with x as (select user_id, event_type, sum(value) v from events group by all), s as (select min(event_type) a, max(event_type) b from events),
r as (select p.v / q.v r from x p join x q using (user_id), s where p.event_type = a and q.event_type = b and q.v <> 0)
select round(quantile_cont(r, 0.5), 9) median, round(min(r), 9) least, round(max(r), 9) greatest, count(*) n from r""")
def paired_ratio(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    ends = e.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b")).first()
    x = e.groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    y = evaluation.paired_ratio(x, "user_id", "event_type", ends["a"], ends["b"], "v")
    return y.select(*[F.round(c, 9).alias(c) for c in ("median", "least", "greatest")], "n")


@query("""select n_name file, case when n_nationkey % 2 = 0 then n_nationkey * 3600.0 else 0.0 end + (n_nationkey + 7) * 60.0 + n_nationkey + 0.25::double wall_seconds,
cast(n_nationkey * 1000 + 12 as bigint) rss_kb from nation""")
def time_logs(spark, d):
    """Reports written as text lines, with and without hours, and read back."""
    n = F.col("n_nationkey")
    hours = F.when(n % 2 == 0, F.concat(n.cast("string"), F.lit(":"))).otherwise("")
    wall = F.concat(F.lit("\tElapsed (wall clock) time (h:mm:ss or m:ss): "), hours, F.lpad((n + 7).cast("string"), 2, "0"), F.lit(":"), F.lpad(n.cast("string"), 2, "0"), F.lit(".25"))
    rss = F.concat(F.lit("\tMaximum resident set size (kbytes): "), (n * 1000 + 12).cast("string"))
    lines = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("file"), F.explode(F.array(wall, rss, F.lit("\tExit status: 0"))).alias("value"))
    return evaluation.time_logs(lines)


def valley_forest() -> models.Forest:
    """One tree over a valley's ten features: deep valleys (the last feature) split, others merge."""
    row = lambda *v, t=int: np.array([v], t)
    return models.Forest(row(-3, -1, -1), row(10, 0, 0), row(0.5, 0, 0, t=float), row(2, 0, 0), row(3, 0, 0), row(0, 0.2, 0.8, t=float))


COVARIANCE = 0.02 * np.eye(5) + 0.01


def _dense(spark, d) -> tuple[DataFrame, DataFrame]:
    s = kept(_ev_scored(spark, d))
    dense = kept(s.unionByName(tracks.proxy_scores(peaks.gap_fill(s, 0.2))))
    return dense, kept(peaks.summary(dense, peaks.broad_peaks(dense)))


def _twice_sql(source: str, column: str, out: str) -> str:
    """CTEs that end in ``out``: ``column`` of profiles (pk) after two boxcars, four wide, or three wide for profiles of four rows."""
    one = lambda v, s, o: f"""{o} as (select *, case when n > 4 and i >= 2 and i <= n - 2 then (lag({v}) over w + {v} + lead({v}) over w + lead({v}, 2) over w) / 4
  when n <= 4 and i >= 2 and i <= n - 1 then (lag({v}) over w + {v} + lead({v}) over w) / 3 else 0.0::double end {o}v from {s} window w as (partition by pk order by i))"""  # noqa: E731
    return f"{one(column, source, out + '_a')},\n{one(out + '_av', out + '_a', out)}"


# valleys that stay: the first two neighbours that both merge become one, until there are none, a join a step
SUMMITS_SQL = EV_SCORED + f""",
gaps as (select chrom, start, score, lead(start) over w nstart, lead(score) over w nscore from scored window w as (partition by chrom order by start)),
sides as (select chrom, start base, 1 sign, score s, nstart - start gap from gaps where nstart - start > 50 and score > 0.2
  union all select chrom, nstart, -1, nscore, nstart - start from gaps where nstart - start > 50 and nscore > 0.2),
steps as (select *, cast(case when gap < 500 then floor((gap - 50) / 50.0::double) else ceil((s - 0.2::double) / 0.05::double) end as bigint) r from sides),
cand as (select chrom, base + sign * 50 * k start from (select *, unnest(case when r >= 1 then generate_series(1, r) else generate_series(1, r, -1) end) k from steps)),
fill as (select *, (start // 50 * 7919) % 1000 h from (select distinct chrom, start from cand anti join scored using (chrom, start))),
dense as (select chrom, start, "end", score from scored union all select chrom, start, start + 1, case when h < 500 then -h / 50000.0::double else (h - 500) / 500.0::double end from fill)
{BROAD.replace("from scored", "from dense")},
members as (select b.chrom, b.start b, s.start x, s.score raw from broad b join dense s on s.chrom = b.chrom and s.start >= b.start and s.start < b."end"),
prof as (select (chrom, b) pk, chrom, x, raw, row_number() over w i, count(*) over (partition by chrom, b) n from members
  window w as (partition by chrom, b order by x) qualify n > 3 and max(raw) over (partition by chrom, b) > 0.05::double),
{_twice_sql('prof', 'raw', 'sm')},
sloped as (select pk, chrom, x, raw, i, n, smv y, case when i = 1 then lead(smv) over w - smv when i = n then smv - lag(smv) over w else (lead(smv) over w - lag(smv) over w) / 2 end slope
  from sm window w as (partition by pk order by i)),
{_twice_sql('sloped', 'slope', 'tn')},
ys as (select pk, chrom, x, raw, i, n, y, tnv < 0 and lag(tnv) over (partition by pk order by i) > 0 and y > 0.05::double top from tn),
tops as (select pk, i lo, lead(i) over (partition by pk order by i) hi from ys where top),
lows as (select t.pk, lo, first(a.y) ya, first(c.y) yb, min((v.y, v.i)) low from tops t join ys a on a.pk = t.pk and a.i = lo join ys c on c.pk = t.pk and c.i = hi
  join ys v on v.pk = t.pk and v.i >= lo and v.i <= hi where hi is not null group by t.pk, lo),
valleys as (select pk, list({{'a': ya, 'b': yb, 'v': low[1], 'at': low[2]}} order by lo) g from lows group by pk),
joined as (select pk, g from valleys union all
  select pk, list_concat(g[: p - 1], [{{'a': g[p].a, 'b': g[p + 1].b, 'v': least(g[p].v, g[p + 1].v), 'at': case when g[p + 1].v <= g[p].v then g[p + 1].at else g[p].at end}}], g[p + 2 :])
  from (select pk, g, list_position(list_transform(range(1, len(g)), lambda k: not split(g[k]) and not split(g[k + 1])), true) p from joined) where p > 0),
final as (select pk, g from joined qualify row_number() over (partition by pk order by len(g)) = 1),
edges as (select pk, unnest(list_concat([1], list_transform(list_filter(g, lambda q: split(q)), lambda q: q.at), [n])) e
  from (select distinct f.pk, coalesce(g, []) g, n from (select distinct pk, n from ys) f left join final using (pk) where f.pk in (select pk from tops))),
parts as (select pk, e lo, lead(e) over (partition by pk order by e) hi from edges),
spans as (select p.pk, lo, min(i) l, max(i) r from parts p join ys using (pk) where hi is not null and i >= lo and i <= hi and y > 0.05::double group by p.pk, lo),
found as (select s.pk, lo, l, r, first(chrom) chrom, min(x) xl, max(x) xr, max(raw) score, arg_max(x, (y, -i)) peak, arg_max(x, (raw, -i)) mode, sum(y * (i - l + 1)) / sum(y) mid
  from spans s join ys using (pk) where i >= l and i <= r group by s.pk, lo, l, r),
sized as (select *, case when peak - xl > 2 * (xr - peak) and xr - peak > 300 then 2 * (xr - peak) else peak - xl end bf from found),
summits as (select chrom, r - l >= 5 tested, score, peak smooth_mode,
  case when r - l < 5 then xl else peak - bf + 10 end start, case when r - l < 5 then xr else peak + case when 2 * bf < xr - peak and bf > 300 then 2 * bf else xr - peak end - 10 end "end",
  case when r - l < 5 then 0 else mode end original_mode, case when r - l < 5 then 0 else cast(round_even(mid / (r - l) * (xr - xl), 0) as bigint) + xl end centroid from sized)"""
SUMMITS_SQL = re.sub(r"split\((\w+(?:\[[^]]*\])?)\)", r"coalesce((least(\1.a, \1.b) - \1.v) / nullif(abs(\1.a - \1.b) + \1.v, 0) > 0.5::double, true)", f"with recursive {SUMMITS_SQL}")


@query(f'{SUMMITS_SQL} select chrom, start, "end", score, tested, smooth_mode, original_mode, centroid from summits')
def summits(spark, d):
    """All summits but for their p-values."""
    return calling.found_summits(*_dense(spark, d), 0.05, valley_forest()).withColumn("tested", F.col("five").isNotNull()).drop("five")


@query()
def summit_p_values(spark, d):
    return calling.raw_peaks(*_dense(spark, d), 0.05, valley_forest(), COVARIANCE).select("chrom", "start", "end", "prob")


@query(f'{SUMMITS_SQL} select chrom, start, "end", score, original_mode center from summits where tested')
def called_peaks(spark, d):
    """Peaks at a threshold that every tested summit meets, but for their p-values."""
    return calling.call_peaks(*_dense(spark, d), 0.05, valley_forest(), threshold=1.0, cov=COVARIANCE)[1].drop("prob")


@query()
def mvlaplace_p(spark, d):
    """P-values of every run of five neighbouring scores of a chrom, at the third of the five."""
    return mvlaplace.neighbour_p(_ev_scored(spark, d), COVARIANCE)


SMALL_LAYOUT = (10, 50), (5, 10)


def _small_svr() -> models.Svr:
    """Eight support vectors of 60 features."""
    e = np.arange(8 * 60, dtype=float).reshape(8, 60)
    return models.Svr((e * 7919 % 101) / 101, (np.arange(8) * 37 % 11 - 5) / 5, 1 / 64, -0.785, y_scale=5.0, windows=SMALL_LAYOUT[0], halves=SMALL_LAYOUT[1])


def _svr_sql(positions: str, out: str) -> str:
    """CTEs that end in ``out`` (chrom, start, end, score): ``positions`` scored by the small regressor. A vector's squared distance is that of a vector of empty bins, and what the held bins change."""
    windows, halves = SMALL_LAYOUT
    first = [2 * sum(halves[:z]) for z in range(len(halves))]
    place = " ".join(f"when {z} then {first[z]}" for z in range(len(halves)))
    return f"""{_bins_sql(positions, windows, halves, out)},
vec{out} as (select chrom, c, o * {2 * sum(halves)} + case z {place} end + h k, f from top{out}),
moved{out} as (select chrom, c, j, sum((f - s) * (f - s) - (0.01::double - s) * (0.01::double - s)) q from vec{out} join sv using (k) group by all),
{out} as (select p.chrom, p.start, p.start + 1 "end", 5 * (sum(coef * exp(-(base + coalesce(q, 0)) / 64.0::double)) + 0.785::double) score
  from {positions} p cross join support left join moved{out} m on m.chrom = p.chrom and m.c = p.start and m.j = support.j group by p.chrom, p.start)"""


PIPELINE_SQL = f"""with {EV_SCAN},
sv as (select j, k, ((j * 60 + k) * 7919 % 101) / 101.0::double s from range(0, 8) a(j), range(0, 60) b(k)),
support as (select j, (j * 37 % 11 - 5) / 5.0::double coef, sum((0.01::double - s) * (0.01::double - s)) base from sv group by j),
{_svr_sql('infp', 'scored')}{SIGMA},
least as (select -sigma * ln(2 * (1 - 0.9995::double)) t from sig),
gaps as (select chrom, start, score, lead(start) over w nstart, lead(score) over w nscore from scored window w as (partition by chrom order by start)),
sides as (select chrom, start base, 1 sign, score s, nstart - start gap from gaps, least where nstart - start > 50 and score > t
  union all select chrom, nstart, -1, nscore, nstart - start from gaps, least where nstart - start > 50 and nscore > t),
steps as (select sides.*, cast(case when gap < 500 then floor((gap - 50) / 50.0::double) else ceil((s - t) / 0.05::double) end as bigint) r from sides, least),
cand as (select chrom, base + sign * 50 * k start from (select *, unnest(case when r >= 1 then generate_series(1, r) else generate_series(1, r, -1) end) k from steps)),
fill as (select distinct chrom, start from cand anti join scored using (chrom, start)),
{_svr_sql('fill', 'filled')},
every as (select chrom, start, "end", score, 1 infp from scored union all select chrom, start, "end", score, 0 from filled){BROAD.replace("from scored", "from every")},
high as (select b.chrom, b.start, b."end" from broad b join every s on s.chrom = b.chrom and s.start >= b.start and s.start < b."end", least group by b.chrom, b.start, b."end", t having max(score) >= t),
grid as (select chrom, unnest(list_append(generate_series(start, "end" - 1, 10), "end")) start from high),
more as (select distinct chrom, start from grid anti join every using (chrom, start)),
{_svr_sql('more', 'added')}
select chrom, start, "end", round(score, 6) score, infp from every union all select chrom, start, "end", round(score, 6), 0 from added where score > 0.05"""


@query(PIPELINE_SQL)
def pipeline_e2e(spark, d):
    """Scan, scores, gap filling and densifying over the events track, through to peaks; its dense positions."""
    x = pipeline.run(tracks.events_track(spark, d), _small_svr(), valley_forest(), threshold=1.0, or_depth=2000).dense
    return x.select("chrom", "start", "end", F.round("score", 6).alias("score"), "infp")
