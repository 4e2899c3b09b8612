"""The signal operators: golden values, plain-numpy checks, and every query against its SQL."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import queries
from tidemark.functions.scalar import laplace_quantile, logistic_scale
from tidemark.operators import calling, fdr, features, intervals, models, mvlaplace, noise, peaks, scan, smoothing
from tidemark.plans import pipeline
from tidemark.sources import sinks, tensors, tracks
from tidemark.streaming.bins import fine_bin_updates

SF = "/root/testdata/sf0.001"
TRACK = "chrom string, start long, end long, value double, strand string"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in "events lineitem orders embeddings documents nation".split():
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9)


def _scored(spark, rows):
    return spark.createDataFrame([("chr1", int(s), int(s) + e, float(v)) for s, e, v in rows], "chrom string, start long, end long, score double")


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_runs(spark, name):
    """Queries beyond SQL; what they are made of has tests of its own."""
    x = queries.QUERIES[name](spark, SF)
    assert x.columns and x.count() > 0


def test_broad_peaks(spark):
    rows = _scored(spark, [(s, 0, 1) for s in (200, 400, 600, 2100, 2300)])
    assert [tuple(r) for r in peaks.broad_peaks(rows).collect()] == [("chr1", 150, 650)]
    assert peaks.broad_peaks(_scored(spark, [(s, 0, 1) for s in (100, 200, 300)])).count() == 0
    assert peaks.broad_peaks(_scored(spark, [(100, 1, float("nan"))])).count() == 0


def test_gap_fill(spark):
    rows = _scored(spark, zip((1000, 1080, 5000, 5300), (1,) * 4, (0.3, 0.25, 0.1, 0.05)))
    assert {r["start"] for r in peaks.gap_fill(rows, 0.2).collect()} == {1030, 1050, 1130}
    assert peaks.gap_fill(rows, 0.9).count() == 0


def test_smoothing(spark):
    def column(f, v, **k):
        x = spark.createDataFrame([(0, i, float(y)) for i, y in enumerate(v)], "k int, i int, y double")
        return [r["o"] for r in f(x, "k", "i", "y", "o", **k).orderBy("i").collect()]

    assert column(smoothing.derivative, [1, 3, 6, 10, 15]) == [2, 2.5, 3.5, 4.5, 5]
    y = [1, 1, 1, 10, 10, 10, 1, 1, 1, 1]
    assert column(smoothing.boxcar, y, width=3) == [0, 1, 4, 7, 10, 7, 4, 1, 1, 0]
    assert column(smoothing.boxcar, y, width=3, progressive_ends=True) == [1, 1, 4, 7, 10, 7, 4, 1, 1, 1]


@pytest.mark.parametrize("n, width", [(12, 6), (12, 7), (5, 8), (9, 3), (2, 5)])
def test_progressive_ends(spark, n, width):
    """Near the ends: the mean of as many rows on either side as there are; at the ends that of two."""
    y = np.random.default_rng(n).random(n)
    half, start = round(width / 2), (width + 1) // 2
    want = []
    for i in range(1, n + 1):
        k = i - 1 if i < start else n - i
        if i < start or i > n - start + 1:
            want.append(y[:2].mean() if i == 1 else y[-2:].mean() if i == n and not i < start else y[max(0, i - 1 - k) : i + k].sum() / (2 * k + 1))
        else:
            want.append(y[i - half : i + width - half].mean() if half <= i <= n - (width - half) else 0.0)
    x = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(y)], "k int, i int, y double")
    got = [r["o"] for r in smoothing.boxcar(x, "k", "i", "y", "o", width, progressive_ends=True).orderBy("i").collect()]
    assert np.allclose(got, want)


def test_noise(spark):
    r = np.random.default_rng(0)
    v = np.concatenate([-np.abs(r.normal(0, 0.1, 500)), [0.0] * 20, r.random(100), [-5.0]])
    rows = _scored(spark, zip(range(0, 10 * len(v), 10), [1] * len(v), v))
    d = np.concatenate([-v[v < 0], -v[v < 0], v[v == 0]])
    sigma = d[d <= 5 * math.sqrt(2) * d.mean()].mean()
    got = noise.min_score_row(rows).first()
    assert math.isclose(got["sigma"], sigma) and math.isclose(got["min_score"], sigma * math.log(1000))
    assert spark.range(1).select(laplace_quantile(F.lit(0.5))).first()[0] == 0
    assert noise.laplace_sigma(rows.where("score > 0")).first()["sigma"] is None
    s = v[2::2]
    starts = np.arange(len(v)) * 10
    cov = {(x["i"], x["j"]): x["cov"] for x in noise.covariance(rows).collect()}
    for k in range(5):
        rho = np.corrcoef(s[k:], s[: len(s) - k])[0, 1] if k else 1.0
        assert math.isclose(cov[0, k], rho * np.var(s[np.abs(s) <= 0.5], ddof=1), rel_tol=1e-9) and cov[0, k] == cov[k, 0]
    assert len(starts) == len(v)


def brute_adjust(p, method):
    """By closed testing or definition, one hypothesis at a time."""
    n, order = len(p), np.argsort(p, kind="stable")
    v = np.array(p)[order]
    h = sum(1 / i for i in range(1, n + 1))
    out = np.empty(n)
    for i in range(n):
        if method in ("BH", "BY"):
            x = min(v[j] * n / (j + 1) for j in range(i, n)) * (h if method == "BY" else 1)
        elif method == "hochberg":
            x = min(v[j] * (n - j) for j in range(i, n))
        elif method == "holm":
            x = max(v[j] * (n - j) for j in range(i + 1))
        elif method == "bonferroni":
            x = v[i] * n
        else:
            from itertools import combinations

            x = max(min(sorted(v[list(c)])[j] * len(c) / (j + 1) for j in range(len(c))) for s in range(1, n + 1) for c in combinations(range(n), s) if i in c)
        out[order[i]] = min(x, 1)
    return out


@pytest.mark.parametrize("method", ["BH", "BY", "holm", "hochberg", "bonferroni", "hommel"])
def test_adjust(spark, method):
    p = [0.01, 0.02, 0.02, 0.3, 0.04, 0.9, 0.011, 0.05]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*p, None, float("nan")])], "id int, p double")
    got = {r["id"]: r["adj_p"] for r in fdr.adjust(rows, method).collect()}
    assert got[8] is None and got[9] is None
    assert np.allclose([got[i] for i in range(8)], brute_adjust(p, method))


def test_laplace_box():
    cov = 0.3 * np.eye(5) + 0.1
    x = np.array([0.8, 0.5, 0.9, 0.3, 0.6])
    assert abs(mvlaplace.normal_box(cov, x[None])[0] - 0.1035147501) < 1e-3
    assert abs(mvlaplace.laplace_box(x, cov) - 0.3308190620) < 1e-3
    assert mvlaplace.laplace_box(np.full(5, 5.0), 0.01 * np.eye(5)) > 0.999
    assert 0 <= mvlaplace.laplace_box(np.full(5, 0.1), np.ones((5, 5))) <= 1
    assert len(mvlaplace.mixing_grid()) == 290


def test_mvlaplace_every_run(spark):
    """Each five neighbours, far out and across tiles, not the first of a window or chrom."""
    r = np.random.default_rng(4)
    rows = [(c, int(s), float(v)) for c, n in (("a", 40), ("b", 5), ("c", 4)) for s, v in zip(np.sort(r.choice(3_000_000, n, False)), r.choice([-0.01, 0.2, 0.9], n))]
    got = {(q["chrom"], q["start"]): q["p"] for q in mvlaplace.neighbour_p(spark.createDataFrame(rows, "chrom string, start long, score double"), queries.COVARIANCE, 100_000).collect()}
    want = {}
    for c in "abc":
        own = [x for x in rows if x[0] == c]
        for i in range(2, len(own) - 2):
            want[c, own[i][1]] = 1 - mvlaplace.laplace_box([x[2] for x in own[i - 2 : i + 3]], queries.COVARIANCE)
    assert len(want) == 37 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_whole_table_queries(spark):
    """Every informative position has features, and every one but two at each end of a chrom a p-value."""
    scored = queries._ev_scored(spark, SF)
    n = {r["chrom"]: r["count"] for r in scored.groupBy("chrom").count().collect()}
    assert max(n.values()) > 20
    assert {r["chrom"]: r["count"] for r in queries.QUERIES["mvlaplace_p"](spark, SF).groupBy("chrom").count().collect()} == {c: k - 4 for c, k in n.items() if k > 4}
    x = queries.QUERIES["logistic_features_all"](spark, SF)
    assert {r["chrom"]: r["count"] for r in x.groupBy("chrom").count().collect()} == {c: 120 * k for c, k in n.items()}
    track = tracks.events_track(spark, SF).toPandas()
    base = track.assign(value=track["value"].abs()).groupby(["chrom", "strand", "start"])["value"].sum()
    far = [r for r in scored.groupBy("chrom").agg(F.max("start").alias("start")).collect()]
    for c, at in [(r["chrom"], r["start"]) for r in far[:2]]:
        own = base[c]
        sums = {k: np.zeros(at + 600) for k in "+-"}
        for (k, s), v in own.items():
            if s < at + 600:
                sums[k][s] += v
        want = features.features_of_center(lambda k, a, b: sums[k][a:b], at, queries.WINDOWS, queries.HALVES)
        got = [r["f"] for r in x.where((F.col("chrom") == c) & (F.col("start") == at)).orderBy("k").collect()]
        assert np.allclose(got, want, atol=1e-8)


def test_features(spark):
    r = np.random.default_rng(1)
    at = np.unique(np.concatenate([r.normal(50_200, 150, 400), r.integers(0, 99_000, 300)]).astype(int))
    rows = [("chr1", int(s), int(s) + int(r.integers(1, 4)), float(r.integers(1, 5)) * (1 if k == "+" else -1), k) for s in at for k in "+-" if r.random() < 0.7]
    rows.append(("chr2", 100, 300, 5.0, "+"))
    base = {}
    for c, s, e, v, k in rows:
        for b in range(s, e):
            base[c, k, b] = base.get((c, k, b), 0) + abs(v)
    windows, halves = (10, 25, 50), (10, 10, 10)
    centers = [("chr1", c) for c in (0, 10, 200, 49_800, 50_000, 50_100, 50_200, 60_000, 99_999)] + [("chr2", 200), ("chr3", 5)]
    x = features.with_features(spark.createDataFrame(centers, "chrom string, start long"), spark.createDataFrame(rows, TRACK), windows, halves, tile=1000)
    got = {(q["chrom"], q["start"]): q["features"] for q in x.collect()}
    assert len(got) == len(centers)
    for c, s in centers:
        want = features.features_of_center(lambda k, a, b: np.array([base.get((c, k, i), 0) for i in range(a, b)]), s, windows, halves)
        assert np.allclose(got[c, s], want, atol=1e-9)
    assert np.allclose(got["chr2", 200][60:], 0.01)


def test_features_of_deep_signal(spark, monkeypatch):
    """Python sees each base's signal once, however many intervals lie there, and the features are those of their sum."""
    track = spark.createDataFrame([("c", 10 * k, 10 * k + 1, float(1 + k % 3), s) for k in range(40) for s in "+-"], TRACK)
    deep = track.crossJoin(spark.range(50)).withColumn("value", F.when(F.col("id") % 2 == 0, F.col("value")).otherwise(-F.col("value"))).drop("id")
    once = track.withColumn("value", F.col("value") * 50)
    at = spark.createDataFrame([("c", 200), ("c", 215)], "chrom string, start long")
    got, want = ({r["start"]: r["features"] for r in features.with_features(at, t, (10, 25), (4, 4)).collect()} for t in (deep, once))
    assert got == want and len(got[200]) == 32 and max(got[215]) > 0.5
    from pyspark.sql.group import GroupedData

    seen, cogroup = [], GroupedData.cogroup
    monkeypatch.setattr(GroupedData, "cogroup", lambda self, other: seen.append(other._df.count()) or cogroup(self, other))
    features.with_features(at, deep, (10, 25), (4, 4))
    assert seen == [40]


def test_scan_rules(spark):
    """A plus-only contig, a tiny one, and one only the minus strand has."""
    rows = [("alone", 100, 300, 5.0, "+"), ("tiny", 0, 10, 9.0, "+"), ("minus", 10, 5000, 9.0, "-"), ("chr1", 1000, 1010, 1.0, "+"), ("chr1", 1020, 1030, -1.0, "-")]
    sizes = spark.createDataFrame([("alone", 5000), ("tiny", 100), ("chr1", 9000)], "chrom string, size long")
    got = {}
    for r in scan.informative_positions(spark.createDataFrame(rows, TRACK), sizes).collect():
        got.setdefault(r["chrom"], set()).add(r["start"])
    assert got["alone"] == {100, 150, 200, 250, 300} and "tiny" not in got and "minus" not in got
    bases = {(k, b): v for c, s, e, v, k in rows if c == "chr1" for b in range(s, e)}
    want = set()
    for width, phases in ((100, range(0, 450, 50)), (1000, range(0, 450, 50))):
        for phase in phases:
            for t in range((9000 - phase) // width):
                a = phase + t * width
                p, m = (sum(bases.get((k, b), 0) for b in range(a, a + width)) for k in "+-")
                if (p + abs(m) > 2) if width == 100 else (p > 0 and abs(m) > 0):
                    want.add(a + width // 2)
    assert got["chr1"] == want


def test_scan_joins_leave_chroms_dealt_out(spark, capsys):
    """No join with the chroms brings a whole chromosome to one task, and sums hold a partition's keys, whichever sizes come along."""
    rows = [(c, 10 * k, 10 * k + 10, 1.0, s) for c in ("a", "b") for k in range(1000) for s in "+-"]
    t = spark.createDataFrame(rows, TRACK)
    sizes = scan.sizes_of(t)
    for x in (scan.fine_bins(t, sizes), scan.tile_sums(t, sizes, 100, 7), scan.or_pass(*scan.surveyed(t)), scan.and_pass(*scan.surveyed(t)), scan.informative_positions(t, sizes)):
        x.explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" not in plan and "hashpartitioning(chrom#" in plan and "REPARTITION_BY_NUM" in plan
    assert sorted(map(tuple, scan.surveyed(t)[0].collect())) == sorted(map(tuple, scan.fine_bins(t, sizes).collect())) == [(c, b, 50.0, 50.0) for c in "ab" for b in range(200)]


def test_models(spark, tmp_path):
    r = np.random.default_rng(0)
    s = models.Svr(r.normal(size=(5, 3)), r.normal(size=5), 0.5, 0.1, np.zeros(3), np.ones(3), -0.3, 2.0, (1,), (1,))
    x = r.normal(size=(7, 3))
    want = [(sum(c * math.exp(-0.5 * ((v - q) ** 2).sum()) for c, v in zip(s.coef, s.support)) - 0.1) * 2 - 0.3 for q in x]
    assert np.allclose(s.predict(x, block=2), want)
    assert np.allclose(models.scorer(s, "numpy32").predict(x), want, atol=1e-3)
    with pytest.raises(ValueError):
        models.CheckedScorer(s, lambda q: s.predict(q) + 1).predict(x)
    for name in ("svr.bin", "svr.bin.zst"):
        tensors.save_svr(f"{tmp_path}/{name}", s)
        assert np.allclose(tensors.load_svr(f"{tmp_path}/{name}").predict(x), want)
    f = queries.demo_forest()
    tensors.save_forest(f"{tmp_path}/forest.bin", f)
    y = np.array([[4.0, 60.0], [6.0, 90.0], [6.0, 110.0]])
    assert np.allclose(tensors.load_forest(f"{tmp_path}/forest.bin").predict(y), [(0.1 + 0.7 + 0.5) / 3, (0.4 + 0.7 + 0.5) / 3, (0.9 + 0.7 + 0.5) / 3])


def _forest(value):
    """One leaf: every valley gets this verdict."""
    one = lambda v, t=int: np.array([[v]], t)
    return models.Forest(one(-1), one(0), one(0.0, float), one(0), one(0), one(value, float))


def test_calling(spark):
    """Two bumps in each of two broad peaks: split by a forest that says so, one summit each if it doesn't."""
    x = np.concatenate([np.arange(0, 2000, 10), np.arange(3000, 5000, 10)])
    y = sum(h * np.exp(-((x - c) ** 2) / (2 * 80**2)) for c, h in ((503, 0.8), (1497, 0.9), (3503, 0.7), (4496, 0.85)))
    dense = _scored(spark, zip(x, [1] * len(x), y)).withColumn("infp", F.lit(1))
    broad = spark.createDataFrame([("chr1", 0, 1990, 0.9), ("chr1", 3000, 4990, 0.85)], "chrom string, start long, end long, max double")
    cov = 0.01 * np.eye(5)
    raw = calling.raw_peaks(dense, broad, 0.05, _forest(1.0), cov).orderBy("start").collect()
    assert [abs(r["smooth_mode"] - c) <= 20 for r, c in zip(raw, (500, 1500, 3500, 4500))] == [True] * 4
    assert all(0 <= r["prob"] < 0.01 for r in raw)
    # the exact way differs by no more than the mass it takes in besides and the errors allowed; counters count what was done
    wide, seen = 0.2 * np.eye(5) + 0.1, {}
    for tail in (0.0, mvlaplace.TAIL):
        done = calling.Counters(spark)
        rows = calling.raw_peaks(dense, broad, 0.05, _forest(1.0), wide, tail=tail, counters=done).collect()
        seen[tail] = [r["prob"] for r in sorted(rows, key=lambda r: r["start"])], done
    (exact, all_of_it), (fast, less) = seen[0.0], seen[mvlaplace.TAIL]
    assert np.abs(np.array(exact) - fast).max() <= mvlaplace.TAIL + 2 * mvlaplace.TOLERANCE and min(fast) > 0.01
    assert all_of_it.tests == less.tests == 4 and all_of_it.boxes > less.boxes > 4
    assert calling.raw_peaks(dense, broad, 0.05, _forest(0.0), cov).count() == 2
    _, kept = calling.call_peaks(dense, broad, 0.05, _forest(1.0), cov=cov)
    assert kept.columns == ["chrom", "start", "end", "score", "prob", "center"] and kept.count() == 4
    narrow = _scored(spark, [(s, 1, 0.2 * math.exp(-((s - 200) ** 2) / 72)) for s in range(0, 400, 10)])
    one = calling.raw_peaks(narrow, spark.createDataFrame([("chr1", 0, 390, 0.2)], "chrom string, start long, end long, max double"), 0.05, _forest(1.0), cov).collect()
    assert len(one) == 1 and one[0]["prob"] == -1
    assert calling.raw_peaks(dense, broad.where("max > 1"), 0.05, _forest(1.0), cov).count() == 0


def test_pipeline(spark, tmp_path):
    """Two strands with a bump: a peak over it, and the files."""
    r = np.random.default_rng(3)
    rows = [("chr1", int(b), int(b) + 1, float(n) * s, k) for k, s, c in (("+", 1, 50_200), ("-", -1, 49_800)) for b, n in zip(*np.unique(np.concatenate([r.normal(c, 150, 800), r.integers(0, 100_000, 1500)]).astype(int), return_counts=True))]
    track = spark.createDataFrame(rows, TRACK)
    sizes = spark.createDataFrame([("chr1", 100_000)], "chrom string, size long")
    windows, halves = (10, 50), (5, 10)
    positions = scan.informative_positions(track, sizes)
    found = features.with_features(positions.where("abs(start - 50000) < 100"), track, windows, halves).collect()
    far = features.with_features(positions.where("start < 20000"), track, windows, halves).limit(200).collect()
    support = np.array([q["features"] for q in found] + [q["features"] for q in far])
    coef = np.concatenate([np.full(len(found), 2.0 / len(found)), np.full(len(far), -1.0 / len(far))])
    svr = models.Svr(support, coef, 0.1, 0.02, windows=windows, halves=halves)
    out = pipeline.run(track, svr, _forest(0.0), sizes, threshold=1.0)
    assert out.min_score > 0 and out.dense.count() >= positions.count()
    assert out.raw.where("start < 50500 and end > 49500").count() >= 1
    n = out.counts
    assert (n["informative"], n["dense"], n["summits"], n["peaks"]) == (positions.count(), out.dense.count(), out.raw.count(), out.peaks.count())
    assert n["p_values"] == out.raw.where("prob <> -1").count() and n["boxes"] >= 0 and n["broad"] >= 1
    paths = sinks.write_outputs(f"{tmp_path}/out", out.dense, out.raw, out.peaks, sizes)
    assert len(paths) in (2, 7)
    back = tracks.bed(spark, paths[1])
    assert back.count() == out.raw.count()
    with pytest.raises(ValueError):
        sinks.write_bed(out.raw, "x.bed")


def test_logistic_scale(spark):
    x = spark.createDataFrame([([0.0, 5.0, 100.0],), ([0.0, 0.0, 0.0],)], "b array<double>").select(logistic_scale(F.col("b")).alias("s")).collect()
    for r, b in zip(x, ([0.0, 5.0, 100.0], [0.0] * 3)):
        assert np.allclose(r["s"], features.logistic(np.array([b]))[0])
    assert np.allclose(x[1]["s"], 0.01) and np.isclose(x[0]["s"][1], 0.5)


def test_stream(spark, tmp_path):
    """Bins of a track that arrives in two files."""
    rows = spark.createDataFrame([("a", 0, 120, 1.0, "+"), ("a", 40, 60, 2.0, "-"), ("b", 10, 11, 3.0, "+"), ("a", 110, 115, 1.0, "+")], TRACK)
    for i in (0, 1):
        rows.where(f"start % 20 = {i} * 10").write.mode("append").parquet(f"{tmp_path}/in")
    stream = fine_bin_updates(spark.readStream.schema(TRACK).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("bins").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["chrom"], r["bin"]): (r["plus"], r["minus"]) for r in spark.table("bins").collect()}
    assert got == {("a", 0): (50, 20), ("a", 1): (50, 20), ("a", 2): (25, 0), ("b", 0): (3, 0)}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_merged_over_tiles(spark):
    """Spans that reach over many tiles, touch, nest and repeat, against one pass in order."""
    r = np.random.default_rng(5)
    rows = [(c, int(s), int(s + n)) for c in "ab" for s, n in zip(r.integers(0, 4000, 150), r.integers(1, 60, 150))] + [("a", 100, 1500), ("a", 100, 1500)]
    for gap in (0, 7):
        want = []
        for c, s, e in sorted(rows):
            if want and want[-1][0] == c and s <= want[-1][2] + gap:
                want[-1][2] = max(want[-1][2], e)
            else:
                want.append([c, s, e])
        got = intervals.merged(spark.createDataFrame(rows, "chrom string, start long, end long"), gap, tile=64).collect()
        assert sorted([x["chrom"], x["start"], x["end"]] for x in got) == want


def test_hommel_with_ties_and_zeros(spark):
    p = np.array([0.0, 0.0, 0.001, 0.01, 0.01, 0.01, 0.02, 0.03, 0.2, 0.2, 0.5, 0.9, 1.0, 1.0])
    m = len(p)
    q = {s: min(s * p[k] / (k + 1 - m + s) for k in range(m - s, m)) for s in range(1, m + 1)}
    want = {v: min(1.0, max(min(s * v, q[s]) for s in q)) for v in p}
    rows = spark.createDataFrame([(float(v),) for v in p] + [(None,), (float("nan"),)], "p double")
    for x in fdr.adjust(rows, "hommel").collect():
        assert x["adj_p"] is None if x["p"] is None or x["p"] != x["p"] else abs(x["adj_p"] - want[x["p"]]) < 1e-12


def test_nan_scores_have_no_p():
    assert np.isnan(mvlaplace.laplace_box(np.array([0.1, np.nan, 0, 0, 0]), np.eye(5)))


def test_scoring_in_blocks(spark):
    r = np.random.default_rng(2)
    model = models.Svr(r.normal(size=(23, 4)), r.normal(size=23), 0.3, 0.1)
    x = r.normal(size=(11, 4))
    assert np.allclose(model.predict(x, block=5, rows=3), model.predict(x))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    support = spark.createDataFrame([(float(c), s.tolist()) for c, s in zip(model.coef, model.support)], "coef double, sv array<double>")
    got = {y["id"]: y["score"] for y in models.svr_scores_joined(vectors, support, 0.3, 0.1, "id", "v", block=5).collect()}
    assert np.allclose([got[i] for i in range(11)], model.predict(x))
