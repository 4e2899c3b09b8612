"""Box probabilities, scoring and ranks: adaptive integration, two-sided blocks, ties."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidemark import queries
from tidemark.operators import evaluation, fdr, models, mvlaplace, ordered


def phi(x):
    return np.array([0.5 * math.erfc(-t / math.sqrt(2)) for t in np.ravel(x)]).reshape(np.shape(x))


def equicorrelated(cov_own, cov_between, b, n=4001):
    """P(|X| <= b) where all covariances are equal, by one integral over the shared part."""
    t = np.linspace(-8, 8, n)
    s, o = math.sqrt(cov_between), math.sqrt(cov_own - cov_between)
    f = np.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    for v in b:
        f = f * (phi((v - s * t) / o) - phi((-v - s * t) / o))
    return float(f.sum() * (t[1] - t[0]))


def test_normal_boxes_within_their_tolerance():
    r = np.random.default_rng(1)
    bounds = np.exp(r.normal(-0.5, 1, (40, 5)))
    cov = 0.3 * np.eye(5) + 0.1
    got = mvlaplace.normal_box(cov, bounds)
    want = [equicorrelated(0.4, 0.1, b) for b in bounds]
    assert np.abs(got - want).max() < mvlaplace.TOLERANCE


def test_laplace_boxes_against_a_fine_integral():
    """Within 1e-4 of the same sum with fine integrals, error estimates included; the tail is a bound."""
    r = np.random.default_rng(2)
    cov = 0.02 * np.eye(5) + 0.01
    x = r.choice([0.003, 0.05, 0.2, 0.5, -0.9], (12, 5)) * r.random((12, 1))
    z = mvlaplace.mixing_grid()
    w = np.diff(z) * np.exp(-z[:-1])
    p, error, boxes = mvlaplace.laplace_boxes(x, cov)
    exact, exact_error, more = mvlaplace.laplace_boxes(x, cov, tail=0.0)
    assert error.max() <= mvlaplace.TOLERANCE and more > boxes > len(x)
    for v, a, e in zip(np.abs(x), p, exact):
        normal = equicorrelated(0.03, 0.01, v)
        want = normal if normal > 0.99 else min(1.0, sum(k * equicorrelated(0.03, 0.01, v / math.sqrt(s), 1001) for k, s in zip(w, z[:-1]) if k > 1e-12))
        assert abs(a - want) < 1e-4 and abs(e - want) < 1e-4
    assert (exact - p > -2 * mvlaplace.TOLERANCE).all() and (exact - p < mvlaplace.TAIL + 2 * mvlaplace.TOLERANCE).all()


def test_rows_do_not_depend_on_their_batch():
    r = np.random.default_rng(3)
    x = np.vstack([r.random((30, 5)), np.zeros((1, 5)), np.full((1, 5), 9.0), [[0.1, np.nan, 0, 0, 0]]])
    whole = mvlaplace.laplace_boxes(x, queries.COVARIANCE)[0]
    alone = np.array([mvlaplace.laplace_box(v, queries.COVARIANCE) for v in x])
    assert np.allclose(whole, alone, atol=1e-12, equal_nan=True) and whole[30] == 0 and whole[31] > 0.999 and np.isnan(whole[32])
    assert [len(v) for v in mvlaplace.laplace_boxes(np.zeros((0, 5)), queries.COVARIANCE)[:2]] == [0, 0]


def test_hard_rows_go_on_and_easy_ones_stop():
    easy, hard = np.full((1, 5), 0.01), np.array([[0.9, 0.01, 0.5, 0.02, 0.3]])
    cov = 0.02 * np.eye(5) + 0.08
    _, error, loose = mvlaplace.laplace_boxes(np.vstack([easy, hard]), cov, tolerance=1e-2)
    _, fine_error, more = mvlaplace.laplace_boxes(np.vstack([easy, hard]), cov, tolerance=1e-6)
    assert more > loose and (fine_error < 1e-5).all() and (error <= 1e-2).all()


def test_singular_covariances():
    """A covariance of less rank is a distribution in fewer dimensions."""
    side = lambda v, s=1.0: float(2 * phi(v / s) - 1)
    assert abs(mvlaplace.normal_box(np.ones((3, 3)), np.array([[1.0, 0.5, 2.0]]))[0] - side(0.5)) < 1e-6
    assert abs(mvlaplace.normal_box(np.diag([1.0, 0, 2]), np.array([[1.0, 0.5, 2]]))[0] - side(1) * side(2, math.sqrt(2))) < 1e-4
    a = np.array([[1, 0], [0, 1], [1, 1.0], [1, -1]])  # two variables, their sum and their difference
    t = np.linspace(-6, 6, 24001)
    for b in ([1, 1, 1, 1.0], [0.5, 0.7, 0.3, 2], [2, 1, 5, 0.4]):
        low, high = np.maximum.reduce([-b[1] + 0 * t, -b[2] - t, t - b[3]]), np.minimum.reduce([b[1] + 0 * t, b[2] - t, t + b[3]])
        f = np.where(np.abs(t) <= b[0], np.exp(-t * t / 2) / math.sqrt(2 * math.pi) * np.maximum(phi(high) - phi(low), 0), 0)
        assert abs(mvlaplace.normal_box(a @ a.T, np.array([b]))[0] - f.sum() * (t[1] - t[0])) < 2e-4
    assert mvlaplace.normal_box(np.zeros((3, 3)), np.zeros((1, 3)))[0] == 1
    scaled = np.diag([1e-9, 1.0]) + 1e-6 * (1 - np.eye(2))
    assert 0 < mvlaplace.normal_box(scaled, np.array([[3e-5, 1.0]]))[0] < 1


def test_the_root_gives_the_covariance_back():
    r = np.random.default_rng(5)
    for rank in (2, 5):
        m = r.normal(size=(5, rank))
        cov, b = m @ m.T, r.random((6, 5))
        root, moved, last = mvlaplace.factored(cov, b)
        assert (np.sort(moved, 1) == np.sort(b, 1)).all() and last.max() < rank
        for k in range(6):
            order = [int(np.flatnonzero(b[k] == v)[0]) for v in moved[k]]
            assert np.allclose(root[k] @ root[k].T, cov[np.ix_(order, order)], atol=1e-7)


@pytest.mark.parametrize("p", [1e-6, 0.003, 0.2, 0.5, 0.97, 1 - 1e-6])
def test_quantiles_invert(p):
    assert abs(mvlaplace._cdf(mvlaplace._quantile(np.array([p])))[0] - p) < 1e-7


def test_ties_fill_all_partitions(spark):
    """Nine of ten rows are equal: every range partition has its share, ranks are whole, corrections equal those of the values alone."""
    n = 20_000
    x = spark.range(n).select((F.when(F.col("id") % 10 > 0, 1.0).otherwise(F.col("id") / n)).alias("p"))
    r = ordered.ranked(x, F.col("p"))
    sizes = [q["count"] for q in r.groupBy("part").count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 2 * n / len(sizes)
    ranks = r.select("p", "rank", "m").orderBy("rank").collect()
    assert [q["rank"] for q in ranks] == list(range(1, n + 1)) and {q["m"] for q in ranks} == {n}
    assert all(a["p"] <= b["p"] for a, b in zip(ranks, ranks[1:]))
    got = {q["p"]: q["adj_p"] for q in fdr.adjust(x, "BH").distinct().collect()}
    values = np.sort([q["p"] for q in x.collect()])
    want = np.minimum.accumulate((values * n / np.arange(1, n + 1))[::-1])[::-1]
    assert len(got) == n // 10 + 1 and all(abs(got[v] - min(w, 1)) < 1e-12 for v, w in zip(values, want))


def test_grouped_quantiles(spark):
    """Many keys and one with most rows, nulls among keys and values, against numpy."""
    r = np.random.default_rng(6)
    rows = [(None if k == 3 else int(k), None if r.random() < 0.05 else float(v)) for k, v in zip(np.where(r.random(3000) < 0.8, 7, r.integers(0, 40, 3000)), r.choice([0.0, 1.5, -2.0, 7.25], 3000) + (r.random(3000) < 0.5) * r.random(3000))]
    rows += [(100, None), (101, 4.0), (102, float("inf")), (102, 1.0), (102, 2.0)]
    x = spark.createDataFrame(rows, "k int, v double")
    at = [0.0, 0.25, 0.5, 0.9, 1.0]
    q, ranked = ordered.grouped_quantiles(x, "v", ["k"], at)
    got = {y["k"]: y["q"] for y in q.collect()}
    by = {}
    for k, v in rows:
        by.setdefault(k, []).extend([] if v is None else [v])
    assert got.keys() == by.keys() and got[100] is None
    assert all(np.allclose(got[k], np.quantile(v, at)) for k, v in by.items() if v and k != 102)
    assert got[102][:1] + got[102][2:3] + got[102][4:] == [1.0, 2.0, float("inf")]
    hot = ranked.where("k = 7").groupBy("part").count().collect()
    assert len(hot) >= 3
    five = {y["k"]: y for y in evaluation.five_numbers(x.where("k <> 102"), "v", "k").collect()}
    for k, v in by.items():
        if v and k not in (102, None):
            q1, q2, q3 = np.quantile(v, [0.25, 0.5, 0.75])
            inside = [y for y in v if q1 - 1.5 * (q3 - q1) <= y <= q3 + 1.5 * (q3 - q1)]
            assert np.allclose(list(five[k])[1:], [q1, q2, q3, min(inside), max(inside), len(v) - len(inside)])
    assert five[100]["median"] is None and five[100]["outliers"] == 0
    one = evaluation.five_numbers(x.where("k = 7"), "v").collect()
    assert len(one) == 1 and np.allclose(list(one[0]), list(five[7])[1:])


def test_two_sided_blocks(spark):
    """Repeated keys, uneven blocks and a null key: each row has a score; memory is that of one pair of blocks."""
    r = np.random.default_rng(7)
    model = models.Svr(r.normal(size=(57, 6)), r.normal(size=57), 0.2, 0.4)
    x = r.normal(size=(83, 6))
    keys = [None, *[i // 2 for i in range(82)]]
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, x)], "k int, v array<double>").repartition(3)
    support = spark.createDataFrame([(float(c), s.tolist()) for c, s in zip(model.coef, model.support)], "coef double, sv array<double>")
    got = models.svr_scores_joined(vectors, support, 0.2, 0.4, "k", "v", block=16, rows=10).collect()
    want = sorted(zip(map(repr, keys), model.predict(x)))
    assert np.allclose([s for _, s in want], [s for _, s in sorted((repr(y["k"]), y["score"]) for y in got)])
    empty = models.svr_scores_joined(vectors, support.limit(0), 0.2, 0.4, "k", "v").collect()
    assert len(empty) == 83 and {y["score"] for y in empty} == {-0.4}
    assert models.svr_scores_joined(vectors.limit(0), support, 0.2, 0.4, "k", "v").count() == 0


@pytest.mark.parametrize("mapped", [True, False])
def test_stored_model(spark, mapped, monkeypatch):
    """The model's file gives the model's scores, mapped or read by ranges, whole or in blocks, and travels as a path."""
    import pickle

    from pyarrow import fs

    from tidemark.sources import parts

    r = np.random.default_rng(8)
    center, scale = r.normal(size=4), 1 + r.random(4)
    model = models.Svr(r.normal(size=(101, 4)), r.normal(size=101), 0.2, 0.4, center, scale, 3.0, 2.0, (10,), (1,))
    kept = models.stored(model, spark)
    assert models.stored(kept, spark) is kept and len(pickle.dumps(kept)) < 2000
    if not mapped:
        plain = parts.filesystem
        monkeypatch.setattr(parts, "filesystem", lambda path: (fs.SubTreeFileSystem("/", fs.LocalFileSystem()), plain(path)[1]))
    x = r.normal(size=(30, 4))
    assert np.allclose(kept.predict(x, block=7, rows=4), model.predict(x)) and kept.windows == (10,)
    assert np.allclose(kept.predict(x, dtype=np.float32), model.predict(x), atol=1e-4)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k int, v array<double>")
    got = models.svr_scores(vectors, model, "k", "v", "numpy32").orderBy("k").collect()
    assert np.allclose([y["score"] for y in got], model.predict(x), atol=1e-3)


@pytest.mark.parametrize("broadcast", [True, False])
def test_trees_walked_by_a_recursive_query(spark, broadcast, monkeypatch):
    """Random trees of different depth; rows on a split's border, repeated keys."""
    r = np.random.default_rng(9)
    trees, nodes = 5, 31
    status, var, split, left, right, pred = (np.zeros((trees, nodes)) for _ in range(6))
    for t in range(trees):
        free = 1
        for k in range(nodes):
            if k < free and free + 2 <= nodes and r.random() < (0.9 if k < 3 else 0.5):
                status[t, k], var[t, k], split[t, k], left[t, k], right[t, k] = models.INTERNAL, r.integers(1, 4), r.integers(-2, 3), free + 1, free + 2
                free += 2
            else:
                status[t, k], pred[t, k] = models.LEAF, r.random()
    forest = models.Forest(status.astype(int), var.astype(int), split, left.astype(int), right.astype(int), pred)
    x = r.integers(-3, 4, (60, 3)).astype(float)
    keys = [i // 2 for i in range(60)]
    rows = spark.createDataFrame([(k, *map(float, v)) for k, v in zip(keys, x)], "k int, a double, b double, c double")
    if not broadcast:
        monkeypatch.setattr(models, "BROADCAST", 0)
    assert forest.depth() >= 3
    got = models.forest_scores_walked(rows, forest.table(spark), "k", ["a", "b", "c"], trees, forest.depth()).collect()
    assert np.allclose(sorted((y["k"], y["score"]) for y in got), sorted(zip(keys, forest.predict(x))))
