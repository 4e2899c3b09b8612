"""Box probabilities of a multivariate Laplace distribution, without randomness.

The distribution is a normal one whose variance is exponentially mixed, so a box's probability is a sum over mixing values of normal
probabilities of scaled boxes. Each normal probability is integrated variable by variable (the narrowest conditional interval
first, variables without variance of their own folded into the interval of the last one they depend on) on a lattice that has eight fixed
shifts. The spread of the shifts' results is the error; rows whose error is too large go on with more points, the others stop.

Everything works on arrays: all rows of an Arrow batch, all their mixing values and all points at once, in pieces of bounded size."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import with_neighbours

SHIFTS, FIRST_POINTS, MOST_POINTS = 8, 16, 4096
#: The error that a row's probability may have, as three standard errors of the shifts' mean; and the mass of mixing values that is left out.
TOLERANCE, TAIL = 5e-5, 1e-6
#: Numbers in an array of the integration.
PIECE = 1 << 20
#: A variable with less than this share of its variance left has none of its own.
RANK = 1e-9


def mixing_grid() -> np.ndarray:
    """The mixing values at which the integral is summed."""
    return np.concatenate([[1e-100], 10.0 ** np.arange(-20, -1), 0.02 + 0.04 * np.arange(25), 1 + 0.2 * np.arange(46), 10.5 + 0.5 * np.arange(180), 10.0 ** np.arange(3, 21), [1e100]])


EDGE, FINE = 8.5, 4000


@lru_cache(1)
def _normal() -> tuple[np.ndarray, np.ndarray]:
    at = np.linspace(-EDGE, EDGE, int(2 * EDGE * FINE) + 1)
    return at, np.array([0.5 * math.erfc(-t / math.sqrt(2)) for t in at])


def _cdf(x: np.ndarray) -> np.ndarray:
    """From a table with even steps: its place is a product, not a search."""
    table = _normal()[1]
    at = np.clip((x + EDGE) * FINE, 0, len(table) - 1)
    k = np.minimum(at.astype(np.int64), len(table) - 2)
    low = table[k]
    return low + (at - k) * (table[k + 1] - low)


@lru_cache(1)
def _places() -> np.ndarray:
    """Where even steps of the probability fall in the table of the normal distribution."""
    return np.interp(np.linspace(0, 1, (1 << 16) + 1), _normal()[1], _normal()[0])


def _quantile(p: np.ndarray) -> np.ndarray:
    """From a table with even steps; in the tails, where those are too wide, by search."""
    table = _places()
    at = np.clip(p, 0, 1) * (len(table) - 1)
    k = np.minimum(at.astype(np.int64), len(table) - 2)
    out = table[k] + (at - k) * (table[k + 1] - table[k])
    far = np.abs(p - 0.5) > 0.498
    if far.any():
        out[far] = np.interp(p[far], _normal()[1], _normal()[0])
    return out


@lru_cache(64)
def _lattice(dims: int, first: int, last: int) -> np.ndarray:
    """Points number ``first`` to ``last`` of a Richtmyer lattice under each shift, folded: (SHIFTS, points, dims)."""
    roots = np.sqrt(np.array([2, 3, 5, 7, 11, 13, 17, 19, 23, 29][:dims], float))
    k = np.arange(first + 1, last + 1)[None, :, None]
    shift = (np.arange(SHIFTS)[:, None] + 0.5) / SHIFTS * np.arange(1, 2 * dims, 2) * math.sqrt(0.5)
    return np.abs(2 * ((k * roots + shift[:, None]) % 1) - 1)


def factored(cov: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each box: a root of the covariance and the bounds, variables reordered, and for each variable the step that settles it.

    Each step takes the variable whose interval, given the expected values so far, holds least probability. A variable that has
    no variance left is settled by the last step it depends on (-1: by none, it is 0)."""
    n, d = bounds.shape
    rows, root = np.arange(n), np.zeros((n, d, d))
    left, b, mean = np.broadcast_to(np.asarray(cov, float), (n, d, d)).copy(), np.array(bounds, float), np.zeros((n, d))
    own = np.maximum(np.diagonal(left, axis1=1, axis2=2).copy(), 0)
    for k in range(d):
        var = np.diagonal(left, axis1=1, axis2=2)[:, k:]
        alive = var > RANK * np.maximum(own[:, k:], 1e-300)
        sd = np.sqrt(np.where(alive, var, 1.0))
        m = np.einsum("nij,nj->ni", root[:, k:, :k], mean[:, :k])
        low, high = _cdf((-b[:, k:] - m) / sd), _cdf((b[:, k:] - m) / sd)
        pick = k + np.where(alive, high - low, 2.0).argmin(1)
        has = alive[rows, pick - k]
        for x in (left, root):  # exchange the variables k and pick
            x[rows, k], x[rows, pick] = x[rows, pick].copy(), x[rows, k].copy()
        left[rows, :, k], left[rows, :, pick] = left[rows, :, pick].copy(), left[rows, :, k].copy()
        for x in (b, own):
            x[rows, k], x[rows, pick] = x[rows, pick].copy(), x[rows, k].copy()
        pivot = np.where(has, np.sqrt(np.where(has, left[rows, k, k], 1.0)), 1.0)
        column = np.where(has[:, None], left[rows, :, k] / pivot[:, None], 0.0)
        column[:, :k] = 0
        root[:, :, k] = column
        left -= column[:, :, None] * column[:, None, :]
        m = np.einsum("nj,nj->n", root[rows, k, :k], mean[:, :k])
        lo, hi = (-b[rows, k] - m) / pivot, (b[rows, k] - m) / pivot
        mass = np.maximum(_cdf(hi) - _cdf(lo), 1e-12)
        density = lambda t: np.exp(-np.minimum(t * t / 2, 700)) / math.sqrt(2 * math.pi)
        mean[:, k] = np.where(has, np.clip((density(lo) - density(hi)) / mass, lo, hi), 0.0)
    root[np.abs(root) < math.sqrt(RANK) * np.sqrt(np.maximum(own, 1e-300))[:, :, None]] = 0
    last = np.where((root != 0).any(2), d - 1 - (root[:, :, ::-1] != 0).argmax(2), -1)
    return root, b, last


def _integrated(root: np.ndarray, b: np.ndarray, last: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The mean over points of each box's integrand, by shift: (boxes, SHIFTS)."""
    n, d = b.shape
    shifts, p, _ = points.shape
    w = points.reshape(shifts * p, -1)
    y, f = [], np.ones((n, shifts * p))
    every = bool((last == np.arange(d)).all())  # the usual case: each variable has variance of its own
    for k in range(d):
        low, high = np.full((n, 1), -np.inf), np.full((n, 1), np.inf)
        for i in [k] if every else range(d):
            here = last[:, i] == k
            if not here.any():
                continue
            slope = np.where(here, root[:, i, k], 1.0)[:, None]
            shift = sum(root[:, i, j][:, None] * y[j] for j in range(k)) if k else 0.0
            ends = (-b[:, i][:, None] - shift) / slope, (b[:, i][:, None] - shift) / slope
            a, c = np.minimum(*ends), np.maximum(*ends)
            low = np.where(here[:, None], np.maximum(low, a), low)
            high = np.where(here[:, None], np.minimum(high, c), high)
        # box and distribution are symmetric, so the first variable's upper half stands for both
        e, g = _cdf(low) if k else np.full((n, 1), 0.5), _cdf(high)
        width = np.maximum(g - e, 0)
        f = f * (width if k else 2 * width)
        if k + 1 < d:
            y.append(_quantile(e + w[None, :, k] * width))
    f[((last < 0) & (b < 0)).any(1)] = 0
    return f.reshape(n, shifts, p).mean(2)


def _bounded(b: np.ndarray, sd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of a symmetric box's probability from its sides alone: the least side above; below, their product or what all misses leave."""
    side = np.where(sd > 0, 2 * _cdf(b / np.where(sd > 0, sd, 1.0)) - 1, 1.0)
    return np.maximum(side.prod(1), 1 - (1 - side).sum(1)), side.min(1)


def laplace_boxes(x: np.ndarray, cov: np.ndarray, tail: float = TAIL, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, int]:
    """P(|X| <= |x|) of each row of x, its error, and how many normal boxes were integrated (each as often as it went on).

    A row's result is the normal's probability if that exceeds 0.99, else the sum over mixing intervals by their left ends. NaN where a
    score is NaN. Intervals whose weights can't add up to more than ``tail`` are left out, so the result is at most that below the exact one (``tail`` 0)."""
    x, cov = np.abs(np.asarray(x, float)), np.asarray(cov, float)
    p, error = np.full(len(x), np.nan), np.full(len(x), np.nan)
    real = np.flatnonzero(~np.isnan(x).any(1))
    z = mixing_grid()
    weight = np.diff(z) * np.exp(-z[:-1])
    use = (weight > 0) & (np.cumsum(weight[::-1])[::-1] > tail)
    sd, one = np.sqrt(np.maximum(np.diag(cov), 0)), np.ones(1)
    p[real], error[real], boxes = _summed(x[real], cov, sd, one, one, tolerance)
    rest = real[p[real] <= 0.99]
    p[rest], error[rest], more = _summed(x[rest], cov, sd, np.sqrt(z[:-1][use]), weight[use], tolerance)
    return np.minimum(p, 1.0), error, boxes + more


def _summed(x: np.ndarray, cov: np.ndarray, sd: np.ndarray, scale: np.ndarray, weight: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray, int]:
    """The weighted sums over scales of the probabilities of x / scale, their errors, and how many boxes were integrated."""
    n, m = len(x), len(scale)
    known, done = np.zeros(n), np.zeros(n)
    if not n:
        return known, done, 0
    root, b, last = factored(cov, x)
    row, col = np.divmod(np.arange(n * m), m)
    low, high = (np.concatenate(v) for v in zip(*(_bounded(x[r] / scale[c][:, None], sd) for r, c in zip(np.array_split(row, max(1, n * m // PIECE)), np.array_split(col, max(1, n * m // PIECE))))))
    sure = (high - low) * weight[col] < 1e-9
    known += np.bincount(row[sure], (high * weight[col])[sure], n)
    row, col = row[~sure], col[~sure]
    sums, points, boxes = np.zeros((n, SHIFTS)), 0, 0
    while len(row):
        more = max(points, FIRST_POINTS)
        lattice = _lattice(max(1, x.shape[1] - 1), points, points + more)
        share = points / (points + more)
        touched = np.zeros((n, SHIFTS))
        at_once = max(1, PIECE // (SHIFTS * more))
        for k in range(0, len(row), at_once):
            r, c = row[k : k + at_once], col[k : k + at_once]
            part = _integrated(root[r], b[r] / scale[c][:, None], last[r], lattice) * weight[c][:, None]
            np.add.at(touched, r, part)
        boxes += len(row)
        points += more
        going = np.zeros(n, bool)
        going[row] = True
        sums[going] = share * sums[going] + (1 - share) * touched[going]
        done[going] = 3 * sums[going].std(1, ddof=1) / math.sqrt(SHIFTS)
        keep = (done[row] > tolerance) & (points < MOST_POINTS)
        row, col = row[keep], col[keep]
    return known + sums.mean(1), done, boxes


def normal_box(cov: np.ndarray, bounds: np.ndarray, tolerance: float = TOLERANCE) -> np.ndarray:
    """P(|X| <= bounds) of each row of bounds, X normal with this covariance."""
    cov, one = np.asarray(cov, float), np.ones(1)
    return _summed(np.asarray(bounds, float), cov, np.sqrt(np.maximum(np.diag(cov), 0)), one, one, tolerance)[0]


def laplace_box(x: np.ndarray, cov: np.ndarray, tail: float = TAIL) -> float:
    """One box of ``laplace_boxes``."""
    return float(laplace_boxes(np.asarray(x, float)[None], cov, tail)[0][0])


def neighbour_p(scored: DataFrame, cov: np.ndarray, tile: int = 1 << 18, tail: float = TAIL, tolerance: float = TOLERANCE) -> DataFrame:
    """chrom, start, p, error: of every run of five neighbouring scores of a chrom, at the position of its third.

    The integral is worked out once for each distinct run of scores."""

    @F.pandas_udf("p double, error double")
    def p(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            inside, error, _ = laplace_boxes(np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(cov))), cov, tail, tolerance)
            yield pd.DataFrame({"p": 1 - inside, "error": error})

    x = with_neighbours(scored.select("chrom", "start", "score"), "chrom", "start", ["score"], tile)
    x = with_neighbours(x.select("chrom", "start", "score", F.col("prev").alias("a"), F.col("next").alias("b")), "chrom", "start", ["a", "b"], tile)
    x = x.where(F.col("prev.a").isNotNull() & F.col("next.b").isNotNull())
    x = x.select("chrom", "start", F.array("prev.a.score", "a.score", "score", "b.score", "next.b.score").alias("five"))
    tasks = 4 * scored.sparkSession.sparkContext.defaultParallelism  # by number: few bytes, but much work a row
    each = x.select("five").repartition(tasks, "five").distinct().withColumn("p", p("five"))
    return x.join(each, "five").select("chrom", "start", "p.p", "p.error")
