"""Scoring: an RBF support-vector regressor and a split forest, each as an Arrow UDF and as plain joins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import fresh_path, kept

# Fixed values of the forest's node table.
INTERNAL, LEAF = -3, -1

#: A forest's node in memory, and how large a node table may be to be broadcast.
NODE_BYTES, BROADCAST = 64, 1 << 28


@dataclass
class Svr:
    """y = sum of coef * exp(-gamma * |x - sv|^2) - rho, on scaled x, then unscaled."""

    support: np.ndarray
    coef: np.ndarray
    gamma: float
    rho: float
    x_center: np.ndarray | float = 0.0
    x_scale: np.ndarray | float = 1.0
    y_center: float = 0.0
    y_scale: float = 1.0
    windows: tuple[int, ...] = (10, 25, 50, 500, 5000)
    halves: tuple[int, ...] = (10, 10, 30, 20, 20)

    def blocks(self, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Support vectors and coefficients, ``block`` of them at a time."""
        for at in range(0, len(self.support), block):
            yield self.support[at : at + block], self.coef[at : at + block]

    def predict(self, x: np.ndarray, block: int = 4096, dtype=np.float64, rows: int = 1024) -> np.ndarray:
        """Rows and support vectors come in blocks, so memory stays at ``rows`` times ``block`` numbers."""
        if len(x) > rows:
            return np.concatenate([self.predict(x[at : at + rows], block, dtype, rows) for at in range(0, len(x), rows)])
        xs = ((np.asarray(x, float) - self.x_center) / self.x_scale).astype(dtype)
        y = np.zeros(len(xs), dtype)
        for sv, coef in self.blocks(block):
            y += kernel_sums(xs, sv.astype(dtype), coef.astype(dtype), self.gamma)
        return (y.astype(float) - self.rho) * self.y_scale + self.y_center


def kernel_sums(x: np.ndarray, sv: np.ndarray, coef: np.ndarray, gamma: float) -> np.ndarray:
    """Of each row of x: the sum of coef * exp(-gamma * |x - sv|^2), by one matrix product."""
    d = (x * x).sum(1)[:, None] + (sv * sv).sum(1) - 2 * (x @ sv.T)
    return np.exp(-gamma * np.maximum(d, 0)) @ coef


@dataclass
class StoredSvr(Svr):
    """A regressor whose support vectors stay in a file of the shared folder; tasks get its path.

    On a folder that is mounted the file is memory-mapped, so the workers of a machine share its pages; elsewhere each block is one
    ranged read. Either way a worker holds one block, however large the model."""

    path: str = ""
    count: int = 0
    width: int = 0

    def blocks(self, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        from pyarrow import fs

        from ..sources.parts import filesystem

        files, inside = filesystem(self.path)
        local = isinstance(files, fs.LocalFileSystem)
        if local:  # a row is a vector and its coefficient
            stored = np.memmap(inside, np.float64, "r", shape=(self.count, self.width + 1))
        else:
            file, size = files.open_input_file(inside), 8 * (self.width + 1)  # bytes of a row
        for at in range(0, self.count, block):
            n = min(block, self.count - at)
            x = stored[at : at + n] if local else np.frombuffer(file.read_at(n * size, at * size)).reshape(n, -1)
            yield x[:, :-1], x[:, -1]


def stored(model: Svr, spark: SparkSession, block: int = 1 << 14) -> StoredSvr:
    """``model`` with its support vectors in a new file of the shared folder, where queries find them as long as the folder is there."""
    from ..sources.parts import filesystem

    if isinstance(model, StoredSvr):
        return model
    path = fresh_path(spark, "svr")
    files, inside = filesystem(path)
    files.create_dir(inside.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(inside) as out:
        for sv, coef in model.blocks(block):
            out.write(np.column_stack([sv, coef]).astype(np.float64).tobytes())
    own = {f.name: getattr(model, f.name) for f in fields(Svr)}
    return StoredSvr(**own | {"support": np.zeros((0, model.support.shape[1])), "coef": np.zeros(0)}, path=path, count=len(model.support), width=model.support.shape[1])


@dataclass
class Forest:
    """Trees as arrays (tree, node): status, variable (from 1), split, daughters (from 1), prediction."""

    status: np.ndarray
    variable: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    prediction: np.ndarray
    names: list[str] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """All rows walk all trees at once, a level a step."""
        x = np.asarray(x, float)
        trees = np.arange(len(self.status))[None, :]
        node = np.zeros((len(x), len(self.status)), np.int64)
        while (walking := self.status[trees, node] == INTERNAL).any():
            value = x[np.arange(len(x))[:, None], self.variable[trees, node] - 1]
            down = np.where(value <= self.split[trees, node], self.left[trees, node], self.right[trees, node]) - 1
            node = np.where(walking, down, node)
        return self.prediction[trees, node].mean(1)

    def depth(self) -> int:
        """The most levels that a row goes down."""
        levels, at = 0, {(t, 0) for t in range(len(self.status))}
        while at:
            levels += 1
            inner = [(t, k) for t, k in at if self.status[t, k] == INTERNAL]
            at = {(t, int(side[t, k]) - 1) for t, k in inner for side in (self.left, self.right)}
        return levels

    def table(self, spark) -> DataFrame:
        """The forest as rows (tree, node, status, var, split, left, right, pred), trees and nodes from 0 and 1."""
        n, m = self.status.shape
        rows = [(t, k + 1, int(self.status[t, k]), int(self.variable[t, k]), float(self.split[t, k]), int(self.left[t, k]), int(self.right[t, k]), float(self.prediction[t, k])) for t in range(n) for k in range(m)]
        return spark.createDataFrame(rows, "tree int, node int, status int, var int, split double, left int, right int, pred double")


class CheckedScorer:
    """A plug point for other backends: the first batch is held against the plain model."""

    def __init__(self, model: Svr, predict, tolerance: float = 1e-4, sample: int = 8):
        self.model, self.run, self.tolerance, self.sample, self.checked = model, predict, tolerance, sample, False

    def predict(self, x: np.ndarray) -> np.ndarray:
        y = self.run(x)
        if not self.checked and len(x):
            want = self.model.predict(x[: self.sample])
            if not np.allclose(y[: self.sample], want, rtol=self.tolerance, atol=self.tolerance):
                raise ValueError("the backend's scores differ from the model's")
            self.checked = True
        return y


def scorer(model: Svr, backend: str = "numpy64"):
    if backend == "numpy64":
        return model
    if backend == "numpy32":
        return CheckedScorer(model, lambda x: model.predict(x, dtype=np.float32), 1e-3)
    raise ValueError(f"unknown backend {backend!r}")


def svr_scores(vectors: DataFrame, model: Svr, key: str, vector: str, backend: str = "numpy64") -> DataFrame:
    """key, score: matrix products over Arrow batches."""
    model = stored(model, vectors.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = scorer(model, backend)
        for b in batches:
            yield pd.Series(s.predict(np.stack(b.to_numpy()))) if len(b) else pd.Series([], dtype=float)

    return vectors.select(key, score(vector).alias("score"))


def svr_scores_joined(vectors: DataFrame, support: DataFrame, gamma: float, rho: float, key: str, vector: str, block: int = 4096, rows: int = 4096) -> DataFrame:
    """The same where the support vectors (sv array, coef) are a table: both sides come in blocks and meet by (row block, vector block).

    Each pair of blocks is one matrix product that leaves a partial sum for each row; the sums meet by row. Pairs are spread evenly over
    tasks, a task holds one pair, and a row is copied once for each block of support vectors, a vector once for each block of rows."""
    # both are written with a number for each row, which later passes find again
    left = kept(vectors.select(F.monotonically_increasing_id().alias("id"), F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("x")))
    right = kept(support.select(F.monotonically_increasing_id().alias("id"), F.col("coef").cast("double").alias("coef"), F.col("sv").cast("array<double>").alias("sv")))
    n_rows, n_vectors = -(-left.count() // rows), -(-right.count() // block)
    if not n_rows or not n_vectors:
        return vectors.select(key, F.lit(-rho).alias("score"))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.withColumn("row_block", dealt(n_rows)).withColumn("vector_block", every(n_vectors))
    right = right.withColumn("vector_block", dealt(n_vectors)).withColumn("row_block", every(n_rows)).drop("id")

    def product(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "part": pa.array([], pa.float64())})
        x, sv = (t[c].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for t, c in ((a, "x"), (b, "sv")))
        coef = b["coef"].to_numpy()
        part = [kernel_sums(x[at : at + 1024], sv, coef, gamma) for at in range(0, len(x), 1024)]
        return pa.table({"id": a["id"], "part": np.concatenate(part)})

    pair = ("row_block", "vector_block")
    # toDF makes the two sides distinct where both come from one table
    sums = left.toDF(*left.columns).groupBy(*pair).cogroup(right.toDF(*right.columns).groupBy(*pair)).applyInArrow(product, "id long, part double")
    sums = sums.groupBy("id").agg((F.sum("part") - rho).alias("score"))
    keys = left.where("vector_block = 0").select("id", "key")
    return keys.join(sums, "id").select(F.col("key").alias(key), "score")


def forest_scores(rows: DataFrame, forest: Forest, key: str, features: list[str]) -> DataFrame:
    """key, score: the mean over trees."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(shared.value.predict(np.column_stack(columns)))

    return rows.select(key, score(*features).alias("score"))


def forest_scores_walked(rows: DataFrame, forest: DataFrame, key: str, features: list[str], trees: int, depth: int) -> DataFrame:
    """The same where the forest is a table (``Forest.table``): a recursive query that goes down one level of all trees a step.

    Rows at leaves take no further step. ``depth`` is the number of levels, ``trees`` how many scores each row's mean is of. A level meets
    the node table by (tree, node), which each row has but one of; rows that share a key are told apart by a number of their own."""
    x = kept(rows.select(F.monotonically_increasing_id().alias("id"), F.col(key).alias("key"), F.array(*[F.col(c).cast("double") for c in features]).alias("x")))
    spark = rows.sparkSession
    hint = "/*+ broadcast(f) */" if forest.count() * NODE_BYTES <= BROADCAST else ""  # else both sides are dealt out by (tree, node)
    # all levels' rows count; the session's limit is for queries that may never end, this one has at most ``depth`` steps
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    walked = spark.sql(
        f"""
        with recursive walk(id, x, tree, node, status, pred, next, level) max recursion level {depth + 1} as (
          select {hint} id, x, f.tree, f.node, f.status, f.pred, if(get(x, f.var - 1) <= f.split, f.left, f.right), 1
          from {{rows}} r join {{forest}} f on f.node = 1
          union all
          select {hint} w.id, w.x, f.tree, f.node, f.status, f.pred, if(get(w.x, f.var - 1) <= f.split, f.left, f.right), w.level + 1
          from walk w join {{forest}} f on f.tree = w.tree and f.node = w.next where w.status = {INTERNAL}
        )
        select id, sum(pred) / {trees} score from walk where status = {LEAF} group by id
        """,
        rows=x.select("id", "x"), forest=forest,
    )
    return x.select("id", "key").join(walked, "id").select(F.col("key").alias(key), "score")
