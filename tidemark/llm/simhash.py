"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming distance, components.

Fingerprints are cut into ``blocks`` runs of bits. Where two differ in at most ``distance``
bits, at least ``blocks - distance`` runs agree, so each fingerprint goes into one bucket for
each such choice of runs, and only buckets are searched. Equal fingerprints are one node,
so exact copies cost nothing. A bucket gives links enough to connect its close members,
never all pairs; one with more than ``bucket_rows`` members is dealt out as pairs of tiles,
so that no task holds more. Components come from alternating large-star and small-star
steps, each written to the shared folder.

Defined results: null or empty text, or one without words, has fingerprint zero, linked
like any other; fewer words than a shingle make one shingle. A row with null doc_id takes
part in links; component_id is the smallest doc_id that isn't null, null if there is none.
Repeated rows get the same answer each.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SMALL, TILE = 64, 1024


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """The signed 64-bit fingerprint of one text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        h = np.array([digest(view[s:e], seed) for s, e in zip(starts[at:to].tolist(), ends[at + k - 1 : to + k - 1].tolist())], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, more: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, ``more``, fp."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t or "", shingle) for t in texts], dtype="int64")

    return docs.select("doc_id", *more, of("text").alias("fp"))


def masks(blocks: int, distance: int) -> list[int]:
    """The signed masks of every choice of blocks - distance runs of bits."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    runs = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    every = [sum(c) for c in itertools.combinations(runs, blocks - distance)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in every]


def _stars(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Each member that isn't the first of its part of one bucket, with that first member."""
    label = np.arange(len(fp))
    while True:
        old = label.copy()
        for a in range(0, len(fp), TILE):
            for b in range(0, len(fp), TILE):
                near = np.bitwise_count(fp[a : a + TILE, None] ^ fp[None, b : b + TILE]) <= distance
                label[a : a + TILE] = np.minimum(label[a : a + TILE], np.where(near, label[None, b : b + TILE], len(fp)).min(1))
        label = label[label]
        if np.array_equal(label, old):
            break
    other = np.flatnonzero(label != np.arange(len(fp)))
    return fp[other], fp[label[other]]


def _links(distance: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Buckets arrive sorted; the last one of a batch waits for the next batch."""
        kept: pd.DataFrame | None = None
        for b in itertools.chain(batches, [None]):
            if b is not None:
                x = b if kept is None else pd.concat([kept, b], ignore_index=True)
            elif kept is None:
                return
            else:
                x = kept
            head = x[["choice", "bucket", "i", "j"]].to_numpy(np.int64)
            new = np.concatenate([[True], (head[1:] != head[:-1]).any(1)])
            first = np.flatnonzero(new)
            if b is not None:
                kept = x.iloc[first[-1] :]
                x, first = x.iloc[: first[-1]], first[:-1]
            if not len(x):
                continue
            fp, group = x["fp"].to_numpy(np.int64).view(np.uint64), np.cumsum(new[: len(x)]) - 1
            size = np.diff(np.concatenate([first, [len(x)]]))
            found = []
            small = np.flatnonzero(size[group] <= SMALL)
            for lag in range(1, SMALL):
                p, q = small[:-lag], small[lag:]
                same = group[p] == group[q]
                if not same.any():
                    break
                p, q = p[same], q[same]
                near = np.bitwise_count(fp[p] ^ fp[q]) <= distance
                found.append((fp[p[near]], fp[q[near]]))
            found += [_stars(fp[first[g] : first[g] + size[g]], distance) for g in np.flatnonzero(size > SMALL)]
            for u, v in found:
                if len(u):
                    yield pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return run


def links(nodes: DataFrame, distance: int = 4, blocks: int = 6, bucket_rows: int = 1 << 15) -> DataFrame:
    """u, v: close pairs of distinct fingerprints that connect whatever is connected. ``nodes`` has fp, each once."""
    each = masks(blocks, distance)
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in each])).alias("choice", "bucket"))
    tiles = F.ceil(F.col("n") / bucket_rows).cast("int")
    large = keyed.groupBy("choice", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows).select("choice", "bucket", tiles.alias("tiles"))
    own: Column = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j")))
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    dealt = keyed.join(large, ["choice", "bucket"], "left").withColumn("p", F.explode(F.when(F.col("tiles").isNull(), one).otherwise(pairs)))
    dealt = dealt.select("choice", "bucket", "p.i", "p.j", "fp").repartition("choice", "bucket", "i", "j").sortWithinPartitions("choice", "bucket", "i", "j", "fp")
    return dealt.mapInPandas(_links(distance), "u long, v long").distinct()


def stars(edges: DataFrame) -> DataFrame:
    """u, v: every node u of ``edges`` that isn't the smallest of its component, with that smallest node v."""
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = cut(small.where("u <> v").distinct())


def rooted(nodes: DataFrame, distance: int, blocks: int) -> DataFrame:
    """``nodes`` (fp, each once, and first) with root, the fingerprint that stands for its component."""
    linked = stars(links(nodes.select("fp"), distance, blocks))
    return nodes.join(linked, nodes["fp"] == linked["u"], "left").select("fp", "first", F.coalesce("v", "fp").alias("root"))


def components(docs: DataFrame, shingle: int = 4, distance: int = 4, blocks: int = 6) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    marked = cut(fingerprints(docs, shingle))
    part = cut(rooted(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), distance, blocks))
    least = part.groupBy("root").agg(F.min("first").alias("component_id"))
    known = part.join(least, "root").select("fp", "component_id")
    return marked.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, distance: int = 4, blocks: int = 6) -> DataFrame:
    """One row of each component with all columns: of its smallest doc_id (null only if it has no other), of several rows with that the one with the least hash.

    Rows are told apart by two 64-bit hashes of all their columns, so null and repeated doc_ids cost no component its row."""
    keys = (F.xxhash64(*docs.columns).alias("__row"), F.xxhash64(F.lit(1), *docs.columns).alias("__row2"))
    row = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__row"), F.col("__row2"))
    nodes = cut(fingerprints(docs, shingle, keys)).groupBy("fp").agg(F.min(row).alias("first"))
    best = rooted(cut(nodes), distance, blocks).groupBy("root").agg(F.min("first").alias("first"))
    kept = best.select(F.col("first.__row").alias("a"), F.col("first.__row2").alias("b"))
    # the join and the last step, which leaves one of equal rows, share one shuffle of the texts
    x = docs.select("*", *keys)
    x = x.join(kept, (x["__row"] == kept["a"]) & (x["__row2"] == kept["b"]), "left_semi")
    return x.dropDuplicates(["__row", "__row2"]).drop("__row", "__row2")
