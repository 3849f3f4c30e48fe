"""Approximate nearest neighbours: stable projections, kd-trees, a chi-square stopping test.

Vectors are scaled to length 1, where the largest cosine is the least distance, and projected by m
Gaussian (2-stable) directions: for a pair at distance d the squared projected distance over d**2
follows a chi-square law with m degrees of freedom.  A search takes projected neighbours in order
of projected distance and verifies each on the original vectors.  With the k-th best distance d so
far it stops at projected distance r once chi2_m(r**2 / d**2) >= confidence: a nearer vector still
unseen would project that far with probability at most 1 - confidence (Sun et al., SRS, VLDB 2014).

On Spark: the top of the kd-tree is learnt on a bounded sample of projections; every vector goes to
its cell, crowded cells are cut into blocks, and each block has a kd-tree of its own.  A query
searches its home cell first and then the cells that its bound does not rule out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

PROJECTIONS = 32
CONFIDENCE = 0.95
#: Vectors whose projections shape the top of the tree.
SAMPLE = 8192
#: Vectors of a block, one task's share of the index.
BLOCK = 8192
LEAF = 128
#: Projected neighbours that are verified together, and queries that visit a block together.
STEP = 16
QUERIES = 8192
#: Vector lengths with an index of their own; vectors of all others share one job, a block of one length each.
LENGTHS = 16


def chi_square_quantile(p: float, m: int) -> float:
    """x with P(chi2_m <= x) = p, by bisection on the incomplete gamma series."""
    def below(x: float) -> float:
        a, y = m / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= y / n
            total += term
        return total * math.exp(a * math.log(y) - y - math.lgamma(a))
    lo, hi = 0.0, 10.0 * m + 100
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


@dataclass
class KdTree:
    """Boxes over points: split dimension and value per inner node, in heap order."""

    depth: int
    dim: np.ndarray
    value: np.ndarray

    @classmethod
    def fit(cls, points: np.ndarray, leaves: int) -> KdTree:
        """Median splits on the widest dimension, 2**depth <= leaves boxes of about equal count."""
        depth = max(0, int(math.log2(max(1, leaves))))
        dim, value = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
        level = [np.arange(len(points))]
        for d in range(depth):
            below = []
            for j, own in enumerate(level):
                node = (1 << d) - 1 + j
                x = points[own]
                if len(own):
                    dim[node] = int(np.argmax(x.max(0) - x.min(0)))
                    value[node] = float(np.median(x[:, dim[node]]))
                right = x[:, dim[node]] > value[node] if len(own) else np.zeros(0, bool)
                below += [own[~right], own[right]]
            level = below
        return cls(depth, dim, value)

    def place(self, points: np.ndarray) -> np.ndarray:
        """The box of each point."""
        node = np.zeros(len(points), np.int64)
        for d in range(self.depth):
            heap = (1 << d) - 1 + node
            node = 2 * node + (points[np.arange(len(points)), self.dim[heap]] > self.value[heap])
        return node

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared distance from each point to each box."""
        m = points.shape[1]
        lo, hi = np.full((1, m), -np.inf), np.full((1, m), np.inf)
        for d in range(self.depth):
            heap = (1 << d) - 1 + np.arange(1 << d)
            lo, hi = np.repeat(lo, 2, axis=0), np.repeat(hi, 2, axis=0)
            rows = np.arange(1 << d)
            hi[2 * rows, self.dim[heap]] = np.minimum(hi[2 * rows, self.dim[heap]], self.value[heap])
            lo[2 * rows + 1, self.dim[heap]] = np.maximum(lo[2 * rows + 1, self.dim[heap]], self.value[heap])
        out = np.zeros((len(points), len(lo)))
        for j in range(m):
            x = points[:, j:j + 1]
            gap = np.maximum(np.maximum(lo[None, :, j] - x, x - hi[None, :, j]), 0)
            out += gap * gap
        return out


def projection(dimension: int, m: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng([seed, dimension]).standard_normal((dimension, m))


def _matrix(column: pa.Array | list | pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in column])


def cosines(rows: np.ndarray, norms: np.ndarray, q: np.ndarray, q_norm: float) -> np.ndarray:
    """Cosine of each row with q in double precision, each row summed the same way."""
    return (rows * q).sum(axis=1) / (norms * q_norm)


def search_block(points: np.ndarray, ids: list, queries: np.ndarray, own: list, bounds: np.ndarray, k: int,
                 directions: np.ndarray, quantile: float, verified: list[int] | None = None) -> list[tuple[int, int, float]]:
    """(query row, vec_id, cosine): the k nearest ids found in one block for each query.

    Boxes come in order of their distance, and a box's points in order of their own projected
    distance, as long as the test asks for more.  verified: gets the number of cosines taken.
    ids: ascending ids of each distinct point.  bounds: squared distance within which the query
    already knows k neighbours (inf: none known).
    """
    norms = np.sqrt((points * points).sum(axis=1))
    projected = (points / norms[:, None]) @ directions
    tree = KdTree.fit(projected, max(1, len(points) // LEAF))
    box = tree.place(projected)
    order = np.argsort(box, kind="stable")
    edges = np.searchsorted(box[order], np.arange((1 << tree.depth) + 1))
    points, norms, ids, projected = points[order], norms[order], [ids[i] for i in order], projected[order]
    least = np.array([x[0] for x in ids])
    q_norms = np.sqrt((queries * queries).sum(axis=1))
    q_projected = (queries / q_norms[:, None]) @ directions
    far = tree.distances(q_projected)
    out, taken = [], 0
    for i in range(len(queries)):
        line = np.argsort(far[i], kind="stable")
        best_s, best_at = np.zeros(0), np.zeros(0, np.int64)
        bound = bounds[i]
        for leaf in line:
            if far[i, leaf] > bound * quantile + 1e-9:
                break
            lo, hi = edges[leaf], edges[leaf + 1]
            off = projected[lo:hi] - q_projected[i]
            off = np.einsum("ij,ij->i", off, off)
            near = np.argsort(off, kind="stable")
            for a in range(0, len(near), STEP):
                own_at = near[a:a + STEP]
                own_at = own_at[off[own_at] <= bound * quantile + 1e-9]
                if not len(own_at):
                    break
                own_at = own_at + lo
                taken += len(own_at)
                s = np.concatenate([best_s, cosines(points[own_at], norms[own_at], queries[i], q_norms[i])])
                at = np.concatenate([best_at, own_at])
                top = np.lexsort((least[at], -s))[:k + 1]  # one more: the query itself may be among them
                best_s, best_at = s[top], at[top]
                if len(top) == k + 1:
                    bound = min(bound, max(0.0, 2 - 2 * best_s[-1]))
        found = [(-float(s), v) for s, a in zip(best_s, best_at) for v in ids[a] if v != own[i]]
        out += [(i, v, -s) for s, v in sorted(found)[:k]]
    if verified is not None:
        verified.append(taken)
    return out


def _usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v): finite, complete, non-zero vectors with a key; -0.0 becomes 0.0; repeats merge."""
    v = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (df.select(F.col(key).cast("long").alias(key), v.alias("v"))
            .where(F.col(key).isNotNull() & F.col("v").isNotNull()).where(ok & F.exists("v", lambda x: x != 0))
            .distinct())


def nearest(base: DataFrame, queries: DataFrame, k: int = 5, projections: int = PROJECTIONS,
            confidence: float = CONFIDENCE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found in ``base`` for each row of ``queries``.

    Both have ``key`` and ``vector``; a query finds every vector but those under its own key.
    score: cosine in double precision; ranks by larger score, then smaller key.  Equal vectors are
    one point with its k + 1 least keys, so copies cost nothing and all take part.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
    without a key; rows equal in key and vector count once, and a key with several vectors is
    searched for each of them together (nearest of all).  Vectors are compared with those of the
    same length only.  Fewer candidates than k: all of them.  Empty tables give no rows.
    """
    spark = base.sparkSession
    scratch = Scratch(spark, "neighbours")
    b, q = _usable(base, key, vector), _usable(queries, key, vector)
    copies = Window.partitionBy("v").orderBy(key)
    points = scratch.table(
        b.withColumn("_r", F.row_number().over(copies)).where(F.col("_r") <= k + 1)
        .groupBy("v").agg(F.sort_array(F.collect_list(key)).alias("ids")), "points")
    q = scratch.table(q.withColumnRenamed(key, "query_id"), "queries")
    n = F.size("v")
    common = points.groupBy(n.alias("n")).count().orderBy(F.desc("count"), "n").limit(LENGTHS + 1).collect()
    lengths = [r["n"] for r in common[:LENGTHS]]
    quantile = chi_square_quantile(confidence, projections)
    found = None
    for own in sorted(lengths):
        part = _nearest_of_length(points.where(n == own), q.where(n == own), own, k, projections, quantile, scratch)
        found = part if found is None else found.union(part)
    if len(common) > LENGTHS:
        found = found.union(_nearest_of_rare_lengths(points.where(~n.isin(lengths)), q.where(~n.isin(lengths)), k,
                                                     projections, quantile, scratch))
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _searcher(k: int, m: int, quantile: float):
    """One block of the index and the queries that visit it."""
    def one(p: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(v):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        points = _matrix(p["v"])
        got = search_block(points, [list(x) for x in p["ids"]], _matrix(v["v"]), v["query_id"].tolist(),
                           v["bound"].to_numpy(dtype=float), k, projection(points.shape[1], m), quantile)
        own = v["query_id"].to_numpy()
        return pd.DataFrame({"query_id": [own[i] for i, _, _ in got], "vec_id": [x for _, x, _ in got],
                             "score": [s for _, _, s in got]})
    return one


def _met(index: DataFrame, visits: DataFrame, by: list[str], queries: int, search) -> DataFrame:
    """Each block with its visitors, at most some QUERIES of them at a time."""
    parts = max(1, -(-queries // QUERIES))
    index = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    visits = visits.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    return index.groupBy(*by, "part").cogroup(visits.groupBy(*by, "part")).applyInPandas(
        search, "query_id long, vec_id long, score double")


def _nearest_of_rare_lengths(points: DataFrame, queries: DataFrame, k: int, m: int, quantile: float,
                             scratch: Scratch) -> DataFrame:
    """All vectors of these lengths at once: every block of a length meets that length's queries."""
    n = F.size("v").alias("n")
    sizes = points.groupBy(n).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
    index = points.withColumn("n", n).join(sizes, "n").withColumn("block", F.pmod(F.xxhash64("v"), "blocks"))
    visits = queries.withColumn("n", n).join(sizes, "n").select(
        "query_id", "v", "n", F.lit(float("inf")).alias("bound"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    return scratch.table(_met(index.drop("blocks"), visits, ["n", "block"], queries.count(), _searcher(k, m, quantile)), "rare")


def _nearest_of_length(points: DataFrame, queries: DataFrame, n: int, k: int, m: int, quantile: float,
                       scratch: Scratch) -> DataFrame:
    spark = points.sparkSession
    total, n_queries = points.count(), queries.count()
    sample = _matrix([r["v"] for r in points.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()])
    directions = projection(n, m)
    sample = (sample / np.sqrt((sample * sample).sum(axis=1))[:, None]) @ directions
    top = KdTree.fit(sample, min(-(-total // BLOCK), len(sample) // 64))

    def placed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            if f.num_rows:
                x = _matrix(f.column("v").to_pylist())
                cell = top.place((x / np.sqrt((x * x).sum(axis=1))[:, None]) @ directions)
                yield f.append_column("cell", pa.array(cell))

    cells = points.mapInArrow(placed, "v array<double>, ids array<long>, cell long")
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("c"))
    blocks = scratch.table(sizes.withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("long")).drop("c"), "cells")
    index = scratch.table(
        cells.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks"))).drop("blocks"), "index")

    def search(visits: DataFrame) -> DataFrame:
        """visits: query_id, v, bound, cell."""
        spread = visits.join(blocks, "cell").withColumn(
            "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")

        return _met(index, spread, ["cell", "block"], n_queries, _searcher(k, m, quantile))

    def visited(home: bool):
        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for f in frames:
                if not f.num_rows:
                    continue
                x = _matrix(f.column("v").to_pylist())
                far = top.distances((x / np.sqrt((x * x).sum(axis=1))[:, None]) @ directions)
                bound = np.array(f.column("bound").to_pylist(), dtype=float)
                near = far <= 0 if home else (far > 0) & (far <= bound[:, None] * quantile + 1e-9)
                row, cell = np.nonzero(near)
                yield f.take(pa.array(row)).append_column("cell", pa.array(cell.astype(np.int64)))
        return run

    schema = "query_id long, v array<double>, bound double, cell long"
    start = queries.withColumn("bound", F.lit(float("inf")))
    first = scratch.table(search(start.mapInArrow(visited(True), schema)), "home")
    kth = first.groupBy("query_id").agg(F.sort_array(F.collect_set(F.struct(-F.col("score"), "vec_id"))).alias("s"))
    kth = kth.select("query_id", F.when(F.size("s") >= k, F.greatest(
        F.lit(0.0), F.lit(2.0) + F.lit(2.0) * F.get("s", F.lit(k - 1))["col1"])).alias("known"))
    rest = queries.join(kth, "query_id", "left").select(
        "query_id", "v", F.coalesce("known", F.lit(float("inf"))).alias("bound"))
    second = search(rest.mapInArrow(visited(False), schema))
    return scratch.table(first.union(second), "found")
