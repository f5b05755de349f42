"""Nearest neighbours by vantage-point trees, one a shard.

Largest inner product becomes smallest Euclidean distance by one more coordinate: a candidate x gets
``sqrt(M**2 - |x|**2)``, M being its shard's largest norm, a query gets 0.  A node of a tree holds a vantage point and,
for each half of its points, the range of their distances to it.  By the triangle inequality no point of a half is
nearer to a query than the query's distance to the vantage point is to that range; a half is skipped if this bound times
``factor`` is over the query's distance to its k-th best so far.  Factor one is exact search; larger ones skip more.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard and queries of a block (both held in memory by a task), and the least number of shards.
SHARD_ROWS, BLOCK_QUERIES, LEAST_SHARDS = 32_768, 4096, 8
LEAF = 128
#: Relaxation of pruning; recall at this value is measured in the README.
FACTOR = 6.0


class VPTree:
    """A tree over the rows of ``points``; nodes are (vantage row, [(low, high, child or rows) of each half])."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        some = self.points[rows]
        # far from the middle, so that distances spread
        vantage = rows[int(np.argmax(((some - some.mean(0)) ** 2).sum(1)))]
        d = np.sqrt(((some - self.points[vantage]) ** 2).sum(1))
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        parts = []
        for part in (order[:half], order[half:]):
            parts.append((d[part[0]], d[part[-1]], self._build(rows[part])))
        return vantage, parts

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray, int]:
        """(distances, rows) of each query's k nearest found, row -1 where there are fewer; and distances computed."""
        n = len(queries)
        self.q, self.q2, self.p2 = queries, (queries**2).sum(1), (self.points**2).sum(1)
        self.k, self.factor, self.work = k, factor, 0
        self.best, self.found = np.full((n, k), np.inf), np.full((n, k), -1)
        # one descent into the nearer half gives every query a first bound; the walk over all halves starts from it
        self._walk(self.root, np.arange(n), only_near=True)
        self.bound = self.best[:, -1].copy()
        self.best[:], self.found[:] = np.inf, -1
        self._walk(self.root, np.arange(n), only_near=False)
        return self.best, self.found, self.work

    def _walk(self, node, who: np.ndarray, only_near: bool) -> None:
        if isinstance(node, np.ndarray):
            self._leaf(node, who)
            return
        vantage, parts = node
        d = self._distances(who, np.array([vantage]))[:, 0]
        bounds = [np.maximum(0.0, np.maximum(low - d, d - high)) for low, high, _ in parts]
        if only_near:
            near = bounds[0] <= bounds[1]
            groups = [(0, who[near]), (1, who[~near])]
            for i, some in groups:
                if len(some):
                    self._walk(parts[i][2], some, True)
            return
        for i in (0, 1):
            most = np.minimum(self.best[who, -1], self.bound[who])
            some = who[bounds[i] * self.factor <= most]
            if len(some):
                self._walk(parts[i][2], some, False)

    def _distances(self, who: np.ndarray, rows: np.ndarray) -> np.ndarray:
        self.work += len(who) * len(rows)
        d = self.q2[who, None] + self.p2[rows][None] - 2 * (self.q[who] @ self.points[rows].T)
        return np.sqrt(np.maximum(d, 0.0))

    def _leaf(self, rows: np.ndarray, who: np.ndarray) -> None:
        d = self._distances(who, rows)
        better = d.min(1) < self.best[who, -1]
        who, d = who[better], d[better]
        if not len(who):
            return
        d = np.concatenate((self.best[who], d), 1)
        r = np.concatenate((self.found[who], np.broadcast_to(rows, (len(who), len(rows)))), 1)
        take = np.argpartition(d, self.k - 1, 1)[:, : self.k] if d.shape[1] > self.k else np.broadcast_to(np.arange(d.shape[1]), d.shape)
        d, r = np.take_along_axis(d, take, 1), np.take_along_axis(r, take, 1)
        order = np.argsort(d, 1, kind="stable")
        self.best[who], self.found[who] = np.take_along_axis(d, order, 1), np.take_along_axis(r, order, 1)


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def shard_search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query id, id, inner product) of each query's best in a shard, and distances computed.

    Equal vectors are one point of the tree with their smallest ids, so copies cost nothing and ties go to small ids.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    points, of = np.unique(vectors, axis=0, return_inverse=True)
    of = of.reshape(-1)
    by = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[by], np.arange(len(points) + 1))
    norms = (points**2).sum(1)
    top = norms.max()
    tree = VPTree(np.column_stack((points, np.sqrt(np.maximum(top - norms, 0.0)))))
    _, rows, work = tree.search(np.column_stack((queries, np.zeros(len(queries)))), k + 1, factor)
    q, slot = np.nonzero(rows >= 0)
    rows = rows[q, slot]
    scores = np.einsum("ij,ij->i", queries[q], points[rows])
    copies = np.minimum(starts[rows + 1] - starts[rows], k + 1)
    again = np.repeat(np.arange(len(rows)), copies)
    within = np.arange(len(again)) - np.repeat(np.cumsum(copies) - copies, copies)
    own = ids[by[starts[rows[again]] + within]]
    qid, score = query_ids[q[again]], scores[again]
    other = qid != own
    qid, own, score = qid[other], own[other], score[other]
    order = np.lexsort((own, -score, qid))
    qid, own, score = qid[order], own[order], score[order]
    first = np.searchsorted(qid, qid)
    best = np.arange(len(qid)) - first < k
    return qid[best], own[best], score[best], work


def nearest(candidates: DataFrame, queries: DataFrame, k: int = 20, vector: str = "embedding", ident: str = "vec_id", factor: float = FACTOR) -> DataFrame:
    """One row per query and neighbour: query_id, rank (from 1), vec_id, score (inner product in double precision).

    Every valid candidate is indexed and every query visits every shard, in blocks.  Vectors that are null, zero or hold
    null or non-finite components take no part, nor do rows without id; vectors of another length than the query's are
    no candidates; rows with the query's id are its own.  Fewer candidates than ``k`` are all returned (by an exact
    search of shards that small); repeated queries are asked once; other columns are ignored.
    """

    def valid(df: DataFrame) -> DataFrame:
        v = F.col(vector).cast("array<double>")
        good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
        out = df.select(F.col(ident).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null")
        return out.filter(good).withColumn("dim", F.size("v"))

    rows, asked = valid(candidates), valid(queries).dropDuplicates(["id"])
    n, m = rows.count(), asked.count()
    shards, blocks = max(LEAST_SHARDS, math.ceil(n / SHARD_ROWS)), max(1, math.ceil(m / BLOCK_QUERIES))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    keys = ["dim", "shard", "block"]

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            none = np.zeros(0, np.int64)
            q, i, s = none, none, np.zeros(0)
        else:
            q, i, s, _ = shard_search(left["id"].to_numpy(), _matrix(left["v"]), right["id"].to_numpy(), _matrix(right["v"]), k, factor)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})

    found = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", place.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
