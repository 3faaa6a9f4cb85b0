"""Largest inner products by stable projections of few dimensions, indexed by kd-tree.

Vectors are lifted so that nearness is distance: with M the largest norm, x maps to (x, sqrt(M^2 - |x|^2)) and a query q to
(q, 0); the squared distance of the images is M^2 + |q|^2 - 2 q.x. PROJECTED random Gaussian (2-stable) directions map
the images to few dimensions, where the squared distance over the true one is chi-square with as many degrees of freedom.
A kd-tree over the projected points gives leaves in the order of their projected distance from a query, and the points
in them are verified on the original vectors, until the stopping test holds: a point nearer than the K-th best so far
would have shown up with probability CONFIDENCE, as the chi-square distribution at (next projected distance / K-th
distance)^2 is that high.

Every vector is in the index of one bounded shard; every block of queries meets every shard in one bounded group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import store

K, EVERY = 20, 20
PROJECTED, LEAF, CONFIDENCE = 8, 256, 0.99
#: Rows of an index shard and of a query block.
SHARD_ROWS, BLOCK_ROWS = 32768, 8192
FOUND_SCHEMA = "query_id long, vec_id long, score double"


def chi_square_cdf(x: np.ndarray, dof: int) -> np.ndarray:
    """For an even number of degrees of freedom: 1 - exp(-x/2) * sum of (x/2)^i / i!."""
    half = np.minimum(np.asarray(x, dtype=np.float64) / 2, 700.0)
    return 1 - np.exp(-half) * sum(half**i / math.factorial(i) for i in range(dof // 2))


def kd_leaves(points: np.ndarray, most: int = LEAF) -> list[np.ndarray]:
    """Row numbers of each leaf: splits at the median of the widest dimension."""
    leaves, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            leaves.append(rows)
            continue
        here = points[rows]
        order = np.argpartition(here[:, np.argmax(here.max(axis=0) - here.min(axis=0))], len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return leaves


class Index:
    """One shard: distinct vectors with the k + 1 smallest ids of each, their projections, and the kd-tree's leaves and boxes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, dims: int, seed: int):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order]) + np.float64(0)  # -0.0 and 0.0 are one value
        keys = vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1])))[:, 0]
        _, first, copy = np.unique(keys, return_index=True, return_inverse=True)
        by = np.argsort(copy, kind="stable")
        starts = np.searchsorted(copy[by], np.arange(len(first) + 1))
        self.ids = [ids[by[a : min(b, a + k + 1)]] for a, b in zip(starts[:-1], starts[1:])]
        self.weight = np.array([len(x) for x in self.ids])
        self.vectors = vectors[first]
        squares = (self.vectors**2).sum(axis=1)
        self.top = squares.max()
        lifted = np.column_stack([self.vectors, np.sqrt(np.maximum(0, self.top - squares))])
        self.directions = np.random.default_rng(seed).standard_normal((lifted.shape[1], dims))
        points = lifted @ self.directions
        leaves = kd_leaves(points)
        self.order = np.concatenate(leaves)
        self.bounds = np.cumsum([0, *map(len, leaves)])
        self.sorted = self.vectors[self.order]
        self.low, self.high = np.stack([points[x].min(axis=0) for x in leaves]), np.stack([points[x].max(axis=0) for x in leaves])

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, confidence: float):
        """(query row, distinct vector row) candidates that hold each query's k best ids, all that the test lets be verified."""
        dims, n = self.directions.shape[1], len(queries)
        points = np.column_stack([queries, np.zeros(n)]) @ self.directions
        near = np.zeros((n, len(self.low)))
        for d in range(dims):
            gap = np.maximum(0, np.maximum(self.low[None, :, d] - points[:, d, None], points[:, d, None] - self.high[None, :, d]))
            near += gap**2
        turn = np.argsort(near, axis=1, kind="stable")
        base = self.top + (queries**2).sum(axis=1)
        keep = k + 1  # one may be the query itself; a distinct vector stands for one id at least
        best = np.full((n, keep), -np.inf)
        rows = np.full((n, keep), -1, dtype=np.int64)
        active = np.arange(n)
        for step in range(len(self.low)):
            bound = near[active, turn[active, step]]
            distance = np.maximum(base[active] - 2 * best[active, -1], 1e-300)
            ratio = np.where(np.isfinite(distance), bound / distance, 0)
            active = active[chi_square_cdf(ratio, dims) < confidence]
            if not len(active):
                break
            leaf = turn[active, step]
            grouped = np.argsort(leaf, kind="stable")
            cuts = np.flatnonzero(np.diff(leaf[grouped])) + 1
            for part in np.split(grouped, cuts):
                which, a, b = active[part], self.bounds[leaf[part[0]]], self.bounds[leaf[part[0]] + 1]
                scores = queries[which] @ self.sorted[a:b].T
                all_scores = np.concatenate([best[which], scores], axis=1)
                all_rows = np.concatenate([rows[which], np.broadcast_to(self.order[a:b], scores.shape)], axis=1)
                top = np.argpartition(-all_scores, keep - 1, axis=1)[:, :keep] if all_scores.shape[1] > keep else np.broadcast_to(np.arange(all_scores.shape[1]), all_scores.shape)
                got, where = np.take_along_axis(all_scores, top, 1), np.take_along_axis(all_rows, top, 1)
                order = np.argsort(-got, axis=1, kind="stable")
                best[which, : got.shape[1]] = np.take_along_axis(got, order, 1)
                rows[which, : got.shape[1]] = np.take_along_axis(where, order, 1)
        q, c = np.nonzero(rows >= 0)
        return q, rows[q, c]


def search_shard(ids, vectors, query_ids, queries, k, confidence, dims, seed):
    """query_id, vec_id, score arrays: of each query, the k best ids that are found in the shard."""
    index = Index(ids, vectors, k, dims, seed)
    q, row = index.search(queries, query_ids, k, confidence)
    # One order of summation for every pair, so that equal vectors have equal scores in every shard.
    score = np.concatenate([(queries[q[a : a + 65536]] * index.vectors[row[a : a + 65536]]).sum(axis=1) for a in range(0, len(q), 65536)]) if len(q) else np.zeros(0)
    n = index.weight[row]
    each = np.repeat(np.arange(len(q)), n)
    found = np.concatenate([index.ids[r] for r in row]) if len(row) else np.zeros(0, dtype=np.int64)
    q, score = q[each], score[each]
    other = found != query_ids[q]
    q, score, found = q[other], score[other], found[other]
    order = np.lexsort((found, -score, q))
    q, score, found = q[order], score[order], found[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    top = rank < k
    return query_ids[q[top]], found[top], score[top]


def usable(vectors: DataFrame) -> DataFrame:
    """Vectors that take part: id and components known, all finite, not all zero."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(~bad & some)


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, confidence: float = CONFIDENCE, dims: int = PROJECTED, seed: int = 3) -> DataFrame:
    """Of each row whose vec_id is divisible by `every`, the k rows of largest inner product: query_id, rank, vec_id, score.

    Rows with an unusable vector or a null id take no part. Vectors of another length than a query are no candidates of
    it. Rows that repeat an id are one candidate each if their vectors differ, and one if not; a query id asks once for each
    of its distinct vectors' best. Ties go to the smaller vec_id. No vectors, no rows.
    """
    part = store(usable(vectors).distinct())
    n = part.count()
    asks = part.where(F.col("vec_id") % every == 0)
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-n // every // BLOCK_ROWS))
    shard, block = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(shards)).cast("int"), F.pmod(F.xxhash64("vec_id", F.lit(seed + 1)), F.lit(blocks)).cast("int")
    length = F.size("embedding").alias("length")
    kept = part.select("vec_id", "embedding", length, shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = asks.select("vec_id", "embedding", length, block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not len(candidates) or not len(queries):
            return schema.empty_table()
        width = candidates["length"][0].as_py()
        matrix = lambda t: t["embedding"].combine_chunks().flatten().to_numpy().reshape(-1, width)
        got = search_shard(candidates["vec_id"].to_numpy(), matrix(candidates), queries["vec_id"].to_numpy(), matrix(queries), k, confidence, dims, seed)
        return pa.table([pa.array(x) for x in got], schema=schema)

    keys = ["length", "shard", "block"]
    found = kept.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, FOUND_SCHEMA)
    # Only the best k of a query leave each task before the merge.
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
