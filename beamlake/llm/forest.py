"""Approximate nearest neighbours with a forest of hash-prefix trees.

Every vector has a hash string of BITS random-hyperplane signs per tree, and a tree is the sorted array of
these strings. A query descends every tree to its longest matching prefixes, the ranges of the array that share
them, and ascends in all trees at once, one bit at a time, for more candidates; these are compared exactly. Two vectors
at an angle a share d signs of a tree with probability (1 - a / pi) ** d, so at any depth the angle of the k-th
neighbour found tells how probable it is that no tree holds another vector as near. The ascent ends once that is at
most MISS: close neighbours are found in a few short ranges, far ones, as in noise, need a larger share of the rows.

Vectors are dealt at random to shards of about SHARD_ROWS, queries to blocks of about BLOCK; each pair of shard
and block is one task of bounded memory, and a query's neighbours are the best of its shards'. All rows are
indexed. Of equal vectors the k + 1 smallest ids are kept, as no others can be among k neighbours; they
are picked with a limit before the shuffle, so a vector that a third of the rows share is no hot group.

Nearness is the cosine in double precision; ties go to the smaller vec_id. Vectors that are null, zero, or
hold a null, NaN or infinite component take no part, nor do rows with a null vec_id; rows that repeat count
once; a vec_id with two vectors is two candidates and, where it is a query, has the best neighbours of both.
Only vectors of the query's own dimension are compared. With fewer than k candidates all are returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TREES, BITS, SEED = 256, 16, 20240607
SHARD_ROWS, BLOCK = 16_384, 4_096
#: Probability with which a neighbour as near as the k-th found may be missed.
MISS = 0.1


def usable(v: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


class Forest:
    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        self.planes = np.random.default_rng(seed).standard_normal((vectors.shape[1], trees * bits))
        self.trees, self.bits = trees, bits
        keys = self.hashes(vectors)
        self.order = [np.argsort(keys[:, t], kind="stable") for t in range(trees)]
        self.sorted = [keys[self.order[t], t] for t in range(trees)]
        self.n = len(vectors)
        self.read = 0  # rows compared, over all queries

    def hashes(self, vectors: np.ndarray) -> np.ndarray:
        weights = 1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64)
        out = np.empty((len(vectors), self.trees), dtype=np.int32)
        for i in range(0, len(vectors), 1024):
            signs = (vectors[i : i + 1024] @ self.planes > 0).reshape(-1, self.trees, self.bits)
            out[i : i + 1024] = signs @ weights
        return out

    def ranges(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """low and high, BITS + 1 x trees x queries: the places of each tree that share so many bits with a query."""
        keys = self.hashes(queries)
        low = np.empty((self.bits + 1, self.trees, len(queries)), dtype=np.int32)
        high = np.empty_like(low)
        for t in range(self.trees):
            shift = self.bits - np.arange(self.bits + 1)[:, None]
            prefix = keys[:, t][None] >> shift
            low[:, t] = np.searchsorted(self.sorted[t], prefix << shift, side="left")
            high[:, t] = np.searchsorted(self.sorted[t], (prefix + 1) << shift, side="left")
        return low, high

    def nearest(self, unit: np.ndarray, query: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, keep: np.ndarray) -> np.ndarray:
        """Indexes of the candidates of one unit query, all whose cosine may be among the k best; keep marks those that count."""
        seen = np.zeros(self.n, dtype=bool)
        found, cosine = np.zeros(0, dtype=np.int64), np.zeros(0)
        for depth in range(self.bits, -1, -1):
            size = int((high[depth] - low[depth]).sum())
            if depth and size < 4 * k:
                continue
            hit = np.zeros(self.n, dtype=bool)
            for t in np.flatnonzero(high[depth] > low[depth]):
                hit[self.order[t][low[depth, t] : high[depth, t]]] = True
            new = np.flatnonzero(hit & ~seen & keep)
            seen |= hit
            found, cosine = np.concatenate([found, new]), np.concatenate([cosine, unit[new] @ query])
            if len(found) >= k:
                kth = float(np.partition(cosine, len(cosine) - k)[len(cosine) - k])
                share = 1 - math.acos(max(-1.0, min(1.0, kth))) / math.pi
                if (1 - share**depth) ** self.trees <= MISS:
                    break
        self.read += int(seen.sum())
        if len(found) > k:  # far more than rounding can exchange
            found = found[cosine >= np.partition(cosine, len(cosine) - k)[len(cosine) - k] - 1e-9]
        return found


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[list[int], list[int], list[float]]:
    """The k nearest of one shard for each query of one block: query ids, vector ids, scores."""
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    forest = Forest(unit)
    out_q: list[int] = []
    out_v: list[int] = []
    out_s: list[float] = []
    for at in range(0, len(queries), 256):
        part = queries[at : at + 256]
        low, high = forest.ranges(part)
        for i, q in enumerate(part):
            me = query_ids[at + i]
            found = forest.nearest(unit, q / np.linalg.norm(q), low[:, :, i], high[:, :, i], k, ids != me)
            if not len(found):
                continue
            exact = (vectors[found] * q).sum(axis=1) / (norms[found] * math.sqrt(float((q * q).sum())))
            best = np.lexsort((ids[found], -exact))[:k]
            out_q += [int(me)] * len(best)
            out_v += ids[found][best].tolist()
            out_s += exact[best].tolist()
    return out_q, out_v, out_s


def _matrix(t: pa.Table) -> np.ndarray:
    col = t.column("embedding").combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found of vectors(vec_id, embedding) to each row of queries."""
    clean = lambda d: d.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).distinct()
    nth = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    base = clean(vectors).withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth")
    asked = clean(queries)
    shards, blocks = max(1, math.ceil(vectors.count() / SHARD_ROWS)), max(1, math.ceil(queries.count() / BLOCK))
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = base.select("vec_id", "embedding", F.size("embedding").alias("dim"), deal(shards, 1).alias("shard"), every(blocks).alias("block"))
    right = asked.select("vec_id", "embedding", F.size("embedding").alias("dim"), every(shards).alias("shard"), deal(blocks, 2).alias("block"))

    def run(v: pa.Table, q: pa.Table) -> pa.Table:
        a, b, c = search_block(v.column("vec_id").to_numpy(), _matrix(v), q.column("vec_id").to_numpy(), _matrix(q), k) if v.num_rows and q.num_rows else ([], [], [])
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    keys = ["dim", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
