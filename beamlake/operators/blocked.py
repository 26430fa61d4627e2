"""Top-k of a query set against all rows, in blocks of bounded size.

Rows are dealt to shards and queries to blocks; a pair of them is one task that holds at most about
SHARD x dimension numbers and returns k rows per query. The shards' best are merged by a ranked window, whose
limit is applied before its shuffle. Nothing of the size of rows x queries is ever materialised.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD, BLOCK = 16_384, 2_048
#: Queries of a block that are compared with the shard at a time; their distances are all that is held.
STEP = 128


def matrix(column: pa.ChunkedArray, dtype: type = np.int64) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0), dtype)


def smallest(dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest of a row by (distance, id)."""
    if len(dist) > k:
        edge = np.partition(dist, k - 1)[k - 1]
        near = np.flatnonzero(dist <= edge)
    else:
        near = np.arange(len(dist))
    return near[np.lexsort((ids[near], dist[near]))][:k]


#: Bits of a place in a key of (distance, place); distances of 64 dimensions of 16 bits take 39.
PLACE = 24


def nearest(dist: np.ndarray, k: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distances and places of each row's k smallest whole numbers, in the order of (distance, place), and place -1 where there are fewer. without: a
    mask of what is left out.

    Both are packed into one number, so that a partition of whole blocks does it. dist is overwritten."""
    n, last = dist.shape[1], np.iinfo(np.int64).max
    if n > 1 << PLACE or (dist.size and int(dist.max()) >= 1 << 62 - PLACE):
        raise OverflowError("distances and places don't fit one key")
    dist <<= PLACE
    dist |= np.arange(n)
    if without is not None:
        dist[without] = last
    best = np.sort(np.partition(dist, k - 1, axis=1)[:, :k] if n > k else dist, axis=1)
    return best >> PLACE, np.where(best == last, -1, best & (1 << PLACE) - 1)


def topk(rows: DataFrame, queries: DataFrame, k: int, distances: Callable[[pa.Table, pa.Table], np.ndarray], not_self: bool = False, columns: str = "query_id bigint, vec_id bigint, dist bigint") -> DataFrame:
    """query_id, rank (from 1), vec_id, dist: the k rows nearest to each query, ties to the smaller vec_id.

    distances gives the matrix queries x rows of one block; not_self leaves out a row whose id is the query's.
    """
    shards, blocks = max(1, math.ceil(rows.count() / SHARD)), max(1, math.ceil(queries.count() / BLOCK))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("shard", deal("vec_id", shards)).withColumn("block", every(blocks))
    right = queries.withColumn("block", deal("query_id", blocks)).withColumn("shard", every(shards))

    def run(a: pa.Table, q: pa.Table) -> pa.Table:
        a = a.sort_by("vec_id")  # ties go to the smaller id, which is the earlier place
        ids, asked = a.column("vec_id").to_numpy(), q.column("query_id").to_numpy()
        out: tuple[list, list, list] = ([], [], [])
        for i in range(0, len(asked) if len(ids) else 0, STEP):
            me = asked[i : i + STEP]
            dist, place = nearest(distances(a, q.slice(i, STEP)), k, ids == me[:, None] if not_self else None)
            found = place >= 0
            for column, values in zip(out, (np.broadcast_to(me[:, None], place.shape)[found], ids[place[found]], dist[found]), strict=True):
                column.append(values)
        return pa.table({c: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for c, v in zip(("query_id", "vec_id", "dist"), out, strict=True)})

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(run, columns)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "dist")


def l2_block(a: pa.Table, q: pa.Table) -> np.ndarray:
    """Exact squared distances. Values of 16 bits: the products fit a double without loss, so BLAS can be used."""
    return l2(matrix(a.column("vec"), np.float64), matrix(q.column("vec"), np.float64))


def l2(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The matrix y x x of l2_block, of doubles."""
    d = (-2 * y) @ x.T
    d += (y * y).sum(axis=1)[:, None]
    d += (x * x).sum(axis=1)
    return d.astype(np.int64)  # whole already
