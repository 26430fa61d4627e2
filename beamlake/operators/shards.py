"""Scatter and gather: an index in shards, each searched by one task for all queries in one pass.

Rows are dealt to shards by a hash of their id. A shard has a graph of its own, built by partition trees, and routes: links down a tree of pivots from
the shard's entries to every row, so that a search comes near its query even where the graph falls into parts. Everything a search needs of a row lies
in one row of one table that is bucketed by shard, so a search moves the queries to the shards and no part of the index: a task holds one
shard (about SHARD rows) as arrays, runs all its queries, ranks what they expanded exactly, and returns k rows per query. A
window merges the shards' best, with its limit applied before the shuffle. The number of jobs does not depend on the hops.

More than BLOCK queries are searched in several passes over the index, so no task holds more of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamlake.config import DEGREE, SearchConfig
from beamlake.operators import pq
from beamlake.operators.blocked import l2, matrix, nearest, smallest
from beamlake.operators.cells import cell_lists, cells, routes
from beamlake.operators.search import _size, beam, best
from beamlake.operators.tables import stored

#: Rows of a shard, about, and queries of one pass. Passes run beside each other.
SHARD, BLOCK = 131_072, 8_192
#: Distances that are held at a time where queries are compared with a whole shard, and rows that they are of.
CELLS, ROWS_STEP = 1 << 21, 1 << 14

ROWS = "shard int, vec_id bigint, vec array<int>, pq16 array<smallint>, pq32 array<smallint>, neighbors array<bigint>, routes array<bigint>, entry boolean"


def shard_of(shards: int):
    return F.pmod(F.xxhash64(F.lit("shard"), F.col("vec_id")), F.lit(shards)).cast("int")


def sharded_rows(vectors: DataFrame, codes: DataFrame, shards: int, degree: int = DEGREE) -> DataFrame:
    """ROWS of an index: everything of a row together, with its shard's graph, the routes that lead through it, and where searches begin."""
    parted = stored(vectors.select(shard_of(shards).alias("part"), "vec_id", "vec"), "parted")
    lists = cell_lists(cells(parted), degree).select("vec_id", F.transform("near", lambda x: x["vec_id"]).alias("neighbors"))
    ways = stored(routes(parted), "routes")
    first = ways.where("head is null").select("vec_id", F.lit(True).alias("entry"))
    down = ways.where("head is not null").groupBy(F.col("head").alias("vec_id")).agg(F.sort_array(F.collect_list("vec_id")).alias("routes"))  # PIVOTS for each level
    all_ = vectors.join(codes, "vec_id").join(lists, "vec_id", "left").join(down, "vec_id", "left").join(first, "vec_id", "left")
    none = F.array().cast("array<bigint>")
    return all_.select(
        shard_of(shards).alias("shard"), "vec_id", "vec", "pq16", "pq32", F.coalesce("neighbors", none).alias("neighbors"), F.coalesce("routes", none).alias("routes"),
        F.coalesce("entry", F.lit(False)).alias("entry"),
    )


class _Shard:
    """A shard's rows as arrays, in the order of ids."""

    def __init__(self, rows: pa.Table, m: int):
        rows = rows.sort_by("vec_id")
        self.ids, self.codes, self.vecs = rows.column("vec_id").to_numpy(), matrix(rows.column(f"pq{m}"), np.int16), rows.column("vec").combine_chunks()
        near, ways = (rows.column(c).combine_chunks() for c in ("neighbors", "routes"))  # walked alike
        sizes = [np.diff(x.offsets.to_numpy()) for x in (near, ways)]
        ends = np.concatenate([[0], np.cumsum(sizes[0] + sizes[1])])
        flat = np.empty(ends[-1], dtype=np.int64)
        for x, n, begin in ((near, sizes[0], ends[:-1]), (ways, sizes[1], ends[:-1] + sizes[0])):
            flat[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())] = x.flatten().to_numpy(zero_copy_only=False)
        at = np.searchsorted(self.ids, flat)
        inside = (at < len(self.ids)) & (self.ids[np.minimum(at, len(self.ids) - 1)] == flat)  # an edge may lead to a row that is deleted
        kept = np.concatenate([[0], np.cumsum(inside)])
        self.offsets, self.targets = kept[ends], at[inside]
        marked = np.flatnonzero(rows.column("entry").to_numpy(zero_copy_only=False))
        self.entries = marked if len(marked) else np.zeros(1, np.int64)

    def reached(self) -> np.ndarray:
        """Places that lists and routes lead to from the entries, in order."""
        seen, front = np.zeros(len(self.ids), bool), self.entries
        while len(front):
            seen[front] = True
            n = self.offsets[front + 1] - self.offsets[front]
            ends = np.cumsum(n)
            to = self.targets[np.repeat(self.offsets[front] - ends + n, n) + np.arange(ends[-1])]
            front = np.unique(to[~seen[to]])
        return np.flatnonzero(seen)

    def vectors(self, places: np.ndarray) -> np.ndarray:
        return matrix(pa.chunked_array([self.vecs.take(pa.array(places))]))


def _all_reached(shard: _Shard, q: pa.Table, cfg: SearchConfig, not_self: bool, dead: np.ndarray | None) -> tuple[list, list, list, list]:
    """Results of queries whose list can hold the whole shard. Such a list drops nothing, so a search expands whatever can be reached, which is the
    same for every query: it is walked once, and ranked in blocks of bounded size."""
    places = shard.reached()
    if len(places) > cfg.max_expanded:
        raise OverflowError(f"more than {cfg.max_expanded} vertices expanded")
    hops, out = len(places), ([], [], [], [])
    places = places if dead is None else places[~dead[places]]
    ids, asked, y = shard.ids[places], q.column("query_id").to_numpy(), matrix(q.column("vec"), np.float64)
    last = np.iinfo(np.int64).max
    top = np.full((2, len(asked), cfg.k), last)  # distances, and numbers of places
    for a in range(0, len(places), ROWS_STEP):
        x = shard.vectors(places[a : a + ROWS_STEP]).astype(np.float64)
        step = CELLS // ROWS_STEP
        for i in range(0, len(asked), step):
            me = asked[i : i + step, None]
            dist, at = nearest(l2(x, y[i : i + step]), cfg.k, ids[a : a + ROWS_STEP] == me if not_self else None)
            both = np.stack([np.where(at >= 0, dist, last), np.where(at >= 0, at + a, last)])
            both = np.concatenate([top[:, i : i + step], both], axis=2)  # in the order of places where distances are equal
            best_ = np.argsort(both[0], axis=1, kind="stable")[:, : cfg.k]
            top[:, i : i + step] = np.take_along_axis(both, best_[None], axis=2)
    found = top[1] < last
    whose = np.broadcast_to(asked[:, None], found.shape)[found].tolist()
    for column, values in zip(out, (whose, ids[top[1][found]].tolist(), top[0][found].tolist(), [hops] * len(whose)), strict=True):
        column.extend(values)
    return out


def search_rows(queries: DataFrame, rows: DataFrame, n_shards: int, mean: np.ndarray, book: np.ndarray, cfg: SearchConfig, not_self: bool = False, deleted: DataFrame | None = None, mine: list[int] | None = None) -> DataFrame:
    """query_id, rank, vec_id, dist_sq of the k nearest found of queries(query_id, vec) in rows, a table of ROWS dealt to n_shards, which holds the
    shards `mine`, or all.

    What is ranked exactly is cfg.rerank's choice (full, partial or list). deleted(vec_id): rows that are walked through and never returned."""
    if cfg.rerank == "two_stage":
        raise ValueError("sharded searches rank by one code length")
    own = rows.select("shard", "vec_id", "vec", f"pq{cfg.m}", "neighbors", "routes", "entry")
    asked = queries.select("query_id", "vec", _size(queries, cfg).alias("l_size"), F.lit(None).cast("bigint").alias("dead"))
    passes = max(1, math.ceil(queries.count() / BLOCK))
    tombstones = deleted is not None
    exhaustive = cfg.rerank != "partial" and cfg.max_hops is None and not cfg.early_stop
    result = "query_id bigint, vec_id bigint, dist_sq bigint, hops int"

    def run(table: pa.Table, q: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list] = ([], [], [], [])
        if table.num_rows and q.num_rows:
            shard, dead = _Shard(table, cfg.m), None
            if tombstones:
                dead = np.isin(shard.ids, pc.drop_null(q.column("dead")).to_numpy())
                q = q.filter(pc.is_null(q.column("dead")))
            every = exhaustive & (q.column("l_size").to_numpy() >= len(shard.ids))
            if every.any():
                for column, values in zip(out, _all_reached(shard, q.filter(pa.array(every)), cfg, not_self, dead), strict=True):
                    column.extend(values)
                q = q.filter(pa.array(~every))
            for i in range(0, q.num_rows, 64):
                part = q.slice(i, 64)
                x, mine, sizes = matrix(part.column("vec")), part.column("query_id").to_numpy(), part.column("l_size").to_numpy()
                for me, own_x, t, size in zip(mine, x, pq.tables(x - mean, book, cfg.m), sizes, strict=True):
                    expanded, last, _, _ = beam(t, shard.codes, shard.offsets, shard.targets, shard.entries, cfg, int(size))
                    found = last if cfg.rerank == "list" else sorted(expanded)[: cfg.partial] if cfg.rerank == "partial" else expanded
                    places = np.array([p for _, p in found], dtype=np.int64)
                    if not_self:
                        places = places[shard.ids[places] != me]
                    if dead is not None:
                        places = places[~dead[places]]
                    if not len(places):
                        continue
                    d = ((shard.vectors(places) - own_x) ** 2).sum(axis=1)
                    kept = smallest(d, shard.ids[places], cfg.k)
                    for column, values in zip(out, ([int(me)] * len(kept), shard.ids[places[kept]].tolist(), d[kept].tolist(), [len(expanded)] * len(kept)), strict=True):
                        column.extend(values)
        return pa.table({c: pa.array(v, t) for (c, t), v in zip((("query_id", pa.int64()), ("vec_id", pa.int64()), ("dist_sq", pa.int64()), ("hops", pa.int32())), out, strict=True)})

    found = None
    for nth in range(passes):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == nth)
        spread = block.withColumn("shard", F.explode(F.lit(list(range(n_shards)) if mine is None else mine)))  # every query to every shard: the scatter
        if deleted is not None:  # tombstones go to their shard as well, so the index's own rows stay where they are
            nothing = [F.lit(None).cast(t).alias(c) for c, t in asked.dtypes[:3]]
            spread = spread.unionByName(deleted.select(*nothing, F.col("vec_id").alias("dead"), shard_of(n_shards).alias("shard")))
        one = own.groupBy("shard").cogroup(spread.groupBy("shard")).applyInArrow(run, result)
        found = one if found is None else found.unionByName(one)
    return best(found, cfg.k)

