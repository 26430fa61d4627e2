"""Greedy beam search over a proximity graph, and exact reranking of what it expanded.

ann_search holds the index in each Python worker, behind a check of its size; ann_search_rounds keeps it in
tables and joins, for indexes beyond that bound. Both follow the same rules: a vertex is scored once per
query, the list keeps the l_size smallest (distance, id), the search ends when all of the list has been
expanded, and the answer comes from the expanded vertices.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beamlake.config import SearchConfig
from beamlake.functions.vector import adc_sum, l2sq
from beamlake.operators import pq
from beamlake.operators.blocked import l2_block, matrix, topk
from beamlake.operators.tables import stored

#: Largest index, in bytes of its rows, that is held in each worker; the driver holds about four times as much while it is sent.
MAX_INDEX_BYTES = 128 << 20


@dataclass
class Index:
    """vectors(vec_id, vec), graph(vec_id, neighbors), codes(vec_id, pq16, pq32), and the small fixed-size parts."""

    vectors: DataFrame
    graph: DataFrame
    codes: DataFrame
    mean: np.ndarray
    books: dict[int, np.ndarray]
    entry: int


def beam(table: np.ndarray, codes: np.ndarray, offsets: np.ndarray, targets: np.ndarray, entry: int | np.ndarray, cfg: SearchConfig, size: int | None = None):
    """One query over places (not ids): expanded places with distances in order, the final list, and counters.

    size: the query's own list size, where it has one. entry: the place, or places, where the search begins.

    table: m x centroids distances of the query; vertex p's neighbors are targets[offsets[p]:offsets[p + 1]].
    Places are in the order of ids, so ties go to the smaller id.
    """
    m, size = np.arange(table.shape[0]), size or cfg.l_size
    seen = np.zeros(len(codes), dtype=bool)
    first = np.atleast_1d(entry)
    seen[first] = True
    near = table[m, codes[first]].sum(axis=1)
    keep = np.lexsort((first, near))[:size]
    place, dist, visited = first[keep], near[keep], np.zeros(len(keep), bool)
    expanded: list[tuple[int, int]] = []
    n_new, n_dup = len(first), 0
    while not visited.all():
        if cfg.max_hops is not None and len(expanded) >= cfg.max_hops:
            break
        i = int(np.argmin(visited))  # the first that is not expanded
        if cfg.early_stop and len(place) >= size and expanded and dist[i] >= dist[-1]:
            break
        if len(expanded) >= cfg.max_expanded:
            raise OverflowError(f"more than {cfg.max_expanded} vertices expanded")
        visited[i] = True
        p = int(place[i])
        expanded.append((int(dist[i]), p))
        near = np.unique(targets[offsets[p] : offsets[p + 1]])
        fresh = near[~seen[near]]
        n_new, n_dup = n_new + len(fresh), n_dup + len(near) - len(fresh)
        if not len(fresh):
            continue
        seen[fresh] = True
        d = table[m, codes[fresh]].sum(axis=1)
        place, dist, visited = np.concatenate([place, fresh]), np.concatenate([dist, d]), np.concatenate([visited, np.zeros(len(fresh), bool)])
        keep = np.lexsort((place, dist))[:size]
        place, dist, visited = place[keep], dist[keep], visited[keep]
    return expanded, list(zip(dist.tolist(), place.tolist(), strict=True)), n_new, n_dup


def index_bytes(index: Index, m: int, degree: int) -> int:
    return index.codes.count() * (8 + 2 * m + 8 * degree)


@dataclass
class Held:
    """An index's codes and graph as arrays, sent to the workers once and used by any number of searches."""

    arrays: object
    entry: int
    m: int


def held(index: Index, m: int, degree: int) -> Held | None:
    """The codes and the graph, collected once and broadcast behind a check of their size; None beyond it."""
    if index_bytes(index, m, degree) > MAX_INDEX_BYTES:
        return None
    rows = index.codes.select("vec_id", F.col(f"pq{m}").alias("code")).join(index.graph, "vec_id").orderBy("vec_id").toArrow()
    ids = rows.column("vec_id").to_numpy()
    codes = matrix(rows.column("code"), np.int16)
    lists = rows.column("neighbors").combine_chunks()
    offsets = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    targets = np.searchsorted(ids, flat)
    inside = (targets < len(ids)) & (ids[np.minimum(targets, len(ids) - 1)] == flat)
    if not inside.all():
        raise ValueError("the graph has edges to vertices without codes")
    shared = index.codes.sparkSession.sparkContext.broadcast((ids, codes, offsets, targets.astype(np.int32)))
    return Held(shared, int(np.searchsorted(ids, index.entry)), m)


def search(queries: DataFrame, index: Index, cfg: SearchConfig, ready: Held | None = None) -> DataFrame:
    """query_id, hops, n_new, n_dup, expanded and list (arrays of dist, vec_id) of each query.

    A column l_size of queries, if there is one, is a query's own list size. ready: what held() has given before."""
    ready = ready or held(index, cfg.m, cfg.degree)
    if ready is None:
        return search_rounds(queries, index, cfg)
    shared, entry = ready.arrays, ready.entry
    mean, book = index.mean, index.books[cfg.m]
    pair = "array<struct<dist:bigint,vec_id:bigint>>"
    schema = f"query_id bigint, hops int, n_new int, n_dup int, expanded {pair}, list {pair}"

    def run(batches):
        ids, codes, offsets, targets = shared.value
        kind = pa.list_(pa.struct([("dist", pa.int64()), ("vec_id", pa.int64())]))
        named = lambda found: [{"dist": d, "vec_id": int(ids[p])} for d, p in found]
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                t = pq.tables(matrix(pa.chunked_array([part.column(1)])) - mean, book, cfg.m)
                sizes = part.column(2).to_pylist()
                found = [beam(one, codes, offsets, targets, entry, cfg, size) for one, size in zip(t, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(f[0]) for f in found], pa.int32()),
                        pa.array([f[2] for f in found], pa.int32()),
                        pa.array([f[3] for f in found], pa.int32()),
                        pa.array([named(f[0]) for f in found], kind),
                        pa.array([named(f[1]) for f in found], kind),
                    ],
                    names=["query_id", "hops", "n_new", "n_dup", "expanded", "list"],
                )

    return queries.select("query_id", "vec", _size(queries, cfg).alias("l_size")).mapInArrow(run, schema)


def _size(queries: DataFrame, cfg: SearchConfig):
    return F.col("l_size").cast("int") if "l_size" in queries.columns else F.lit(cfg.l_size)


def search_rounds(queries: DataFrame, index: Index, cfg: SearchConfig) -> DataFrame:
    """The same search as rounds of joins: each round expands one vertex of every open query.

    State is one row per query and a table each round; graph and codes are joined by vertex, so no part of the
    index is held whole. Fresh vertices' codes are gathered per query, `degree` at most, before they meet its distance table,
    so a table is read once per query and round. Queries that have ended are written and leave the state."""
    book, mean = index.books[cfg.m], index.mean
    t = pq.adc_tables(queries, mean, book, cfg.m).groupBy("query_id", "subspace").agg(F.sort_array(F.collect_list(F.struct("centroid", "dist"))).alias("r"))
    t = t.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("subspace", F.transform("r", lambda x: x["dist"]).alias("d")))).alias("t"))
    t = stored(t.select("query_id", F.transform("t", lambda x: x["d"]).alias("table")), "adc")
    code = stored(index.codes.select("vec_id", F.col(f"pq{cfg.m}").alias("code")), "codes")
    _adc = lambda c: adc_sum(F.col("table"), c)
    pair = "struct<dist:bigint,vec_id:bigint>"
    sizes = queries.select("query_id", _size(queries, cfg).alias("l_size"))
    first = t.join(sizes, "query_id").crossJoin(F.broadcast(code.where(F.col("vec_id") == index.entry)))  # one row
    state = first.select(
        "query_id",
        "l_size",
        F.array(F.struct(_adc(F.col("code")).alias("dist"), F.col("vec_id"))).cast(f"array<{pair}>").alias("list"),
        F.array().cast(f"array<{pair}>").alias("expanded"),
        F.array("vec_id").alias("seen"),
        F.lit(1).alias("n_new"),
        F.lit(0).alias("n_dup"),
    )
    state, done = stored(state, "beam"), None
    for hop in range(cfg.max_expanded + 1):
        done_ids = F.transform("expanded", lambda e: e["vec_id"])
        nxt = F.try_element_at(F.filter("list", lambda x: ~F.array_contains(done_ids, x["vec_id"])), F.lit(1))
        marked = state.withColumn("next", nxt)
        stop = F.col("next").isNull()
        if cfg.max_hops is not None and hop >= cfg.max_hops:
            stop = F.lit(True)
        if cfg.early_stop:
            stop = stop | ((F.size("list") >= F.col("l_size")) & (F.size("expanded") > 0) & (F.col("next.dist") >= F.element_at("list", -1)["dist"]))
        live = marked.where(~stop)
        over = live.limit(1).count() == 0
        ended = marked.where(stop).drop("next")
        if over or ended.limit(1).count():
            ended = stored(ended, "beam-ended")
            done = ended if done is None else done.unionByName(ended)
        if over:
            break
        if hop == cfg.max_expanded:
            raise OverflowError(f"more than {cfg.max_expanded} vertices expanded")
        near = live.join(index.graph.select(F.col("vec_id").alias("at"), F.array_distinct("neighbors").alias("near")), F.col("next.vec_id") == F.col("at"))
        near = near.withColumn("fresh", F.array_except("near", "seen"))
        fresh = near.select("query_id", F.explode("fresh").alias("vec_id")).join(code, "vec_id")
        fresh = fresh.groupBy("query_id").agg(F.collect_list(F.struct("vec_id", "code")).alias("coded")).join(t, "query_id")  # at most `degree` entries
        fresh = fresh.select("query_id", F.transform("coded", lambda c: F.struct(_adc(c["code"]).alias("dist"), c["vec_id"].alias("vec_id"))).alias("scored"))
        merged = near.join(fresh, "query_id", "left")
        grown = F.array_sort(F.concat("list", F.coalesce("scored", F.array().cast(f"array<{pair}>"))))
        state = stored(
            merged.select(
                "query_id",
                "l_size",
                F.slice(grown, F.lit(1), F.col("l_size")).alias("list"),
                F.concat("expanded", F.array("next")).alias("expanded"),
                F.concat("seen", "fresh").alias("seen"),
                (F.col("n_new") + F.size("fresh")).alias("n_new"),
                (F.col("n_dup") + F.size("near") - F.size("fresh")).alias("n_dup"),
            ),
            f"beam-{uuid.uuid4().hex[:4]}",
        )
    return done.select("query_id", F.size("expanded").alias("hops"), "n_new", "n_dup", "expanded", "list")


def expanded_log(searched: DataFrame, by_distance: bool = False) -> DataFrame:
    """query_id, step (from 1), vec_id, dist: the expanded vertices in order of expansion, or of distance."""
    log = F.array_sort("expanded") if by_distance else F.col("expanded")
    e = searched.select("query_id", F.posexplode(log).alias("step", "e"))
    return e.select("query_id", (F.col("step") + 1).alias("step"), F.col("e.vec_id").alias("vec_id"), F.col("e.dist").alias("dist"))


def _exact(pairs: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    joined = pairs.join(vectors.select("vec_id", F.col("vec").alias("v")), "vec_id").join(queries.select("query_id", F.col("vec").alias("q")), "query_id")
    return joined.select("query_id", "vec_id", l2sq(F.col("q"), F.col("v")).alias("dist_sq"))


def _first(ranked: DataFrame, by: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(by, "vec_id"))
    return ranked.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def best(results: DataFrame, k: int) -> DataFrame:
    """The k best of several searches' results(query_id, vec_id, dist_sq), ranked anew."""
    return _first(results.select("query_id", "vec_id", "dist_sq"), "dist_sq", k).select("query_id", "rank", "vec_id", "dist_sq")


def rerank(searched: DataFrame, queries: DataFrame, index: Index, cfg: SearchConfig, not_self: bool = False, deleted: DataFrame | None = None) -> DataFrame:
    """query_id, rank, vec_id, dist_sq: the k best by exact distance of what cfg.rerank names.

    not_self leaves out the row whose id is the query's, deleted(vec_id) tombstones, both before anything is ranked."""
    source = F.col("list") if cfg.rerank == "list" else F.col("expanded")
    if cfg.rerank == "partial":
        source = F.slice(F.array_sort("expanded"), 1, cfg.partial)
    pairs = searched.select("query_id", F.explode(source).alias("e")).select("query_id", F.col("e.vec_id").alias("vec_id"))
    if not_self:
        pairs = pairs.where("vec_id <> query_id")
    if deleted is not None:
        pairs = pairs.join(deleted.select("vec_id"), "vec_id", "left_anti")
    if cfg.rerank == "two_stage":
        book, mean = index.books[32], index.mean
        long = pairs.join(index.codes.select("vec_id", "pq32"), "vec_id").join(queries.select("query_id", "vec"), "query_id")

        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                x, c = matrix(pa.chunked_array([b.column(3)])) - mean, matrix(pa.chunked_array([b.column(2)]), np.int64)
                width = x.shape[1] // 32
                parts = book.reshape(len(book), 32, width)[c, np.arange(32)]
                d = ((parts - x.reshape(len(x), 32, width)) ** 2).sum(axis=(1, 2))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d, pa.int64())], names=["query_id", "vec_id", "dist"])

        scored = long.select("query_id", "vec_id", "pq32", "vec").mapInArrow(run, "query_id bigint, vec_id bigint, dist bigint")
        pairs = _first(scored, "dist", cfg.refine).select("query_id", "vec_id")
    return _first(_exact(pairs, queries, index.vectors), "dist_sq", cfg.k).select("query_id", "rank", "vec_id", "dist_sq")


def ann_search(queries: DataFrame, index: Index, cfg: SearchConfig, not_self: bool = False, deleted: DataFrame | None = None, ready: Held | None = None) -> DataFrame:
    """query_id, rank, vec_id, dist_sq of the k nearest found."""
    return rerank(search(queries, index, cfg, ready), queries, index, cfg, not_self, deleted)


def exact_search(queries: DataFrame, vectors: DataFrame, k: int, not_self: bool = False) -> DataFrame:
    """query_id, rank, vec_id, dist_sq of the k nearest, by comparison with every vector in blocks."""
    return topk(vectors.select("vec_id", "vec"), queries.select("query_id", "vec"), k, l2_block, not_self).withColumnRenamed("dist", "dist_sq")


def search_with_delta(queries: DataFrame, index: Index, delta: DataFrame, cfg: SearchConfig, deleted: DataFrame | None = None, not_self: bool = False) -> DataFrame:
    """query_id, rank, vec_id, dist_sq of the k nearest of the base index and of delta(vec_id, vec), which is not linked in yet.

    The base is searched by its graph, the delta store, which is small until it is merged, exactly."""
    new = delta if deleted is None else delta.join(deleted.select("vec_id"), "vec_id", "left_anti")
    both = ann_search(queries, index, cfg, not_self, deleted).unionByName(exact_search(queries, new, cfg.k, not_self))
    return best(both, cfg.k)


def ann_search_by_gear(queries: DataFrame, index: Index, not_self: bool = False, **more: object) -> DataFrame:
    """Searches of queries(query_id, vec, gear), each with its gear's list size and code length: one search per code length."""
    from beamlake.config import GEARS, gear_config

    sizes = F.create_map(*[F.lit(x) for gear, _, size, _ in GEARS for x in (gear, size)])
    out = None
    for m in sorted({m for *_, m in GEARS}):
        gears = [gear for gear, _, _, width in GEARS if width == m]
        own = queries.where(F.col("gear").isin(gears)).withColumn("l_size", sizes[F.col("gear")])
        found = ann_search(own, index, gear_config(gears[-1], **more), not_self).join(own.select("query_id", "gear"), "query_id")
        out = found if out is None else out.unionByName(found)
    return out.select("query_id", "rank", "vec_id", "dist_sq", "gear")


def recall(results: DataFrame, truth: DataFrame, k: int, by: str = "distance") -> DataFrame:
    """query_id and recall: the share of k whose distance (or id) occurs in truth(query_id, rank, vec_id, dist_sq)."""
    col = "dist_sq" if by == "distance" else "vec_id"
    t = truth.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set(col).alias("right"))  # at most k
    r = results.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_list(col).alias("found"))
    hits = F.size(F.filter("found", lambda x: F.array_contains("right", x)))
    return t.join(r, "query_id", "left").select("query_id", F.coalesce(hits / F.lit(float(k)), F.lit(0.0)).alias("recall"))
