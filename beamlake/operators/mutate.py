"""Insert, delete, merge and compact, after the published graph-index algorithms.

A new vector is encoded, searched for, linked to the vertices its search expanded (pruned to the degree), and the
linked vertices get reverse edges, pruned again where they overflow. Deleted vertices are tombstones until compaction.
"""

from __future__ import annotations

import itertools
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beamlake.config import DEGREE, SearchConfig
from beamlake.functions.vector import l2sq
from beamlake.operators import graph, pq
from beamlake.operators.blocked import matrix
from beamlake.operators.search import Index, search
from beamlake.operators.tables import stored


def is_delta(vec_id, start: int):
    """Whether a vector belongs to the delta store, whose ids begin at `start`."""
    return vec_id >= F.lit(start)


#: Nearest candidates of a vertex that are gathered at first.
POOL = 256


def pruned(points: DataFrame, candidates: DataFrame, vectors: DataFrame, degree: int, alpha: float = 1.2) -> DataFrame:
    """vec_id, neighbors: for points(vec_id, vec) the robust choice among candidates(vec_id, other).

    The choice goes from near to far and ends with `degree` vertices, so the nearest POOL candidates of a vertex, taken with a limit
    before the shuffle, nearly always decide; where they don't, that vertex is tried again with eight times as many. So a hub's
    candidates don't meet in one task."""
    c = candidates.select("vec_id", "other").distinct().join(vectors.select(F.col("vec_id").alias("other"), F.col("vec").alias("v")), "other").join(points.select("vec_id", "vec"), "vec_id")
    c = stored(c.select("vec_id", "other", "v", l2sq(F.col("vec"), F.col("v")).alias("d")), "candidates")
    counts = c.groupBy("vec_id").agg(F.count("*").alias("n"))
    todo, pool, out = c, POOL, None

    def chosen(rows: pa.Table) -> pa.RecordBatch:
        """Of whole vertices, whose candidates come nearest first."""
        ids, other, d = (rows.column(c).to_numpy() for c in ("vec_id", "other", "d"))
        v = matrix(rows.column("v"), np.float64)
        cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
        kept = [other[i:j][graph.covering(v[i:j], d[i:j], degree, alpha)] for i, j in itertools.pairwise(cuts)]
        ends = np.cumsum([0, *map(len, kept)])
        return pa.RecordBatch.from_arrays([pa.array(ids[cuts[:-1]]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(kept)))], names=["vec_id", "neighbors"])

    def run(batches):
        held = None  # the last vertex of a batch may go on in the next
        for b in batches:
            rows = pa.Table.from_batches([b])
            rows = rows if held is None else pa.concat_tables([held, rows])
            ids = rows.column("vec_id").to_numpy()
            first = int(np.flatnonzero(ids == ids[-1])[0]) if len(ids) else 0
            if first:
                yield chosen(rows.slice(0, first))
            held = rows.slice(first)
        if held is not None and held.num_rows:
            yield chosen(held)

    while True:
        nth = F.row_number().over(Window.partitionBy("vec_id").orderBy("d", "other"))
        near = todo.withColumn("nth", nth).where(F.col("nth") <= pool)
        # The window leaves a vertex's rows together; Python sees rows, not lists of vectors, and holds one batch and one vertex.
        got = near.select("vec_id", "other", "d", "v").sortWithinPartitions("vec_id", "d", "other").mapInArrow(run, "vec_id bigint, neighbors array<bigint>")
        got = stored(got.join(counts, "vec_id"), "pruned")
        open_ = (F.size("neighbors") < degree) & (F.col("n") > pool)
        done = got.where(~open_).select("vec_id", "neighbors")
        out = done if out is None else out.unionByName(done)
        if got.where(open_).limit(1).count() == 0:
            return out
        todo, pool = todo.join(got.where(open_).select("vec_id"), "vec_id", "left_semi"), 8 * pool


def insert_vectors(index: Index, new: DataFrame, cfg: SearchConfig | None = None, degree: int = DEGREE) -> Index:
    """The index with new(vec_id, vec). Ids must be new."""
    cfg = cfg or SearchConfig(l_size=20)
    new = stored(new.select("vec_id", "vec"), "delta")
    if new.join(index.vectors, "vec_id", "left_semi").limit(1).count() or new.groupBy("vec_id").count().where("count > 1").limit(1).count():
        raise ValueError("an inserted vec_id exists already")
    found = search(new.withColumnRenamed("vec_id", "query_id"), index, cfg)
    candidates = found.select(F.col("query_id").alias("vec_id"), F.explode("expanded").alias("e")).select("vec_id", F.col("e.vec_id").alias("other"))
    own = stored(pruned(new, candidates, index.vectors, degree), "links")
    vectors = stored(index.vectors.select("vec_id", "vec").unionByName(new), "vectors")
    return replace(
        index,
        vectors=vectors,
        codes=stored(index.codes.unionByName(pq.encode(new, index.mean, index.books)), "codes"),
        graph=stored(with_reverse_edges(index.graph, own, vectors, degree), "graph"),
    )


def with_reverse_edges(old: DataFrame, own: DataFrame, vectors: DataFrame, degree: int) -> DataFrame:
    """old and own lists; old vertices gain reverse edges, and are pruned where they hold more than `degree`.

    Edges are rows until a vertex is known to hold few enough for a list."""
    e = graph.edges(old).select(F.col("src").alias("vec_id"), F.col("dst").alias("other"), F.col("slot").cast("long").alias("at"))
    new = graph.edges(own).select(F.col("dst").alias("vec_id"), F.col("src").alias("other")).join(old.select("vec_id"), "vec_id", "left_semi")
    both = e.unionByName(new.withColumn("at", F.lit(None).cast("long"))).groupBy("vec_id", "other").agg(F.min("at").alias("at"))
    both = stored(both, "edges")
    over = stored(both.groupBy("vec_id").agg(F.count("*").alias("n")).where(F.col("n") > degree).select("vec_id"), "over")
    few = both.join(over, "vec_id", "left_anti").groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("at", F.lit(degree).cast("long")).alias("at"), "other"))).alias("e"))  # at most `degree`
    few = few.select("vec_id", F.transform("e", lambda x: x["other"]).alias("neighbors"))
    cut = pruned(vectors.join(over, "vec_id", "left_semi"), both.join(over, "vec_id", "left_semi"), vectors, degree)
    bare = old.select("vec_id").join(both.select("vec_id").distinct(), "vec_id", "left_anti").select("vec_id", F.array().cast("array<bigint>").alias("neighbors"))
    return few.unionByName(cut).unionByName(bare).unionByName(own)


def delete_vectors(tombstones: DataFrame | None, ids: DataFrame) -> DataFrame:
    """Tombstones with ids(vec_id) added."""
    return ids.select("vec_id").distinct() if tombstones is None else tombstones.select("vec_id").unionByName(ids.select("vec_id")).distinct()


def without_deleted(results: DataFrame, tombstones: DataFrame) -> DataFrame:
    return results.join(tombstones, "vec_id", "left_anti")


def compact(index: Index, tombstones: DataFrame, degree: int = DEGREE) -> Index:
    """The index rewritten without deleted vertices; a vertex that loses neighbors takes over theirs, pruned."""
    vectors = stored(index.vectors.join(tombstones, "vec_id", "left_anti"), "vectors")
    links = index.graph.join(tombstones, "vec_id", "left_anti")
    e = graph.edges(links)
    gone = tombstones.select(F.col("vec_id").alias("dst"))
    hit = e.join(gone, "dst", "left_semi")
    kept = e.join(gone, "dst", "left_anti").select(F.col("src").alias("vec_id"), F.col("dst").alias("other"))
    heirs = hit.join(index.graph.select(F.col("vec_id").alias("dst"), "neighbors"), "dst").select(F.col("src").alias("vec_id"), F.explode("neighbors").alias("other"))
    heirs = heirs.where("vec_id <> other").join(tombstones.select(F.col("vec_id").alias("other")), "other", "left_anti")
    changed = hit.select(F.col("src").alias("vec_id")).distinct()
    new = pruned(vectors.join(changed, "vec_id", "left_semi"), kept.join(changed, "vec_id", "left_semi").unionByName(heirs.select("vec_id", "other")), vectors, degree)
    bare = changed.join(new, "vec_id", "left_anti").select("vec_id", F.array().cast("array<bigint>").alias("neighbors"))
    out = stored(links.join(changed, "vec_id", "left_anti").unionByName(new).unionByName(bare), "graph")
    entry = index.entry if vectors.where(F.col("vec_id") == index.entry).limit(1).count() else vectors.agg(F.min("vec_id")).first()[0]
    return replace(index, vectors=vectors, graph=out, codes=stored(index.codes.join(tombstones, "vec_id", "left_anti"), "codes"), entry=entry)


def merge_delta(base: Index, delta: DataFrame, cfg: SearchConfig | None = None) -> Index:
    """The base index with the delta store's vectors linked in from the base's entry."""
    return insert_vectors(base, delta, cfg)


INSERT_VECTOR, DELETE_VECTOR, MERGE, GC = insert_vectors, delete_vectors, merge_delta, compact
__all__ = ["DELETE_VECTOR", "GC", "INSERT_VECTOR", "MERGE", "compact", "delete_vectors", "insert_vectors", "is_delta", "merge_delta", "pruned", "with_reverse_edges", "without_deleted"]
