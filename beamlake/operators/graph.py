"""Proximity graphs: exact nearest-neighbour graph, robust pruning, edges and checks."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beamlake.operators.blocked import l2_block, topk
from beamlake.operators.tables import stored


def knn_edges(vectors: DataFrame, degree: int) -> DataFrame:
    """query_id, rank, vec_id, dist: the `degree` nearest others of each vector, in blocks."""
    asked = vectors.select(F.col("vec_id").alias("query_id"), "vec")
    return topk(vectors.select("vec_id", "vec"), asked, degree, l2_block, not_self=True)


def knn_graph(vectors: DataFrame, degree: int) -> DataFrame:
    """vec_id and its neighbors, nearest first. A list has at most `degree` entries."""
    e = knn_edges(vectors, degree).groupBy(F.col("query_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("rank", F.col("vec_id").alias("to")))).alias("e"))
    return e.select("vec_id", F.transform("e", lambda x: x["to"]).alias("neighbors"))


def edges(graph: DataFrame) -> DataFrame:
    return graph.select(F.col("vec_id").alias("src"), F.posexplode("neighbors").alias("slot", "dst"))


def in_degree(graph: DataFrame) -> DataFrame:
    """vec_id and in_degree of every vertex, 0 included."""
    n = edges(graph).groupBy(F.col("dst").alias("vec_id")).agg(F.count("*").alias("n"))
    return graph.select("vec_id").join(n, "vec_id", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("in_degree"))


def reverse_edges(graph: DataFrame) -> DataFrame:
    """vec_id, slot and src of each edge that points to vec_id, in the order of src. Rows, not lists, so a hub's in-edges are
    never one value; the ranking sorts them, and spills."""
    back = edges(graph).select(F.col("dst").alias("vec_id"), "src").distinct()
    return back.withColumn("slot", (F.row_number().over(Window.partitionBy("vec_id").orderBy("src")) - 1).cast("int")).select("vec_id", "slot", "src")


def robust_prune(point: np.ndarray, candidates: np.ndarray, vectors: np.ndarray, degree: int, alpha: float = 1.2) -> list[int]:
    """Places of the candidates kept: the nearest, then none that a kept one covers (alpha * d(kept, c) <= d(point, c))."""
    v = vectors.astype(np.float64)  # whole numbers of 16 bits: nothing is lost
    d = ((v - point) ** 2).sum(axis=1)
    order = np.lexsort((candidates, d))
    return order[covering(v[order], d[order], degree, alpha)].tolist()


def covering(v: np.ndarray, d: np.ndarray, degree: int, alpha: float = 1.2) -> list[int]:
    """Places that robust_prune keeps of candidates v at distances d, which come nearest first; doubles that are whole numbers."""
    alive, kept, norms = np.ones(len(d), bool), [], np.einsum("ij,ij->i", v, v)
    between = norms[:, None] + norms - 2 * (v @ v.T) if len(d) <= 256 else None
    while len(kept) < degree:
        p = int(alive.argmax()) if len(d) else 0
        if not len(d) or not alive[p]:
            break
        kept.append(p)
        alive &= alpha * alpha * (between[p] if between is not None else norms + norms[p] - 2 * (v @ v[p])) > d
        alive[p] = False
    return kept


def integrity(vectors: DataFrame, graph: DataFrame, codes: DataFrame) -> DataFrame:
    """check and violations: ids that repeat or are missing in a table, edges that lead nowhere or repeat."""

    def one(name: str, bad: DataFrame) -> DataFrame:
        return bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")

    repeated = lambda t: t.groupBy("vec_id").count().where("count > 1")
    checks = [
        one("vectors_unique", repeated(vectors)),
        one("graph_unique", repeated(graph)),
        one("codes_unique", repeated(codes)),
        one("graph_missing", vectors.select("vec_id").join(graph, "vec_id", "left_anti")),
        one("codes_missing", vectors.select("vec_id").join(codes, "vec_id", "left_anti")),
        one("edges_dangling", edges(graph).select(F.col("dst").alias("vec_id")).join(vectors, "vec_id", "left_anti")),
        one("edges_self", edges(graph).where("src = dst")),
        one("edges_repeated", graph.where(F.size("neighbors") > F.size(F.array_distinct("neighbors")))),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def reachable(graph: DataFrame, entry: int) -> DataFrame:
    """vec_id and hops from the entry, by breadth-first rounds that each join only the newest vertices, until there are none.

    What has been reached is written as one table every 16 rounds, so a plan never unites more than so many parts."""
    spark = graph.sparkSession
    seen = stored(spark.createDataFrame([(entry, 0)], "vec_id bigint, hops int"), "reached")
    front = seen
    for hop in itertools.count(1):
        new = edges(graph.join(front.select("vec_id"), "vec_id", "left_semi")).select(F.col("dst").alias("vec_id")).distinct().join(seen, "vec_id", "left_anti")
        front = stored(new.select("vec_id", F.lit(hop).alias("hops")), "reached")
        if front.limit(1).count() == 0:
            return seen
        seen = seen.unionByName(front)
        if hop % 16 == 0:
            seen = stored(seen, "reached")
