"""Merkle manifest of a dataset, by reduction of large blocks and a broadcast upper tree.

A row's leaf is the hash of its columns, each written as its length in UTF-8 bytes, a colon and its value, or `-` if it is null.
The leaves of a source, in the order of the key, are hashed in runs of FAN consecutive nodes (the last may be shorter, even
one node) until one node remains, the source's subroot; subroots, in the order of their sources, give the root likewise. H is
SHA-256 in lower-case hexadecimal, over the concatenated digests as text.

Leaves are sorted by ranges and numbered within their source, so a source of any size spreads over many tasks. Aligned blocks of
FAN ** LEVELS leaves are then each reduced by one task to a node LEVELS higher. While more than TOP nodes are left, they
are reduced in blocks again (and the subroots of very many sources after them); the driver builds the small tree that is left,
and broadcasts what each of its lowest nodes needs to reach the root. The tasks that read the blocks a second time put the paths
inside a block before these, which are joined by block, and every row is folded along its path by itself.

A path has a step for each level: the siblings left and right of a node, as text; a node alone in its run has none, and is
hashed all the same. Nulls sort first, in keys as in sources. Rows with equal keys are ordered by leaf, so the root never
depends on how the table is partitioned; rows alike in all hashed columns are leaves each. An empty table has no rows and no
root. Texts are hashed whole; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beamlake.llm.common import light, numbered, stored, wider

FAN = 3
#: Levels that one task reduces a block by; nodes that the driver holds at most.
LEVELS, TOP = 7, 6_561
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<left:string,right:string>>"
_STEP = T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())])


def leaf_of(columns: list[Column]) -> Column:
    """The leaf of a row that has these values."""

    def put(c: Column) -> Column:
        s = c.cast("string")
        return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))

    return F.sha2(F.concat(*map(put, columns)), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(total: int) -> int:
    """Levels above `total` nodes."""
    h = 0
    while total > 1:
        total, h = -(-total // FAN), h + 1
    return h


def grown(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level, from these up."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([_hash("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
    return out


def steps(levels: list[list[str]]) -> list[tuple[list[str], list[str]]]:
    """For each level but the last, the siblings left and right of each of its nodes."""
    out = []
    for nodes in levels[:-1]:
        runs = [i // FAN * FAN for i in range(len(nodes))]
        out.append((["".join(nodes[r:i]) for i, r in enumerate(runs)], ["".join(nodes[i + 1 : r + FAN]) for i, r in enumerate(runs)]))
    return out


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / F.lit(FAN**LEVELS)).cast("long")).groupBy("source", "block")


def _ordered(t: pa.Table) -> pa.Table:
    return t.take(pc.sort_indices(t, sort_keys=[("pos", "ascending")]))


def _reduced(nodes: DataFrame) -> DataFrame:
    """source, pos, node, total of the nodes above blocks of nodes(source, pos, node, total)."""
    levels = LEVELS

    def run(t: pa.Table) -> pa.Table:
        t, total = _ordered(t), t.column("total")[0].as_py()
        n = min(levels, height(total))
        (top,) = grown(t.column("node").to_pylist(), n)[-1]
        left = [-(-total // FAN**n)]
        return pa.table({"source": t.column("source").slice(0, 1), "pos": t.column("block").slice(0, 1), "node": pa.array([top], pa.string()), "total": pa.array(left, pa.int64())})

    return _blocks(nodes.select("source", "pos", "node", "total")).applyInArrow(run, "source string, pos long, node string, total long")


def _within(nodes: DataFrame) -> DataFrame:
    """nodes with block and path, the steps up to the block's node."""
    schema = wider(nodes, block=T.LongType(), path=T.ArrayType(_STEP))
    names, levels = schema.names[:-1], LEVELS

    def run(t: pa.Table) -> pa.Table:
        t = _ordered(t.select(names))
        n = min(levels, height(t.column("total")[0].as_py()))
        up = steps(grown(t.column("node").to_pylist(), n))
        first = t.column("pos")[0].as_py()
        at = [p - first for p in t.column("pos").to_pylist()]
        side = lambda s: pa.array([up[k][s][i // FAN**k] for i in at for k in range(n)], pa.string())
        pairs = pa.StructArray.from_arrays([side(0), side(1)], names=["left", "right"])
        paths = pa.ListArray.from_arrays(pa.array(range(0, len(at) * n + 1, n) if n else [0] * (len(at) + 1), pa.int32()), pairs)
        return t.append_column("path", paths)

    return _blocks(nodes).applyInArrow(run, schema)


def upper_tree(rows: list) -> list[tuple]:
    """(source, pos, path, subroot, root) of each of the nodes (source, pos, node, total), which are whole trees' levels."""
    trees: dict[str | None, list] = {}
    for r in rows:
        trees.setdefault(r["source"], []).append(r)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in order:
        own = sorted(trees[s], key=lambda r: r["pos"])
        built[s] = (own, grown([r["node"] for r in own], height(len(own))))
    over = grown([built[s][1][-1][0] for s in order], height(len(order)))
    up, out = steps(over), []
    for k, s in enumerate(order):
        own, levels = built[s]
        inner = steps(levels)
        rest = [(left[k // FAN**j], right[k // FAN**j]) for j, (left, right) in enumerate(up)]
        for i, r in enumerate(own):
            path = [(left[i // FAN**j], right[i // FAN**j]) for j, (left, right) in enumerate(inner)]
            out.append((s, r["pos"], path + rest, levels[-1][0], over[-1][0]))
    return out


def _above(nodes: DataFrame, most: int) -> DataFrame:
    """source, pos, path, subroot and root of stored nodes(source, pos, node, total), which are whole trees' levels."""
    spark, schema = nodes.sparkSession, f"source string, pos long, path {_PATH}, subroot string, root string"
    if nodes.count() <= most:
        return F.broadcast(spark.createDataFrame(upper_tree(nodes.collect()), schema))  # at most `most` rows, a step per level each
    if nodes.where("total > 1").limit(1).count():
        return stored(_joined(nodes, _above(stored(_reduced(nodes), "merkle-nodes"), most)).select("source", "pos", "path", "subroot", "root"), "merkle-paths")
    # Each source is down to its subroot, and there are more of these than the driver is to hold: one tree of them all.
    subroots = numbered(nodes.select("source", "node"), [F.col("source").asc_nulls_first()], "merkle-subroots")
    one = stored(subroots.select(F.lit(None).cast("string").alias("source"), F.col("number").alias("pos"), "node", F.lit(nodes.count()).alias("total")), "merkle-nodes")
    up = _above(one, most).select(F.col("pos").alias("number"), "path", "root")
    return stored(subroots.join(up, "number").select("source", F.lit(0).cast("long").alias("pos"), "path", F.col("node").alias("subroot"), "root"), "merkle-paths")


def _joined(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """nodes with whole paths, subroot and root: those within blocks, and those above them."""
    up = above.select(F.col("source").alias("source_"), F.col("pos").alias("pos_"), F.col("path").alias("path_"), "subroot", "root")
    both = _within(nodes).join(up, F.col("source").eqNullSafe(F.col("source_")) & (F.col("block") == F.col("pos_")))
    return both.withColumn("path", F.concat("path", "path_")).drop("source_", "pos_", "path_", "block")


def placed(rows: DataFrame) -> DataFrame:
    """rows(doc_id, source, node, ...) with pos, the place within the source, and total, the source's rows."""
    rows = stored(rows.withColumn("row_", F.monotonically_increasing_id()), "merkle-leaves")  # row_ parts rows that are alike in all else
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "node", "row_"]
    laid = stored(rows.orderBy(*order).withColumn("at_", F.monotonically_increasing_id()).drop("row_"), "merkle-leaves")
    part = F.shiftright("at_", 33)
    runs = laid.groupBy(part.alias("part_"), F.col("source").alias("source_")).agg(F.count("*").alias("n"), F.min("at_").alias("first"))
    w = Window.partitionBy("source_")  # a row per partition that the source reaches into
    ahead = F.coalesce(F.sum("n").over(w.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = stored(runs.select("part_", "source_", (ahead - F.col("first")).alias("by"), F.sum("n").over(w).alias("total")), "merkle-runs")
    put = laid.join(light(runs), (part == F.col("part_")) & F.col("source").eqNullSafe(F.col("source_")))
    return put.withColumn("pos", F.col("at_") + F.col("by")).drop("part_", "source_", "at_", "by")


def manifest(docs: DataFrame, seen: dict[str, Column] | None = None, most: int = TOP) -> DataFrame:
    """doc_id, source, leaf, seen_leaf, path, subroot and root of every row of docs.

    seen: columns as a later reader has them, where they differ; seen_leaf is the leaf of the row with these."""
    own = [docs[c] for c in COLUMNS]
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), leaf_of(own).alias("node"),
        (leaf_of([(seen or {}).get(c, docs[c]) for c in COLUMNS]) if seen else F.lit(None).cast("string")).alias("seen"),
    )
    leaves = placed(rows.withColumn("seen", F.when(F.col("seen") != F.col("node"), F.col("seen"))))
    first = stored(_reduced(leaves), "merkle-nodes")
    out = _joined(leaves.select("doc_id", "source", "node", "seen", "pos", "total"), _above(first, most))
    return out.select("doc_id", "source", F.col("node").alias("leaf"), F.coalesce("seen", "node").alias("seen_leaf"), "path", "subroot", "root")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives along its path."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_hash(path: Column) -> Column:
    """The hash of a path's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def verified(made: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of a manifest: each row folded from the leaf that was seen."""
    root = folded(F.col("seen_leaf"), F.col("path")).alias("folded_root")
    out = made.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), root)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
