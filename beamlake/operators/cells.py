"""Neighbour graph by partition trees: no pair of rows is compared that no tree puts into one cell.

Each of TREES trees splits its rows by pivots, a few rows of a cell that are chosen by a hash: every row moves to the child of its nearest
pivot, until a cell holds at most LEAF rows. A round splits all cells of all trees that are still too large, and finds pivots by a window
whose limit is applied before its shuffle; rows of a large cell meet its pivots in salted groups of at most TASK rows. A cell whose rows are
too alike to be parted by pivots is dealt out by a hash, so rounds end. The cells that result are compared in full, one task each, and the
lists of all trees are merged.

Work is rows x trees x (LEAF + pivots x rounds), in proportion to the rows but for the logarithm of the rounds, and no row is copied more
than once per tree. A part with at most LEAF rows is one cell, and its lists are exact.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamlake.operators.blocked import l2_block, nearest
from beamlake.operators.tables import drop_stored, stored

#: Rows of a cell that are compared in full; trees; pivots of a cell at most; rows that meet their pivots in one task.
LEAF, TREES, PIVOTS, TASK = 1_024, 8, 16, 16_384

_CELL = ["part", "tree", "cell"]


def _hash(*by: Column | str) -> Column:
    return F.xxhash64(*by)


def _dealt(rows: pa.Table, pivots: pa.Table) -> pa.Table:
    """rows of a cell with child, the number of the nearest pivot (ties to the earlier one), and head, its vec_id.

    Rows that pivots could not part before are dealt to them by a hash."""
    n = rows.num_rows
    if not n:
        return rows.select(_MOVED)
    pivots = pivots.sort_by("number")
    if rows.column("stuck")[0].as_py():
        mixed = rows.column("vec_id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        child = (mixed >> np.uint64(33)).astype(np.int64) % pivots.num_rows
    else:
        child = l2_block(pivots, rows).argmin(axis=1)
    rows = rows.append_column("child", pa.array(child, pa.int32()))
    return rows.append_column("head", pivots.column("pivot").take(pa.array(child))).select(_MOVED)


_MOVED = [*_CELL, "vec_id", "vec", "size", "child", "head"]


def _split(vectors: DataFrame, leaf: int, trees: int) -> tuple[DataFrame, DataFrame]:
    """Cells (part, tree, cell, vec_id, vec, head) of at most `leaf` rows, and links (part, tree, head, vec_id): from the row whose cell was
    split to the pivots of its parts, from null for a tree's first cell. A cell's head is its pivot."""
    counts = vectors.groupBy("part").agg(F.when(F.count("*") <= leaf, 0).otherwise(trees - 1).alias("last"))  # one cell is the same in any tree
    tree = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("tree")
    zero = F.lit(0).cast("long")
    state = vectors.join(counts, "part").select("part", tree, zero.alias("cell"), "vec_id", "vec", zero.alias("was"), F.lit(None).cast("long").alias("head"))
    state, done, links = stored(state, "cells"), [], []
    while True:
        sizes = state.groupBy(*_CELL).agg(F.count("*").alias("size"), F.max("was").alias("was"))
        stuck = ((F.col("was") > 0) & (F.col("size") > 0.9 * F.col("was"))).alias("stuck")
        large = stored(sizes.where(F.col("size") > leaf).select(*_CELL, "size", stuck), "cell-sizes")
        small = state.join(large.select(*_CELL), _CELL, "left_anti").select(*_CELL, "vec_id", "vec", "head")
        if large.limit(1).count() == 0:
            done.append(small)
            return functools.reduce(DataFrame.unionByName, done), functools.reduce(DataFrame.unionByName, links) if links else small.where("1 = 0").select("part", "tree", "head", "vec_id")
        done.append(stored(small, "cells-done"))
        rows = state.drop("was").join(large, _CELL)
        # As many pivots as make cells of about half a leaf, at most PIVOTS.
        wanted = F.greatest(F.lit(2), F.least(F.lit(PIVOTS), F.ceil(2 * F.col("size") / leaf)))
        number = F.row_number().over(Window.partitionBy(*_CELL).orderBy(_hash("vec_id", "cell", "tree"), "vec_id"))
        chosen = rows.withColumn("number", number).where((F.col("number") <= PIVOTS) & (F.col("number") <= wanted))
        chosen = stored(chosen.select(*_CELL, "head", F.col("vec_id").alias("pivot"), "vec", "number", "size"), "cell-pivots")
        links.append(chosen.select("part", "tree", "head", F.col("pivot").alias("vec_id")))
        salts = F.ceil(F.col("size") / TASK).cast("int")
        by = [*_CELL, "salt"]
        pivots = chosen.select(*_CELL, "pivot", "vec", "number", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        salted = rows.drop("head").withColumn("salt", F.pmod(_hash("vec_id"), salts).cast("int"))
        schema = "part int, tree int, cell long, vec_id long, vec array<int>, size long, child int, head long"
        moved = salted.groupBy(*by).cogroup(pivots.groupBy(*by)).applyInArrow(_dealt, schema)
        after = stored(moved.select("part", "tree", _hash("cell", F.col("child") + 1).alias("cell"), "vec_id", "vec", F.col("size").alias("was"), "head"), "cells")
        drop_stored(state)
        state = after


def cells(vectors: DataFrame, leaf: int | None = None, trees: int | None = None) -> DataFrame:
    """part, tree, cell, vec_id, vec of vectors(part, vec_id, vec), where no cell has more than `leaf` rows. Parts are never mixed."""
    return _split(vectors, leaf or LEAF, trees or TREES)[0].drop("head")


def routes(vectors: DataFrame) -> DataFrame:
    """part, head, vec_id: links along which every row of vectors(part, vec_id, vec) is reached from the rows whose head is null.

    One tree whose cells are split down to PIVOTS rows: a pivot leads to the pivots of its cell's parts, and at the end to its cell's rows. So a
    search that begins at the top comes near its query in steps of the logarithm of the rows, whether or not near rows link rows that lie apart."""
    ends, links = _split(vectors, PIVOTS, 1)
    every = links.unionByName(ends.select("part", "tree", "head", "vec_id")).where(F.col("head").isNull() | (F.col("head") != F.col("vec_id")))
    return every.select("part", "head", "vec_id").distinct()


def _lists(rows: pa.Table, degree: int) -> pa.Table:
    """vec_id and its nearest others of the cell, as (dist, vec_id), nearest first."""
    rows = rows.sort_by("vec_id")
    ids = rows.column("vec_id").to_numpy()
    sizes, dist, other = [np.zeros(1, np.int64)], [], []
    for i in range(0, len(ids), 256):
        part = rows.slice(i, 256)
        itself = np.arange(i, i + part.num_rows)[:, None] == np.arange(len(ids))
        d, place = nearest(l2_block(rows, part), degree, itself)
        found = place >= 0
        sizes.append(found.sum(axis=1))
        dist.append(d[found])
        other.append(ids[place[found]])
    flat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
    near = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), pa.StructArray.from_arrays([flat(dist), flat(other)], names=["dist", "vec_id"]))
    return pa.table({"part": rows.column("part"), "vec_id": rows.column("vec_id"), "near": near})


def cell_lists(placed: DataFrame, degree: int) -> DataFrame:
    """part, vec_id and near, the `degree` nearest of all cells that a row is in, as (dist, vec_id), nearest first, ties to the smaller id."""
    near = "array<struct<dist:bigint,vec_id:bigint>>"
    each = placed.groupBy(*_CELL).applyInArrow(lambda t: _lists(t, degree), f"part int, vec_id long, near {near}")
    trees = each.groupBy("part", "vec_id").agg(F.flatten(F.collect_list("near")).alias("near"))  # a list per tree

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                yield _merged(b.slice(i, 512), degree)

    return trees.mapInArrow(run, f"part int, vec_id long, near {near}")


def _merged(b: pa.RecordBatch, degree: int) -> pa.RecordBatch:
    """The lists of a batch sorted, each entry once, and cut to `degree`."""
    near = b.column(2)
    each = near.flatten()
    dist, other = (each.field(k).to_numpy(zero_copy_only=False) for k in range(2))
    row = np.repeat(np.arange(b.num_rows), np.diff(near.offsets.to_numpy()))
    order = np.lexsort((other, dist, row))
    row, dist, other = row[order], dist[order], other[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (dist[1:] != dist[:-1]) | (other[1:] != other[:-1])
    row, dist, other = row[new], dist[new], other[new]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < degree
    ends = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=b.num_rows))])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(dist[kept]), pa.array(other[kept])], names=["dist", "vec_id"]))
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["part", "vec_id", "near"])


def cell_graph(vectors: DataFrame, degree: int, leaf: int | None = None, trees: int | None = None) -> DataFrame:
    """vec_id and its neighbors, nearest first, of vectors(vec_id, vec), or by part where vectors have one."""
    v = vectors.select(F.col("part") if "part" in vectors.columns else F.lit(0).alias("part"), "vec_id", "vec")
    return cell_lists(cells(v, leaf, trees), degree).select("vec_id", F.transform("near", lambda x: x["vec_id"]).alias("neighbors"))


def compared(placed: DataFrame) -> int:
    """Pairs that the cells compare, either way round."""
    n = placed.groupBy(*_CELL).agg(F.count("*").alias("n"))
    return int(n.agg(F.sum(F.col("n") * (F.col("n") - 1))).first()[0] or 0)
