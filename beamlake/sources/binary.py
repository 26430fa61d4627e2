"""Headerless little-endian arrays: codebooks, means, vectors, neighbor lists, codes, queries, ground truth.

A file may come in parts, each of whole rows. A row's id is its position, so parts follow each other in the order of their
names, where digits count as numbers: VEC.2 comes before VEC.10. Both ways go through the data source of device.py: tasks read ranges of
whole rows, and write parts in the order of their keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamlake.config import CENTROIDS, DEGREE, DIM
from beamlake.sources import device
from beamlake.sources.device import LAYOUTS

__all__ = ["LAYOUTS", "codebook", "codes", "fake_ring", "read", "to_bytes", "write"]

#: Bytes of a range that one task reads; rows of a part that is written.
RANGE_BYTES, PART_ROWS = 64 << 20, 1_000_000


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of a file, or of a folder of parts, with their positions as ids."""
    return device.read(spark, path, name, RANGE_BYTES)


def write(df: DataFrame, name: str, path: str) -> None:
    """Rows in the order of their key, in parts of at most PART_ROWS under `path`."""
    device.write(df, name, path, PART_ROWS * device.row_bytes(LAYOUTS[name]))


def codebook(cells: DataFrame) -> DataFrame:
    """subspace, centroid, c of a codebook's cells, which are in that order."""
    return cells.select(F.floor(F.col("cell") / CENTROIDS).cast("int").alias("subspace"), F.pmod("cell", F.lit(CENTROIDS)).cast("int").alias("centroid"), "c")


def codes(short: DataFrame, long: DataFrame) -> DataFrame:
    """vec_id, pq16, pq32, joined by position."""
    return short.join(long, "vec_id")


def to_bytes(df: DataFrame, name: str) -> DataFrame:
    """id and packed bytes of each row, ready to be laid end to end in the order of ids."""
    lay = LAYOUTS[name]

    def run(batches):
        for b in batches:
            packed = [np.array(v).astype(lay.dtype).tobytes() for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], names=["id", "bytes"])

    return df.select(lay.key, lay.value).mapInArrow(run, "id bigint, bytes binary")


def fake_ring(spark: SparkSession, n: int = 100) -> dict[str, DataFrame]:
    """Identity workload: element d of every vector is d, vertex i points to the next DEGREE vertices, code s is s."""
    ids = spark.range(n).withColumnRenamed("id", "vec_id")
    row = lambda k, kind: F.expr(f"transform(sequence(0, {k - 1}), x -> cast(x as {kind}))")
    return {
        "vectors": ids.withColumn("vec", row(DIM, "int")),
        "graph": ids.withColumn("neighbors", F.transform(F.sequence(F.lit(1), F.lit(DEGREE)), lambda k: (F.col("vec_id") + k) % n)),
        "codes": ids.withColumn("pq16", row(16, "smallint")).withColumn("pq32", row(32, "smallint")),
        "queries": ids.select((F.col("vec_id")).alias("query_id"), row(DIM, "int").alias("vec")),
    }
