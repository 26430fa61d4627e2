"""Shared helpers: table access, the cluster's shared folder, and word rules."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beamlake.operators.tables import drop_stored, shared_dir, stored

__all__ = ["BROADCAST_BYTES", "Kept", "NOT_WORD", "WORD", "crc_mod", "drop_path", "drop_stored", "in_slices", "kept", "light", "new_path", "numbered", "packed", "shared_dir", "stored", "table", "text_key", "unpacked", "wider", "words_of"]

#: A word is a run of letters, digits and combining marks; case never matters.
WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")
#: The same rule for Java's regular expressions.
NOT_WORD = r"[^\p{L}\p{N}\p{M}]+"
#: Bytes of a table, after a count, up to which it is broadcast.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row of df takes."""
    size = F.lit(16 + 16 * len(df.columns))
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            size = size + 16 * F.greatest(F.size(f.name), F.lit(0))
            if isinstance(f.dataType.elementType, T.StringType):
                size = size + F.aggregate(F.coalesce(f.name, F.array().cast("array<string>")), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.octet_length(x), F.lit(0)))
    return size.cast("long")


def light(df: DataFrame, limit: int | None = None) -> DataFrame:
    """df, marked for broadcast where a pass over it (a stored table) has shown that its rows take at most `limit` bytes."""
    total = df.agg(F.sum(_row_bytes(df))).first()[0] or 0
    return F.broadcast(df) if total <= (BROADCAST_BYTES if limit is None else limit) else df


@dataclass
class Kept:
    """A stored table, and what was counted as it was written: rows, bytes (None if not asked for), and any other aggregates."""

    table: DataFrame
    rows: int
    bytes: int | None
    more: dict

    def light(self, part: DataFrame | None = None) -> DataFrame:
        """The table, or a part of it, as light() gives it; without a pass where the whole is known to be small enough."""
        df = self.table if part is None else part
        return F.broadcast(df) if self.bytes is not None and self.bytes <= BROADCAST_BYTES else light(df)


def kept(df: DataFrame, name: str, rows: int | None = None, per_file: int = 20_000, weigh: bool = True, **more: Column) -> Kept:
    """stored(), with counts that the writing job makes, so that they take no jobs of their own. more: aggregates of df."""
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("rows_"), *([F.sum(_row_bytes(df)).alias("bytes_")] if weigh else []), *[c.alias(k) for k, c in more.items()]]
    table = stored(df.observe(seen, *counts), name, rows, per_file)
    found = seen.get
    return Kept(table, found["rows_"], (found["bytes_"] or 0) if weigh else None, {k: found[k] for k in more})


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df, stored in this order, with its number from 0: a range partitioning, and counts of the partitions before, so that no task
    numbers all rows. df is read twice (ranges are chosen from a sample): give a stored table."""
    rows = stored(df.orderBy(*order).withColumn("at_", F.monotonically_increasing_id()), name)
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy(F.shiftright("at_", 33).alias("part_")).agg(F.count("*").alias("n"), F.min("at_").alias("first"))  # a row per partition
    parts = parts.select("part_", (ahead - F.col("first")).alias("by"))
    put = rows.withColumn("part_", F.shiftright("at_", 33)).join(F.broadcast(parts), "part_")
    return put.withColumn("number", F.col("at_") + F.col("by")).drop("part_", "at_", "by")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def wider(df: DataFrame, **columns: str | T.DataType) -> T.StructType:
    """df's schema and more columns, as a new object: a DataFrame's own schema must not change."""
    out = T.StructType(list(df.schema.fields))
    for name, kind in columns.items():
        out = out.add(name, kind)
    return out


def in_slices(column: pa.Array, rows: int = 256) -> Iterator[list]:
    """A column's values as lists of a few rows, so that a batch is never held as Python objects at once."""
    for at in range(0, len(column), rows):
        yield column.slice(at, rows).to_pylist()


def packed(docs: DataFrame) -> DataFrame:
    """text, and all other columns in one struct, so that none clashes with what an operator adds."""
    return docs.select("text", F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row_"))


def unpacked(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of packed() again, in their order, some replaced."""
    return df.select(*[changed.get(c, F.col("text") if c == "text" else F.col("row_")[c]).alias(c) for c in columns])


def text_key(text: Column) -> list[Column]:
    """key1, key2: 128 bits that stand for a text."""
    return [F.xxhash64(text).alias("key1"), F.xxhash64(F.lit("second"), text).alias("key2")]


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo `modulus`; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)), F.lit(-1))


def words_of(text: Column) -> Column:
    """Lower-case words of a text, without the empty strings that split leaves."""
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")
