"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the session names none, a local master gets a folder of this machine; a cluster has no such folder, so
    that is an error there."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            where = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir()


def stored(df: DataFrame, name: str, rows: int | None = None, per_file: int = 20_000) -> DataFrame:
    """Write df as Parquet and read it again: cuts lineage, and survives lost executors.

    What is not deleted before goes when the driver ends. rows: a bound of its rows, where one is known; then there are no more files than `per_file` rows each ask for, so that a
    small table isn't strewn over as many files as a shuffle has partitions."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // per_file)))
    df.write.parquet(path)
    fs, p = _file_system(df.sparkSession, path)
    fs.deleteOnExit(p)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop_stored(df: DataFrame) -> None:
    """Delete a table written by stored(), once nothing reads it any more."""
    files = df.inputFiles()
    if files:
        fs, p = _file_system(df.sparkSession, files[0].rsplit("/", 1)[0])
        fs.delete(p, True)
