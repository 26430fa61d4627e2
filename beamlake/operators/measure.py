"""Phases of real runs: how often, how long, how many rows and bytes, as ordinary results.

A phase is timed where it runs, around the action that does its work; rows are counted inside that action by an Observation, without a job of
their own; bytes are those of the files it has written or is about to read. Of each call one small record is kept; `profile` sums them up.
Nested phases count in both. A phase that fails is recorded as failed, with its time.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from beamlake.operators.stats import safe_divide
from beamlake.sources.files import FileStore

CALLS = "phase string, elapsed_us bigint, rows bigint, bytes bigint, failed boolean"


@dataclass
class Call:
    """One call of a phase. counted() and touched() are for its body to say what it works on."""

    phase: str
    observed: list[Observation] = field(default_factory=list)
    bytes: int | None = None
    elapsed_us: int = 0
    failed: bool = False

    def counted(self, df: DataFrame) -> DataFrame:
        """df, whose rows are counted by the action that the phase runs on it."""
        o = Observation()
        self.observed.append(o)
        return df.observe(o, F.count(F.lit(1)).alias("rows"))

    def touched(self, size: int) -> None:
        self.bytes = (self.bytes or 0) + size

    def rows(self) -> int | None:
        return sum(o.get["rows"] for o in self.observed) if self.observed and not self.failed else None


class Phases:
    """Records of calls, in the order in which they ended."""

    def __init__(self, spark: SparkSession):
        self.spark, self.calls = spark, []

    @contextmanager
    def of(self, phase: str) -> Iterator[Call]:
        call, began = Call(phase), time.perf_counter_ns()
        try:
            yield call
        except BaseException:
            call.failed = True
            raise
        finally:
            call.elapsed_us = (time.perf_counter_ns() - began) // 1000
            self.calls.append(call)

    def table(self) -> DataFrame:
        """A row per call."""
        return self.spark.createDataFrame([(c.phase, c.elapsed_us, c.rows(), c.bytes, c.failed) for c in self.calls], CALLS)


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files right under a folder."""
    files = FileStore(spark)
    return sum(s["size"] for n in files.names(path) if not (s := files.stat(f"{path}/{n}"))["is_dir"])


def profile(calls: DataFrame) -> DataFrame:
    """phase, calls, failed, rows, bytes, and total, least, greatest, mean of the time and the rows per second, of a table of calls."""
    each = calls.groupBy("phase").agg(
        F.count("*").alias("calls"), F.sum(F.col("failed").cast("bigint")).alias("failed"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"),
        F.sum("elapsed_us").alias("total_us"), F.min("elapsed_us").alias("least_us"), F.max("elapsed_us").alias("greatest_us"),
    )
    return each.withColumns({"mean_us": safe_divide(F.col("total_us"), F.col("calls")), "rows_per_s": safe_divide(F.col("rows") * 1_000_000, F.col("total_us"))})
