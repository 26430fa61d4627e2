"""Progress that survives an interrupted batch: generations of results, each published by a marker written last."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beamlake.operators.measure import Phases, folder_bytes
from beamlake.sources.files import FileStore


class Progress:
    """Results under `path`: gen=<name>/ folders, and committed/<name> markers, in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str, phases: Phases | None = None):
        self.spark, self.path, self.store, self.phases = spark, path.rstrip("/"), FileStore(spark), phases or Phases(spark)

    def generations(self) -> list[str]:
        folder = f"{self.path}/committed"
        return sorted(self.store.names(folder)) if self.store.exists(folder) else []

    def commit(self, results: DataFrame, attempts: DataFrame | None = None) -> str:
        """Write a generation, then publish it. Without its marker a generation does not count."""
        name = f"{len(self.generations()):06d}-{uuid.uuid4().hex[:8]}"
        with self.phases.of("commit") as call:
            call.counted(results).write.parquet(f"{self.path}/gen={name}/results")
            if attempts is not None:
                attempts.write.parquet(f"{self.path}/gen={name}/attempts")
            self.store.write_text(f"{self.path}/committed/{name}", "complete")
            call.touched(folder_bytes(self.spark, f"{self.path}/gen={name}/results"))
        return name

    def restore(self) -> DataFrame | None:
        """All committed results; None for a cold start. A marker whose generation is missing is an error."""
        with self.phases.of("restore") as call:
            names = self.generations()
            for n in names:
                if not self.store.exists(f"{self.path}/gen={n}/results/_SUCCESS"):
                    raise RuntimeError(f"generation {n} is published but incomplete")
                call.touched(folder_bytes(self.spark, f"{self.path}/gen={n}/results"))
            return self.spark.read.parquet(*[f"{self.path}/gen={n}/results" for n in names]) if names else None

    def pending(self, queries: DataFrame) -> DataFrame:
        done = self.restore()
        return queries if done is None else queries.join(done.select("query_id").distinct(), "query_id", "left_anti")

    def run(self, queries: DataFrame, work: Callable[[DataFrame], DataFrame], parts: int = 4, part: Column | None = None, stop_after: int | None = None, fail: bool = False) -> DataFrame | None:
        """Work on the pending queries in parts, committing each; a rerun continues after the last commit.

        Each attempt at a part is written before its work starts, so a run that dies in between has left it behind. `part`
        deals queries to parts 0 to parts - 1. stop_after ends the run after so many commits; with `fail` the next part is attempted
        and not committed, as in a power failure."""
        part = F.pmod(F.xxhash64("query_id"), F.lit(parts)) if part is None else part
        done = 0
        for nth in range(parts):
            own = self.pending(queries).where(part == nth)
            if not own.limit(1).count():
                continue
            last = stop_after is not None and done >= stop_after
            if last and not fail:
                break
            with self.phases.of("attempt") as call:
                call.counted(own.select("query_id")).write.parquet(f"{self.path}/attempts/{nth:04d}-{uuid.uuid4().hex[:8]}")
            if last:
                break
            self.commit(work(own))
            done += 1
        return self.restore()

    def attempts(self) -> DataFrame:
        """query_id and attempts of every query that a run has started on."""
        folder = f"{self.path}/attempts"
        if not self.store.exists(folder):
            return self.spark.createDataFrame([], "query_id bigint, attempts bigint")
        each = self.spark.read.schema("query_id bigint").parquet(*[f"{folder}/{n}" for n in self.store.names(folder)])
        return each.groupBy("query_id").agg(F.count("*").alias("attempts"))


def attempt_stats(attempts: DataFrame) -> DataFrame:
    """queries, missed (restarted at least once) and restarts of attempts(query_id, attempts)."""
    return attempts.agg(
        F.count("*").alias("queries"), F.sum(F.when(F.col("attempts") > 1, 1).otherwise(0)).alias("missed"), F.sum(F.col("attempts") - 1).alias("restarts")
    )
