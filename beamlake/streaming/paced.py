"""Queries that arrive over time: a paced source, and searches per micro-batch with a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from beamlake.config import SearchConfig
from beamlake.operators.search import Index, ann_search, held
from beamlake.operators.tables import stored


def arrivals(spark: SparkSession, per_second: int, query_count: int) -> DataFrame:
    """A stream of arrival, query_id: so many a second, in turn over query_count queries."""
    s = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return s.select(F.col("timestamp").alias("arrival"), F.col("value").alias("seq"), F.pmod("value", F.lit(query_count)).alias("query_id"))


def schedule(queries: DataFrame, per_second: int) -> DataFrame:
    """query_id, seq and due_ms of a batch that arrives at a fixed rate, in the order of query_id.

    seq numbers the sorted queries: a range partitioning, with counts of the parts before, so no task numbers them all."""
    ranges = stored(queries.select("query_id").orderBy("query_id").withColumn("number", F.monotonically_increasing_id()), "arrivals")
    part = F.shiftright("number", 33).alias("part")
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = ranges.groupBy(part).agg(F.count("*").alias("n"), F.min("number").alias("first")).select("part", "first", ahead.alias("ahead"))  # a row per part
    put = ranges.join(F.broadcast(runs), F.shiftright("number", 33) == F.col("part")).withColumn("seq", F.col("number") - F.col("first") + F.col("ahead"))
    return put.select("query_id", "seq", F.floor(F.col("seq") * 1000 / per_second).cast("bigint").alias("due_ms"))


def queries_from(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of query_id, vec from the Parquet files that appear in a folder."""
    return spark.readStream.schema("query_id bigint, vec array<int>").option("maxFilesPerTrigger", 4).parquet(folder)


def search_stream(queries: DataFrame, index: Index, cfg: SearchConfig, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Search each micro-batch and write results by batch; a batch that runs again after a failure replaces its own.

    The index is sent to the workers once, before the stream starts."""
    ready = held(index, cfg.m, cfg.degree)

    def one(batch: DataFrame, batch_id: int) -> None:
        found = ann_search(batch.select("query_id", "vec"), index, cfg, ready=ready)
        found.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    w = queries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def voltage_by_minute(samples: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Mean and least volts per minute of samples(ts, voltage), batch or stream, late rows up to the watermark."""
    s = samples.withWatermark("ts", late) if samples.isStreaming else samples
    return s.groupBy(F.window("ts", "1 minute").alias("w")).agg(F.avg("voltage").alias("mean_v"), F.min("voltage").alias("min_v"), F.count("*").alias("n")).select(
        F.col("w.start").alias("minute"), "mean_v", "min_v", "n"
    )
