"""Counters and the end-of-run profile as ordinary results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamlake.config import DEGREE, DIM


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def bytes_model(searched: DataFrame, m: int, degree: int = DEGREE, dim: int = DIM) -> DataFrame:
    """query_id and modelled bytes: codes of scored vertices, lists and full vectors of expanded ones."""
    return searched.select(
        "query_id",
        (F.col("n_new") * m).cast("bigint").alias("code_bytes"),
        (F.col("hops") * degree * 4).cast("bigint").alias("list_bytes"),
        (F.col("hops") * dim * 2).cast("bigint").alias("vector_bytes"),
    ).withColumn("total_bytes", F.col("code_bytes") + F.col("list_bytes") + F.col("vector_bytes"))


def profile(searched: DataFrame) -> DataFrame:
    """One row: queries, hops, and ratios of the counters."""
    s = searched.agg(F.count("*").alias("n_query"), F.sum("hops").alias("n_hops"), F.sum("n_new").alias("n_new"), F.sum("n_dup").alias("n_dup"))
    return s.select(
        "n_query",
        "n_hops",
        "n_new",
        "n_dup",
        safe_divide(F.col("n_hops"), F.col("n_query")).alias("hops_per_query"),
        safe_divide(F.col("n_new"), F.col("n_hops")).alias("new_per_hop"),
        safe_divide(F.col("n_dup"), F.col("n_new") + F.col("n_dup")).alias("dup_ratio"),
    )


def observed(df: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """df, with metrics reported to listeners as it runs."""
    return df.observe(name, *[c.alias(k) for k, c in metrics.items()])


def phases(timers: DataFrame) -> DataFrame:
    """phase, calls, total, least, greatest, mean and share (of all phases' total) of timers(phase, elapsed). One row per phase."""
    each = timers.groupBy("phase").agg(F.count("*").alias("calls"), F.sum("elapsed").alias("total"), F.min("elapsed").alias("least"), F.max("elapsed").alias("greatest"))
    whole = each.agg(F.sum("total").alias("whole"))  # one row
    return each.crossJoin(F.broadcast(whole)).select("phase", "calls", "total", "least", "greatest", safe_divide(F.col("total"), F.col("calls")).alias("mean"), safe_divide(F.col("total"), F.col("whole")).alias("share"))
