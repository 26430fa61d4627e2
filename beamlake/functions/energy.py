"""Volts, energy, byte budgets and gears as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamlake.config import CAPACITANCE, EFFICIENCY, GEARS, MICRO, UJ_PER_BYTE, V_OFF

_FACTOR = CAPACITANCE * MICRO * EFFICIENCY


def voltage(raw: Column) -> Column:
    """Volts of a 12-bit sample against a 1.2 V reference behind a divider by four."""
    return raw.cast("double") * F.lit(1.2 * 4 / 4096)


def available_energy(v: Column) -> Column:
    """Microjoules above the volts at which work stops; 0 below."""
    return F.when(v > V_OFF, F.lit(_FACTOR) * (v * v - F.lit(V_OFF * V_OFF))).otherwise(F.lit(0.0))


def byte_budget(energy: Column) -> Column:
    return F.floor(energy / F.lit(UJ_PER_BYTE)).cast("bigint")


def adaptive_gear(v: Column) -> Column:
    """The highest gear whose cost, and that of all gears below it but gear 0, the budget covers; else 0."""
    budget = byte_budget(available_energy(v))
    steps = [F.when(budget >= cost, g) for g, cost, _, _ in GEARS if g > 0]
    return F.when(v <= V_OFF, 0).otherwise(reduce(lambda a, s: F.greatest(a, F.coalesce(s, F.lit(0))), steps, F.lit(0))).cast("int")


def gear_table(spark) -> DataFrame:
    return spark.createDataFrame(GEARS, "gear int, min_bytes bigint, l_size int, m int")


def with_gear(queries: DataFrame, policy: str = "adaptive", gear: int = 5, replay: DataFrame | None = None) -> DataFrame:
    """queries with gear, l_size and m. fixed: always `gear`; adaptive: from column voltage; replay: from
    replay(query_id, gear), gear 0 where it names none; power_event: gear 0."""
    if policy == "fixed":
        out = queries.withColumn("gear", F.lit(gear))
    elif policy == "power_event":
        out = queries.withColumn("gear", F.lit(0))
    elif policy == "adaptive":
        out = queries.withColumn("gear", adaptive_gear(F.col("voltage")))
    elif policy == "replay" and replay is not None:
        out = queries.join(replay.select("query_id", "gear"), "query_id", "left").withColumn("gear", F.coalesce("gear", F.lit(0)))
    else:
        raise ValueError(f"unknown policy {policy}, or replay without its table")
    table = gear_table(queries.sparkSession).select("gear", "l_size", "m")  # six rows
    return out.join(F.broadcast(table), "gear")


#: A log row's op before its query has been decided, and while it waits for energy.
PENDING, WAIT = 0xFF, 0xFE


def voltage_log(samples: DataFrame) -> DataFrame:
    """samples(seq, query_id, raw, voltage) with op: WAIT where the capacitor holds no usable energy, else PENDING."""
    return samples.withColumn("op", F.when(available_energy(F.col("voltage")) <= 0, F.lit(WAIT)).otherwise(F.lit(PENDING)))


def tagged(log: DataFrame, gears: DataFrame) -> DataFrame:
    """log, with the gear of gears(query_id, gear) in the last pending row of each query."""
    last = log.where(F.col("op") == PENDING).groupBy("query_id").agg(F.max("seq").alias("seq")).join(gears.select("query_id", F.col("gear").alias("own_")), "query_id")
    return log.join(last.select("seq", "query_id", "own_"), ["seq", "query_id"], "left").withColumn("op", F.coalesce("own_", "op").cast("int")).drop("own_")
