"""Arrivals decided on the energy that is there: a store per device that samples fill and searches drain, kept as stream state.

A row is a sample (raw is its 12 bits) or an arrival (raw is null). A sample sets the store to what its voltage makes available, a measurement
being better than a sum. An arrival gets the highest gear whose bytes the store can pay, and drains it by their price; if it can't even pay the lowest,
the arrival waits: gear is WAIT, nothing is drained, and it is the source's to send it again. Before the first sample a store is empty.

State is three numbers per device. Within a micro-batch a device's rows are taken in the order of (ts, event_id); rows that come in a later batch
are taken then, whatever their time. So a run over batches that follow each other in time equals a fold over all rows, which `decide` is.
Null devices are one device; rows without a time come first; a repeated row is decided again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from beamlake.config import CAPACITANCE, EFFICIENCY, GEARS, MICRO, UJ_PER_BYTE, V_OFF
from beamlake.functions.energy import WAIT, voltage

OUT = "device bigint, event_id bigint, seq bigint, gear int, energy_uj double"
STATE = "energy double, seq bigint"
_COSTS = [(gear, cost) for gear, cost, *_ in sorted(GEARS, reverse=True)]


def fold(rows: pd.DataFrame, energy: float, seq: int) -> tuple[pd.DataFrame, float, int]:
    """Decisions on a device's rows(device, event_id, ts, volts), and its store and number of arrivals after them."""
    order = np.lexsort((_nulls_first(rows["event_id"]), _nulls_first(rows["ts"])))  # stable
    at, seqs, gears, left = [], [], [], []
    for i, volts in zip(order.tolist(), rows["volts"].to_numpy(dtype="float64", na_value=np.nan)[order].tolist(), strict=True):
        if volts == volts:
            energy = CAPACITANCE * MICRO * EFFICIENCY * (volts * volts - V_OFF * V_OFF) if volts > V_OFF else 0.0
            continue
        budget = math.floor(energy / UJ_PER_BYTE)
        gear, cost = next(((g, c) for g, c in _COSTS if budget >= c), (WAIT, 0))
        energy -= cost * UJ_PER_BYTE
        at.append(i)
        seqs.append(seq)
        gears.append(gear)
        left.append(energy)
        seq += 1
    made = {c: _whole(rows[c], at) for c in ("device", "event_id")}
    made |= {"seq": np.array(seqs, np.int64), "gear": np.array(gears, np.int32), "energy_uj": np.array(left, np.float64)}
    return pd.DataFrame(made), energy, seq


def _nulls_first(s: pd.Series) -> np.ndarray:
    """Values to sort by; nulls are least. A device has few rows, for which sorting a frame costs more than all the rest."""
    a = s.to_numpy()
    if a.dtype.kind == "M":
        return a.view(np.int64)  # the null of times is the least number
    return a if a.dtype.kind in "iu" else s.to_numpy(dtype="float64", na_value=-np.inf)


def _whole(s: pd.Series, at: list[int]):
    """Whole numbers at places, nulls where they are null."""
    a = s.to_numpy()
    return a[at].astype(np.int64) if a.dtype.kind in "iu" else s.iloc[at].astype("Int64").array


def _prepared(events: DataFrame) -> DataFrame:
    return events.select(F.col("device").cast("bigint").alias("device"), F.col("event_id").cast("bigint").alias("event_id"), "ts", voltage(F.col("raw")).alias("volts"))


def decide(events: DataFrame) -> DataFrame:
    """OUT of a table of events(device, event_id, ts, raw): a row per arrival. A device's rows meet in one task, as its store is one after the other."""
    return _prepared(events).groupBy("device").applyInPandas(lambda rows: fold(rows, 0.0, 0)[0], OUT)


def decided(events: DataFrame) -> DataFrame:
    """OUT of a stream of events, by state per device."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        energy, seq = state.get if state.exists else (0.0, 0)
        all_ = list(parts)
        out, energy, seq = fold(all_[0] if len(all_) == 1 else pd.concat(all_, ignore_index=True), energy, seq)
        state.update((energy, seq))
        if len(out):
            yield out

    return _prepared(events).groupBy("device").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def decide_stream(events: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write decisions by batch; a batch that runs again after a failure replaces its own."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    w = decided(events).writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
