"""Sequence packing by non-negative least squares.

A document's ids (the vocabulary's, then END_ID) are cut into whole windows of 2048, one body whose
length is a multiple of UNIT, and a tail shorter than UNIT. Whole windows are sequences of their own.
Bodies: all combinations of at most three lengths that fill a window exactly are enumerated, their
repeat counts are solved against the histogram of body lengths by non-negative least squares, rounded
down and reduced until no length is used more often than it occurs. What is left, and the tails, are
packed greedily: laid end to end and cut every 2048 ids. So only the last sequence is padded.

Only the histogram (at most 128 + 15 lengths and the count of whole windows) reaches the driver. A
piece's place follows from its length and its rank among pieces of that length; ranks are counted
within a task and completed by a sum over tasks, so no length, however frequent, meets in one task.

A null text is an empty document: its only id is END_ID. Rows repeat freely, each packed for itself; a
null doc_id stays null. Texts are encoded whole, whatever their length. Pieces of equal length are alike, in the order
of tasks. Other columns are not read. An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beamlake.llm.common import stored

WINDOW, UNIT, END_ID = 2048, 16, 1
#: The same vocabulary as byte_bpe_50k.json, as ranks; it gives the same ids several times as fast.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The added token of byte_bpe_50k.json and its id, which is no rank: as the contract calls the tokenizer, its string in a text is this token.
SPECIAL = {"<|endoftext|>": 50256}

_CUT = "doc_id long, start long, length long, doc_tokens long, kind int, task int, rank long, crc long, ids binary"


@functools.cache
def encoder(name: str = VOCABULARY):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def encode(text: str | None, name: str = VOCABULARY) -> np.ndarray:
    ids = encoder(name).encode(text, allowed_special="all") if text else []
    return np.array([*ids, END_ID], dtype="<u4")


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def cut(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """One row per piece: kind is its length (2048, a multiple of 16, or less than 16); rank is its
    number among the task's pieces of that kind. Bodies and tails carry their ids, 2 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), Counter()
        part = None
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows: list[tuple] = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encode(text, name)
                    n = len(ids)
                    whole, body = n // WINDOW * WINDOW, n // UNIT * UNIT
                    for s, e in [*((i, i + WINDOW) for i in range(0, whole, WINDOW)), (whole, body), (body, n)]:
                        if e > s:
                            keep = None if e - s == WINDOW else ids[s:e].astype("<u2").tobytes()
                            rows.append((doc, s, e - s, n, e - s, task, seen[e - s], crc(ids[s:e]), keep))
                            seen[e - s] += 1
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                    names = [f.split()[0] for f in _CUT.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            b = part = None  # not held while the next one arrives

    return docs.select("doc_id", "text").mapInArrow(run, _CUT)


def combinations(units: int) -> list[tuple[int, ...]]:
    """Every combination of at most three lengths, in units, that sums to the window."""
    out: list[tuple[int, ...]] = [(a, units - a) for a in range(1, units // 2 + 1)]
    out += [(a, b, units - a - b) for a, b in combinations_with_replacement(range(1, units), 2) if units - a - b >= b]
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 0) -> np.ndarray:
    """min |ax - b| over x >= 0, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, dtype=bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    gram, right = a.T @ a, a.T @ b
    for _ in range(rounds or 30 * a.shape[0]):  # far more than are needed; what is left is packed greedily in any case
        w = right - gram @ x
        w[passive] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= tolerance:
            break
        passive[j] = True
        while True:
            own = np.flatnonzero(passive)
            s = np.linalg.solve(gram[np.ix_(own, own)] + 1e-10 * np.eye(len(own)), right[own])
            if s.min() > 0:
                x[:] = 0
                x[own] = s
                break
            down = own[s <= 0]
            before = x[down]
            step = np.min(before / np.maximum(before - s[s <= 0], 1e-300))
            x[own] += step * (s - x[own])
            passive &= x > tolerance
            x[~passive] = 0
            if not passive.any():
                break
    return x


def plan(histogram: dict[int, int]) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of body lengths with whole repeat counts that the histogram can fill."""
    units = WINDOW // UNIT
    have = np.array([histogram.get(u * UNIT, 0) for u in range(1, units)], dtype=float)
    if not have.any():
        return []
    ways = [c for c in combinations(units) if all(have[u - 1] >= c.count(u) for u in c)]
    if not ways:
        return []
    a = np.zeros((len(have), len(ways)))
    for j, c in enumerate(ways):
        for u in c:
            a[u - 1, j] += 1
    counts = np.floor(nnls(a, have) + 1e-6)
    used = a @ counts
    for u in np.flatnonzero(used > have):
        for j in np.argsort(-counts):
            if a[u, j] and used[u] > have[u]:
                take = min(counts[j], np.ceil((used[u] - have[u]) / a[u, j]))
                counts[j] -= take
                used -= take * a[:, j]
    left = have - used
    for j in range(len(ways)):  # what rounding down has left over
        more = min(left[u - 1] // a[u - 1, j] for u in ways[j])
        if more > 0:
            counts[j] += more
            left -= more * a[:, j]
    return [(tuple(u * UNIT for u in c), int(k)) for c, k in zip(ways, counts, strict=True) if k > 0]


def layout(histogram: dict[int, int]) -> list[tuple[int, int, int, int, int, int]]:
    """(kind, first rank, last rank + 1, first sequence, offset, first place): of pieces of a kind by rank.

    In a planned slot a piece of rank r is in sequence `first sequence + r - first rank`, at `offset`.
    Other pieces have a place: the number of ids before them in the line that is cut every 2048 ids.
    """
    used: Counter = Counter()
    slots, sequence = [], histogram.get(WINDOW, 0)
    if sequence:
        slots.append((WINDOW, 0, sequence, 0, 0, -1))
    for lengths, repeats in plan(histogram):
        offset = 0
        for n in lengths:
            slots.append((n, used[n], used[n] + repeats, sequence, offset, -1))
            used[n] += repeats
            offset += n
        sequence += repeats
    place = 0
    for n in sorted((k for k in histogram if k < WINDOW), key=lambda k: (k < UNIT, -k)):
        rest = histogram[n] - used[n]
        if rest:
            slots.append((n, used[n], histogram[n], sequence, -1, place))
            place += rest * n
    return slots


def pack(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    spark = docs.sparkSession
    pieces = stored(cut(docs, name), "packing-pieces")
    counts = pieces.groupBy("kind", "task").count()
    histogram = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum("count").alias("n")).collect()}
    before = counts.select(
        "kind", "task", F.coalesce(F.sum("count").over(Window.partitionBy("kind").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier")
    )
    schema = "slot_kind int, low long, high long, first long, at long, place long"
    slots = F.broadcast(spark.createDataFrame(layout(histogram), schema))  # a few rows per combination used
    ranked = pieces.join(before, ["kind", "task"]).withColumn("rank", F.col("rank") + F.col("earlier"))
    put = ranked.join(slots, (F.col("kind") == F.col("slot_kind")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    nth = F.col("rank") - F.col("low")
    # At most one cut falls into a piece shorter than the window.
    put = put.withColumn("from", F.col("place") + nth * F.col("length"))
    cut_at = WINDOW - F.pmod(F.col("from"), F.lit(WINDOW))
    part = F.struct
    whole = F.array(part(F.lit(0).cast("long").alias("skip"), F.col("length").alias("take")))
    halves = F.array(part(F.lit(0).cast("long").alias("skip"), cut_at.alias("take")), part(cut_at.alias("skip"), (F.col("length") - cut_at).alias("take")))
    put = put.withColumn("part", F.explode(F.when((F.col("at") >= 0) | (cut_at >= F.col("length")), whole).otherwise(halves)))
    skip, take, line = F.col("part.skip"), F.col("part.take"), F.col("from") + F.col("part.skip")
    # ids as unsigned 32-bit: two bytes kept, two of zero between them
    wide = F.unhex(F.regexp_replace(F.hex(F.substring(F.col("ids"), (2 * skip + 1).cast("int"), (2 * take).cast("int"))), "(.{4})", "$10000"))
    return put.select(
        "doc_id",
        (F.col("start") + skip).alias("start"),
        take.alias("length"),
        F.when(take == F.col("length"), F.col("crc")).otherwise(F.crc32(wide)).alias("ids_crc32"),
        "doc_tokens",
        F.when(F.col("at") >= 0, F.col("first") + nth).otherwise(F.col("first") + F.floor(line / WINDOW)).cast("long").alias("sequence_id"),
        F.when(F.col("at") >= 0, F.col("at")).otherwise(F.pmod(line, F.lit(WINDOW))).cast("long").alias("offset"),
    )
