"""As-of join: to each row of one table the last row of another at or before its time, by key.

Rows of both tables are laid out together by ranges of (keys, time), so a key of any size, or no key at all, spreads over many tasks. Within a range the
last right row is carried forward by a window; what a range can't see, it gets from the ranges before: the last right row of each (range, key),
of which there is one row per key and range it reaches into, is carried over the ranges by a second window. No task holds more than
a range of rows, or the ranges of one key.

At equal times a right row counts, and of several the one with the largest tie. Null times or keys of the left match nothing, those of the
right are never found. Left rows that repeat are rows each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamlake.operators.tables import stored


def asof_join(left: DataFrame, right: DataFrame, on: str, tie: str, by: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """left's columns, and `columns` of right (all but keys and time, named as in right) of the last row with right.on <= left.on; null where there is none."""
    by = by or []
    columns = columns or [c for c in right.columns if c not in (on, *by)]
    clash = set(columns) & set(left.columns)
    if clash:
        raise ValueError(f"both tables have {sorted(clash)}")
    keys = [f"k{i}_" for i in range(len(by))]
    named = lambda df: [df[c].alias(k) for c, k in zip(by, keys, strict=True)]
    row, found = F.struct(*[left[c] for c in left.columns]), F.struct(*[right[c] for c in columns])
    kind = {c: t for c, t in right.select(found.alias("found_")).dtypes}["found_"]
    wanted = {c: t for c, t in left.select(row.alias("row_")).dtypes}["row_"]
    # At one time right rows come first, in the order of tie, so that the last of them is the one that counts.
    a = left.select(*named(left), left[on].alias("on_"), F.lit(1).alias("side_"), F.lit(None).cast(right.select(tie).dtypes[0][1]).alias("tie_"), row.alias("row_"), F.lit(None).cast(kind).alias("found_"))
    b = right.where(_known(right, [on, *by])).select(*named(right), right[on].alias("on_"), F.lit(0).alias("side_"), right[tie].alias("tie_"), F.lit(None).cast(wanted).alias("row_"), found.alias("found_"))
    both = stored(a.unionByName(b), "asof")
    order = [*keys, "on_", "side_", "tie_"]
    laid = stored(both.orderBy(*order).withColumn("at_", F.monotonically_increasing_id()), "asof").withColumn("part_", F.shiftright("at_", 33))
    # A marker of its own: a found row may hold nulls only.
    hit = F.when(F.col("side_") == 0, F.struct(F.col("found_").alias("f")))
    within = Window.partitionBy("part_", *keys).orderBy("at_").rowsBetween(Window.unboundedPreceding, 0)
    own = laid.withColumn("own_", F.last(hit, ignorenulls=True).over(within)).where("side_ = 1")
    ends = laid.groupBy("part_", *keys).agg(F.max_by(hit, F.when(F.col("side_") == 0, F.col("at_"))).alias("end_"))
    before = Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("part_", *keys, F.last("end_", ignorenulls=True).over(before).alias("carried_")).where("carried_ is not null")
    on_ = own["part_"] == carried["part_"]
    for k in keys:
        on_ = on_ & own[k].eqNullSafe(carried[k])
    joined = own.join(carried, on_, "left").select("row_", own["on_"], *[own[k] for k in keys], F.coalesce("own_", "carried_").alias("hit_"))
    hit_ = F.when(_known(joined, ["on_", *keys]), F.col("hit_"))
    return joined.select(*[F.col("row_")[c].alias(c) for c in left.columns], *[hit_["f"][c].alias(c) for c in columns])


def _known(df: DataFrame, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & df[c].isNotNull()
    return out
