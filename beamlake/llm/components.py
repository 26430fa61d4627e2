"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamlake.llm.common import drop_stored, stored


#: Neighbours from which on a node counts as a hub, and hubs that are broadcast at most.
HUB, MOST_HUBS = 1_000, 1_000_000


def _with_least(e: DataFrame, rows: int) -> DataFrame:
    """e(u, v) with m, the smallest v of each u.

    A hub's edges would meet in one task of a join. Hubs, of which there are at most one per HUB edges, are therefore
    joined from a broadcast, as long as a count allows it, and everything else by u."""
    least = stored(e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least", rows)
    hub = F.col("n") >= HUB
    if not 0 < least.where(hub).count() <= MOST_HUBS:
        return e.join(least.select("u", "m"), "u")
    hubs = F.broadcast(least.where(hub).select("u", "m"))
    return e.join(hubs, "u").unionByName(e.join(hubs.select("u"), "u", "left_anti").join(least.where(~hub).select("u", "m"), "u"))


def _large_star(e: DataFrame, rows: int) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * rows).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(e: DataFrame, rows: int) -> DataFrame:
    each = _with_least(e, rows)
    moved = each.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(each.select("u", F.col("m").alias("v")))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (its component's smallest node) of every node of links(a, b); nodes are longs.

    The state is a table in the shared folder each round; only its size and a checksum reach the driver.
    """
    state = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    before = (state.count(), None)
    for _ in range(rounds):
        n = before[0]
        starred = stored(_large_star(state, n), "links", n)
        after = stored(_small_star(starred, n).distinct(), "links", n)
        r = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        drop_stored(starred)
        drop_stored(state)
        state = after
        if (r["n"], r["h"]) == before:
            break
        before = (r["n"], r["h"])
    else:
        raise RuntimeError("components did not settle")
    roots = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
