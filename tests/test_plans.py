"""Faults of the registered queries that one small table can't show."""

import ast
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from beamlake import plans
from beamlake.config import SearchConfig
from beamlake.operators import blocked, cells, graph, pq, shards
from beamlake.operators.search import beam
from beamlake.plans import ann_queries, oracle
from beamlake.streaming import arrival


@pytest.mark.parametrize("module", sorted(Path(plans.__path__[0]).glob("*.py")), ids=lambda p: p.stem)
def test_no_function_hides_another(module):
    """A second function of a name would be called in place of the first."""
    named = Counter(x.name for x in ast.parse(module.read_text()).body if isinstance(x, ast.FunctionDef))
    assert [n for n, k in named.items() if k > 1] == []


def against_sql(name, df, **tables):
    """Asserts that df and the query's SQL over the given Parquet files have the same rows."""
    c = duckdb.connect()
    for t, path in tables.items():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    want, cols = c.execute(oracle.oracle_sql()[name]).to_arrow_table(), sorted(df.columns)
    assert sorted(tuple(r[x] for x in cols) for r in df.collect()) == sorted(zip(*[want.column(x).to_pylist() for x in cols], strict=True))


def test_large_components_equal_the_sql(spark, tmp_path):
    """Components of 0.546 and more leave 16 bits when they are scaled by 60,000."""
    values = [0.6, -0.6, 0.547, -0.547, 0.5461, -0.54614, 0.5, -1.25]
    v = spark.createDataFrame([(0, values * 8), (1, values[::-1] * 8)], "vec_id bigint, embedding array<float>")
    v.withColumn("label", F.lit(0)).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    against_sql("dsp_vector", ann_queries.dsp_vector(spark, str(tmp_path)), embeddings=f"{tmp_path}/embeddings.parquet/*.parquet")


def test_a_list_that_holds_the_shard_is_walked_once():
    """What a search with room for all rows expands is the same for every query, and its results are those of the search itself."""
    r = np.random.default_rng(7)
    n, vec = 90, r.integers(-3, 4, (90, 64))
    near = [sorted(r.choice(60 if i < 60 else 90, 2, replace=False).tolist()) for i in range(n)]  # 60 and on can't be reached
    t = pa.table({"vec_id": np.arange(n) * 3, "vec": vec.tolist(), "pq16": r.integers(0, 256, (n, 16)).astype(np.int16).tolist(), "neighbors": [[3 * x for x in l] for l in near], "routes": pa.array([[]] * n, pa.list_(pa.int64())), "entry": [i == 5 for i in range(n)]})
    shard, cfg = shards._Shard(t, 16), SearchConfig(l_size=n, m=16)
    want, _, _, _ = beam(r.integers(0, 9, (16, 256)), shard.codes, shard.offsets, shard.targets, shard.entries, cfg)
    assert shard.reached().tolist() == sorted(p for _, p in want) and len(want) < n
    dead = np.arange(n) % 7 == 0
    q = pa.table({"query_id": np.arange(4) * 30, "vec": vec[:4].tolist()})
    got = list(zip(*shards._all_reached(shard, q, cfg, True, dead), strict=True))
    exact = []
    for me, x in zip(q.column("query_id").to_pylist(), vec[:4], strict=True):
        left = sorted((int(((vec[p] - x) ** 2).sum()), 3 * p) for _, p in want if not dead[p] and 3 * p != me)
        exact += [(me, i, d, len(want)) for d, i in left[:10]]
    assert got == exact
    with pytest.raises(OverflowError, match="vertices expanded"):
        shards._all_reached(shard, q, SearchConfig(l_size=10, m=16, max_expanded=10), True, dead)


def test_blocks_are_ranked_whole():
    r = np.random.default_rng(8)
    d = r.integers(0, 12, (7, 50))
    want = [sorted((int(x), j) for j, x in enumerate(row) if (i, j) != (3, 4))[:9] for i, row in enumerate(d)]
    without = np.zeros(d.shape, bool)
    without[3, 4] = True
    dist, place = blocked.nearest(d.copy(), 9, without)
    assert [list(zip(a, b, strict=True)) for a, b in zip(dist.tolist(), place.tolist(), strict=True)] == want
    assert (blocked.nearest(d[:, :3].copy(), 9)[1] >= 0).sum() == 21
    with pytest.raises(OverflowError):
        blocked.nearest(np.array([[1 << 40]]), 1)


def test_lists_of_trees_are_merged_as_batches():
    lists = [[(5, 1), (7, 2), (5, 1), (7, 1)], [], [(0, 9)] * 3]
    kind = pa.list_(pa.struct([("dist", pa.int64()), ("vec_id", pa.int64())]))
    b = pa.RecordBatch.from_arrays([pa.array([0] * 4, pa.int32()), pa.array(range(4)), pa.array([[{"dist": 1, "vec_id": 1}], *[[{"dist": d, "vec_id": i} for d, i in l] for l in lists]], kind)], names=["part", "vec_id", "near"]).slice(1)
    assert [[(x["dist"], x["vec_id"]) for x in l] for l in cells._merged(b, 2).column(2).to_pylist()] == [[(5, 1), (7, 1)], [], [(0, 9)]]


def test_codes_are_those_of_plain_distances():
    r = np.random.default_rng(9)
    x, book = r.integers(-32768, 32768, (70, 64)), r.integers(-40000, 40000, (256, 64))
    for m in (16, 32):
        plain = ((x.reshape(70, m, 1, -1) - book.reshape(256, m, -1).transpose(1, 0, 2)[None]) ** 2).sum(axis=3)
        assert (pq.tables(x, book, m) == plain).all() and (pq.encode_array(x, book, m) == plain.argmin(axis=2)).all()


@pytest.mark.parametrize("n", [30, 400])
def test_pruning_by_products_is_that_by_differences(n):
    r = np.random.default_rng(n)
    v, p = r.integers(-32768, 32768, (n, 64)), r.integers(-32768, 32768, 64)
    d, kept = ((v - p) ** 2).sum(axis=1), []
    alive = np.lexsort((np.arange(n), d)).tolist()
    while alive and len(kept) < 16:
        kept.append(alive.pop(0))
        alive = [i for i in alive if 1.2 * 1.2 * int(((v[i] - v[kept[-1]]) ** 2).sum()) > d[i]]
    assert graph.robust_prune(p, np.arange(n), v, 16) == kept


def test_a_device_is_decided_without_frames_of_nullable_columns():
    """Whole columns stay plain numbers, and nulls come first in either key."""
    rows = pd.DataFrame({"device": [3] * 4, "event_id": [7, 5, 6, 4], "ts": pd.to_datetime(["2024-01-02", "2024-01-02", None, "2024-01-01"]), "volts": [np.nan, 3.3, np.nan, np.nan]})
    out, energy, seq = arrival.fold(rows, 0.0, 2)
    assert out["event_id"].tolist() == [6, 4, 7] and out["seq"].tolist() == [2, 3, 4] and seq == 5 and energy == out["energy_uj"].iloc[-1] > 0
    assert [str(t) for t in out.dtypes] == ["int64", "int64", "int64", "int32", "float64"]
    out, _, _ = arrival.fold(rows.assign(device=np.nan, event_id=[7.0, 5.0, np.nan, 4.0]), 0.0, 0)
    assert out["device"].isna().all() and out["event_id"].isna().tolist() == [True, False, False]
