import duckdb
import pytest

import __spark_entry__
from beamlake.plans import ann_queries, oracle, signal_oracle, signal_queries

QUERIES, SQL = ann_queries.queries() | signal_queries.queries(), oracle.oracle_sql() | signal_oracle.oracle_sql()

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Quick ones; the search queries run the same operators and are compared in full by the driver.
CHECKED = ["exact_knn", "vector_mean", "l2_distance_matrix_topk", "pq_encode16", "adc_scan_topk32", "graph_in_degree", "address_codec", "gear_select", "gear_search_config", "gear_replay", "pending_queries", "attempt_stats", "delete_tombstones", "delta_scan", "robust_prune", "commit_restore", "attempts_recorded", "pq_codebook16", "compact_integrity", "dsp_vector", "dsp_reduce", "dsp_complex", "dsp_matrix", "dsp_fir", "greedy_hops_limited", "cell_graph", "index_manifest", "ann_topk", "ann_tombstones_sharded", "merged_index_search", "merged_index_edges", "compacted_index_search", "binary_vectors", "binary_codes", *signal_queries.queries()]


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    want = duck.execute(SQL[name]).to_arrow_table()
    cols = sorted(df.columns)
    assert cols == sorted(want.column_names)
    mine = sorted(tuple(r[c] for c in cols) for r in df.collect())
    theirs = sorted(zip(*[want.column(c).to_pylist() for c in cols], strict=True))
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert a == pytest.approx(b) if any(isinstance(x, float) for x in a) else a == b


@pytest.mark.parametrize("name", ["insert_merge_search", "delta_search", "ann_topk", "ann_topk_sharded", "delta_index_search"])
def test_recall_of_approximate_queries(spark, sf_dir, name):
    from beamlake.operators import search

    truth = ann_queries.queries()["delete_tombstones" if name.startswith("delta") else "exact_knn"](spark, sf_dir)
    found = ann_queries.queries()[name](spark, sf_dir)
    got = [r.recall for r in search.recall(found, truth, 10).collect()]
    assert len(got) == 50 and sum(got) / 50 >= 0.9


def test_entry_and_names(spark):
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) > 90
    assert __spark_entry__.entry(spark).count() > 0
