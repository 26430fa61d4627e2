"""Partition trees, sharded search, stored generations, and device files."""

import math
import os
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from beamlake.config import SearchConfig
from beamlake.operators import blocked, cells, generations, graph, pq, shards, store
from beamlake.operators import search as s
from beamlake.operators.asof import asof_join
from beamlake.sources import device


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, vec array<int>")


def clustered(n, seed=1, per=50):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 600, (n // per, 64))
    return np.clip(centres[r.integers(0, n // per, n)] + r.normal(0, 60, (n, 64)), -4000, 4000).astype(int)


def noise(n, seed=2):
    return (np.random.default_rng(seed).normal(0, 1, (n, 64)) * 300).astype(int)


def lists(g):
    return {r.vec_id: list(r.neighbors) for r in g.collect()}


def edge_recall(got, want):
    return sum(len(set(got[v]) & set(x)) for v, x in want.items()) / sum(map(len, want.values()))


# -- trees --------------------------------------------------------------------------------------------------


def test_one_cell_is_exact_and_parts_are_never_mixed(spark):
    v = frame(spark, noise(120))
    assert lists(cells.cell_graph(v, 8)) == lists(graph.knn_graph(v, 8))
    part = (F.col("vec_id") % 3).cast("int")
    got = lists(cells.cell_graph(v.withColumn("part", part), 8))
    for p in range(3):
        assert {k: x for k, x in got.items() if k % 3 == p} == lists(graph.knn_graph(v.where(part == p), 8))


def test_cells_hold_every_row_once_per_tree(spark):
    x = np.concatenate([clustered(900), np.repeat(noise(1), 400, axis=0), noise(3)])  # 400 rows alike can't be parted by pivots
    placed = cells.cells(frame(spark, x).withColumn("part", F.lit(0)), leaf=60, trees=3).cache()
    sizes = [r["count"] for r in placed.groupBy("part", "tree", "cell").count().collect()]
    assert max(sizes) <= 60 and sum(sizes) == 3 * len(x)
    assert placed.select("tree", "vec_id").distinct().count() == 3 * len(x)
    near = lists(cells.cell_lists(placed, 5).select("vec_id", F.transform("near", lambda e: e["vec_id"]).alias("neighbors")))
    assert set(near) == set(range(len(x))) and all(900 <= o < 1300 for v in range(900, 1300) for o in near[v])
    assert cells.cell_graph(frame(spark, noise(2)).where("1 = 0"), 5).count() == 0
    assert lists(cells.cell_graph(frame(spark, noise(1)), 5)) == {0: []}


def test_work_grows_with_the_rows_and_edges_are_found(spark):
    """Pairs compared by rows: below a power of 1.3 over three sizes, with at least 0.9 of the exact edges of clustered rows."""
    work, sizes = [], (600, 1200, 2400)
    for n in sizes:
        v = frame(spark, clustered(n)).withColumn("part", F.lit(0))
        placed = cells.cells(v, leaf=100, trees=8).cache()
        work.append(cells.compared(placed))
        if n == 1200:
            got = lists(cells.cell_lists(placed, 10).select("vec_id", F.transform("near", lambda e: e["vec_id"]).alias("neighbors")))
            assert edge_recall(got, lists(graph.knn_graph(v, 10))) >= 0.9
        placed.unpersist()
    assert all(math.log(b / a) / math.log(2) < 1.3 for a, b in zip(work, work[1:], strict=False))


def test_routes_lead_to_every_row(spark):
    x = np.concatenate([clustered(500), np.repeat(noise(1), 300, axis=0)])
    v = frame(spark, x).withColumn("part", (F.col("vec_id") % 2).cast("int"))
    to, first = {}, set()
    for r in cells.routes(v).collect():
        if r.head is None:
            first.add(r.vec_id)
        else:
            assert r.head % 2 == r.vec_id % 2 == r.part
            to.setdefault(r.head, set()).add(r.vec_id)
    seen, front = set(first), set(first)
    while front:
        front = set().union(*(to.get(p, set()) for p in front)) - seen
        seen |= front
    assert seen == set(range(800)) and len(first) <= 2 * cells.PIVOTS


# -- shards and generations ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    x = clustered(600)
    v = frame(spark, x).cache()
    out = {}
    for n in (1, 4):
        st = store.IndexStore(spark, f"file://{tmp_path_factory.mktemp('index')}/i")
        st.build(v, degree=16, n_shards=n)
        out[n] = st
    return v, v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), out


def found(spark, stored_, q, cfg, **more):
    return shards.search_rows(q, stored_.rows, stored_.manifest["shards"], stored_.mean, stored_.books[cfg.m], cfg, **more)


def test_sharded_search_finds_what_is_near_at_any_number_of_shards(spark, built):
    v, q, stores = built
    truth = s.exact_search(q, v, 10, not_self=True)
    for n, st in stores.items():
        got = found(spark, st.load(), q, SearchConfig(l_size=40, m=32, degree=16), not_self=True)
        assert np.mean([r.recall for r in s.recall(got, truth, 10).collect()]) >= 0.95, n


def test_a_shard_is_searched_by_the_same_rules(spark, built, monkeypatch):
    """One shard whose only entry is the index's: the results of the search over one graph, whatever is reranked."""
    v, q, stores = built
    st = stores[1].load()
    one = st.rows.withColumn("entry", F.col("vec_id") == st.manifest["entry"]).withColumn("routes", F.array().cast("array<bigint>"))
    pick = lambda d: sorted(map(tuple, d.select("query_id", "rank", "vec_id", "dist_sq").collect()))
    for mode in ("full", "partial", "list"):
        cfg = SearchConfig(l_size=12, m=16, degree=16, rerank=mode)
        assert pick(shards.search_rows(q, one, 1, st.mean, st.books[16], cfg)) == pick(s.ann_search(q, st.index(), cfg))
    monkeypatch.setattr(shards, "BLOCK", 7)  # several passes
    assert pick(shards.search_rows(q, one, 1, st.mean, st.books[16], cfg)) == pick(s.ann_search(q, st.index(), cfg))


def test_an_exhaustive_list_is_exact_and_tombstones_never_come_back(spark, built):
    v, q, stores = built
    dead = v.where("vec_id % 7 = 0").select("vec_id")
    cfg = SearchConfig(l_size=600, m=16, degree=16, max_expanded=600)
    got = found(spark, stores[4].load(), q, cfg, deleted=dead)
    want = s.exact_search(q, v.where("vec_id % 7 <> 0"), 10)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_whole_shard_is_ranked_by_blocks_of_rows(spark, monkeypatch):
    """No distances are held of more than ROWS_STEP rows, and ties at the edge of a block go to the smaller id."""
    r = np.random.default_rng(3)
    x = r.integers(0, 2, (95, 64)).astype(float)  # many ties
    monkeypatch.setattr(shards, "ROWS_STEP", 10)
    sizes = []
    monkeypatch.setattr(shards, "l2", lambda a, b: sizes.append(len(a)) or blocked.l2(a, b))

    class Whole:
        ids = np.arange(95) * 3
        reached = staticmethod(lambda: np.arange(95))
        vectors = staticmethod(lambda places: x[places])

    q = pa.table({"query_id": pa.array([0, 9, 500]), "vec": pa.array(x[[0, 3, 7]].astype(int).tolist(), pa.list_(pa.int32()))})
    dead = np.arange(95) % 7 == 6
    got = shards._all_reached(Whole(), q, SearchConfig(l_size=95), True, dead)
    want = []
    for me, y in zip((0, 9, 500), x[[0, 3, 7]], strict=True):
        near = sorted((int(((x[p] - y) ** 2).sum()), p * 3) for p in range(95) if not dead[p] and p * 3 != me)[:10]
        want += [(me, i, d) for d, i in near]
    assert list(zip(*got[:3], strict=True)) == want and max(sizes) == 10


def test_the_index_stays_where_it_is(spark, built):
    """Bucketed by shard: of the two sides of a search only the queries are shuffled."""
    _, q, stores = built
    plan = found(spark, stores[4].load(), q, SearchConfig(l_size=20, m=32), not_self=True)._jdf.queryExecution().executedPlan().toString()
    (side,) = [x for x in plan.split("FlatMapCoGroupsInArrow")[1].split("FileScan parquet") if "index_" in x.split("[")[0]][:1]
    above = plan.split("FlatMapCoGroupsInArrow")[1].split("index_")[0]
    assert "Bucketed: true" in plan and "Exchange" not in above and side


def test_generations_are_flipped_in_one_step(spark, built, tmp_path):
    v, q, stores = built
    st = store.IndexStore(spark, f"file://{tmp_path}/g")
    with pytest.raises(FileNotFoundError):
        st.load()
    src = stores[1].load()
    first = st.publish(src.rows, src.mean, src.books, 1, 0, vectors=600)
    fewer = src.rows.where("vec_id < 100")
    second = st.publish(fewer, src.mean, src.books, 1, 0, after=1, vectors=100)
    assert (first["generation"], second["generation"]) == (1, 2) and st.generations() == [1, 2]
    assert st.load().rows.count() == 100 and st.load(1).rows.count() == 600
    with pytest.raises(RuntimeError):  # a writer that began from the first generation comes too late
        st.publish(fewer, src.mean, src.books, 1, 0, after=1)
    fork = store.IndexStore(spark, f"file://{tmp_path}/fork")
    fork.adopt(st.load())
    assert fork.load().rows.count() == 100 and fork.generations() == [1] and not [n for n in os.listdir(tmp_path / "fork") if n.startswith("rows")]
    os.makedirs(f"{tmp_path}/g/rows-unpublished")  # what a writer that died has left is never read
    assert st.load().manifest["generation"] == 2


def test_an_index_is_built_once_for_its_files(spark, tmp_path):
    frame(spark, noise(80)).write.parquet(f"file://{tmp_path}/v")
    src = spark.read.parquet(f"file://{tmp_path}/v")
    calls = []

    def vectors():
        calls.append(1)
        return src

    a, b = (store.open_index(spark, src, vectors, degree=8) for _ in range(2))
    assert calls == [1] and a.manifest == b.manifest and np.array_equal(a.books[16], pq.train_codebook(src, a.mean, 16))
    frame(spark, noise(5), 1000).write.mode("append").parquet(f"file://{tmp_path}/v")
    again = spark.read.parquet(f"file://{tmp_path}/v")
    assert store.open_index(spark, again, lambda: again, degree=8).manifest["vectors"] == 85


@pytest.fixture
def halves(spark, tmp_path):
    x = clustered(600)
    base, new = frame(spark, x[:400]).cache(), frame(spark, x[400:], 400).cache()
    st = store.IndexStore(spark, f"file://{tmp_path}/base")
    st.build(base, degree=16, n_shards=3)
    return base, new, st, frame(spark, x).where("vec_id % 25 = 0").withColumnRenamed("vec_id", "query_id")


def exact(q, v, dead=None):
    left = v if dead is None else v.join(dead, "vec_id", "left_anti")
    return sorted(map(tuple, s.exact_search(q, left, 10, not_self=True).collect()))


def same(df):
    return sorted(map(tuple, df.collect()))


EVERY = SearchConfig(l_size=600, m=16, degree=16, max_expanded=600)


def test_delta_index_is_searched_by_its_graph(spark, tmp_path, halves):
    base, new, st, q = halves
    main = st.load()
    delta = generations.build_delta(store.IndexStore(spark, f"file://{tmp_path}/delta"), main, new, degree=16)
    assert np.array_equal(delta.books[32], main.books[32])
    truth = s.exact_search(q, base.unionByName(new), 10, not_self=True)
    got = generations.search_both(q, main, delta, SearchConfig(l_size=40, m=32, degree=16), not_self=True)
    assert np.mean([r.recall for r in s.recall(got, truth, 10).collect()]) >= 0.9
    dead = base.unionByName(new).where("vec_id % 3 = 0").select("vec_id")
    assert same(generations.search_both(q, main, delta, EVERY, not_self=True, deleted=dead)) == exact(q, base.unionByName(new), dead)
    with pytest.raises(ValueError):
        generations.build_delta(store.IndexStore(spark, f"file://{tmp_path}/twice"), main, base.limit(3))


def test_merge_links_both_ways_and_equals_a_rebuild_in_recall(spark, halves, tmp_path):
    base, new, st, q = halves
    merged = generations.merge(st, st.load(), new, degree=16)
    both = base.unionByName(new)
    assert merged.manifest["generation"] == 2 and merged.manifest["vectors"] == 600 and st.load(1).rows.count() == 400
    rows = {r.vec_id: r for r in merged.rows.collect()}
    assert len(rows) == 600 and all(len(r.neighbors) <= 16 for r in rows.values())
    into = {o for r in rows.values() for o in (*r.neighbors, *r.routes)}
    assert all(v in into or rows[v].entry for v in range(400, 600)) and all(rows[o].shard == r.shard for r in rows.values() for o in r.neighbors)
    assert same(generations.search(q, merged, EVERY, not_self=True)) == exact(q, both)
    again = store.IndexStore(spark, f"file://{tmp_path}/again")
    again.build(both, degree=16, n_shards=3)
    truth, cfg = s.exact_search(q, both, 10, not_self=True), SearchConfig(l_size=40, m=32, degree=16)
    recalls = [np.mean([r.recall for r in s.recall(generations.search(q, i, cfg, not_self=True), truth, 10).collect()]) for i in (merged, again.load())]
    assert recalls[0] >= 0.9 and recalls[0] >= recalls[1] - 0.05
    one = new.limit(1).withColumn("vec_id", F.lit(5000).cast("bigint"))
    third = generations.merge(st, merged, one, degree=16)
    assert len(third.manifest["parts"]) == 2 and sum(len(p["shards"]) for p in third.manifest["parts"]) == 3  # one shard anew, two as they are
    with pytest.raises(RuntimeError):
        generations.merge(st, merged, one)  # made from a generation that is no longer the newest


def test_compaction_leaves_clean_shards_as_they_are(spark, halves):
    base, _, st, q = halves
    first = st.load()
    shard = {r.vec_id: r.shard for r in first.rows.collect()}
    dead = spark.createDataFrame([(v,) for v, k in shard.items() if (k == 1 and v % 2) or (k == 2 and v % 40 == 0)], "vec_id bigint")
    small, left = generations.compact(st, first, dead, degree=16)
    assert sorted(r.vec_id for r in left.collect()) == sorted(v for v, k in shard.items() if k == 2 and v % 40 == 0)
    kept, new = small.manifest["parts"]
    assert kept == {"rows": first.manifest["parts"][0]["rows"], "shards": [0, 2]} and new["shards"] == [1]
    assert same(generations.search(q, small, EVERY, not_self=True, deleted=left)) == exact(q, base, dead)
    assert same(small.rows.where("shard <> 1")) == same(first.rows.where("shard <> 1"))
    gone = {v for v, k in shard.items() if k == 1 and v % 2}
    assert all(not gone & {*r.neighbors, *r.routes} for r in small.rows.where("shard = 1").collect())
    unchanged, rest = generations.compact(st, small, left, degree=16)
    assert unchanged is small and rest.count() == left.count()
    empty, _ = generations.compact(st, small, base.select("vec_id"), degree=16)
    assert empty.rows.count() == 0 and generations.search(q, empty, EVERY).count() == 0


def published(spark, path, x, degree):
    """A store whose index of x was put together here: exact lists, and routes from row 0 to all others. One shard."""
    v = frame(spark, x)
    mean = pq.mean_array(v)
    books = {m: pq.train_codebook(v, mean, m) for m in (16, 32)}
    _, near = blocked.nearest(blocked.l2(x.astype(float), x.astype(float)), min(degree, len(x) - 1), np.eye(len(x), dtype=bool))
    codes = [pq.encode_array(x - mean, books[m], m).tolist() for m in (16, 32)]
    rows = [(0, i, x[i].tolist(), codes[0][i], codes[1][i], near[i].tolist(), list(range(1, len(x))) if i == 0 else [], i == 0) for i in range(len(x))]
    st = store.IndexStore(spark, f"file://{path}")
    st.publish(spark.createDataFrame(rows, shards.ROWS), mean, books, 1, 0, vectors=len(x))
    return st


def test_compaction_of_a_shard_does_not_follow_the_dead_to_all_its_rows(spark, tmp_path):
    """A fifth of the rows are dead and link each other, so that by way of them alone nearly all rows are reached."""
    x = noise(2000)
    st, v, q = published(spark, tmp_path / "i", x, 16), frame(spark, x), frame(spark, x[:40]).withColumnRenamed("vec_id", "query_id")
    dead = v.where("vec_id % 5 = 0").select("vec_id")
    began = time.time()
    small, _ = generations.compact(st, st.load(), dead, bound=0.0, degree=16)
    assert time.time() - began < 20
    cfg = SearchConfig(l_size=2000, m=16, degree=16, max_expanded=2000)
    assert same(generations.search(q, small, cfg, not_self=True)) == exact(q, v, dead)
    assert all(0 < len(r.neighbors) <= 16 and all(o % 5 for o in r.neighbors) for r in small.rows.collect())


def test_candidates_of_a_compacted_row_are_bounded():
    """Through all of the dead, as was done before, a row leads to nearly every living one."""
    r = np.random.default_rng(1)
    near, gone, rows = r.integers(0, 3000, (3000, 16)), np.arange(3000) % 5 == 0, np.arange(1, 3000, 5)
    links = lambda p: (np.repeat(np.arange(len(p)), 16), near[p].ravel())
    i, to = links(rows)
    every, few = (np.bincount(generations._beyond(i, to, gone, links, enough)[0], minlength=len(rows)) for enough in (None, 17))
    assert np.median(every) > 2000 and few.max() <= 17 + 16 * 16


def test_a_shard_is_merged_by_batches(spark, tmp_path):
    """Rows that fall into one shard. Every row is reached, and a short list finds what is near."""
    x = noise(3500)
    st, v, q = published(spark, tmp_path / "i", x[:1000], 16), frame(spark, x), frame(spark, x).where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    began = time.time()
    merged = generations.merge(st, st.load(), frame(spark, x[1000:], 1000), degree=16)
    assert time.time() - began < 20
    truth, cfg = exact(q, v), SearchConfig(l_size=3500, m=16, degree=16, max_expanded=3500)
    assert same(generations.search(q, merged, cfg, not_self=True)) == truth
    got = {(r[0], r[2]) for r in same(generations.search(q, merged, SearchConfig(l_size=200, m=32, degree=16), not_self=True))}
    assert np.mean([(r[0], r[2]) in got for r in truth]) >= 0.9


def test_rows_that_short_lists_lose_are_led_to_by_routes(spark, tmp_path):
    """Lists of two entries, which pruning takes from rows that nothing else may lead to."""
    x = clustered(900, seed=5, per=9)
    st, v, q = published(spark, tmp_path / "i", x[:300], 2), frame(spark, x), frame(spark, x).where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    cfg = SearchConfig(l_size=900, m=16, degree=2, max_expanded=900)
    merged = generations.merge(st, st.load(), frame(spark, x[300:], 300), SearchConfig(l_size=4, m=32), degree=2)
    assert same(generations.search(q, merged, cfg, not_self=True)) == exact(q, v)
    dead = v.where("vec_id % 3 = 0").select("vec_id")
    small, _ = generations.compact(st, merged, dead, bound=0.0, degree=2)
    assert same(generations.search(q, small, cfg, not_self=True)) == exact(q, v, dead)


def test_each_shard_is_remade_by_a_task_of_its_own(spark):
    """By their own numbers three of four shards shared a task."""
    for mine in ([0, 1, 2, 3], [5], [1, 4, 6, 7, 9, 30]):
        rows = spark.createDataFrame([(k,) for k in mine for _ in range(3)], "shard int").withColumn("task", generations._apart(spark, mine))
        parts = rows.repartition(len(mine), "task").select("shard", F.spark_partition_id().alias("p")).distinct().collect()
        assert len(parts) == len({r.p for r in parts}) == len(mine)


def test_searches_of_a_batch_follow_the_rules_of_the_beam(spark, built):
    """What is expanded, with and without a limit of hops and early stopping, and what is chosen of it."""
    st = built[2][1].load()
    t = st.rows.toArrow().replace_schema_metadata(None)
    grown, shard, x = generations._Growing(t, 16), shards._Shard(t, 16), np.array(t.sort_by("vec_id").column("vec").to_pylist()[::13])
    tables = pq.tables(x - st.mean, st.books[16], 16)
    for more in ({}, {"max_hops": 9}, {"early_stop": True}):
        cfg = SearchConfig(l_size=12, m=16, degree=16, **more)
        i, places = grown.walk(tables, cfg)
        for k, table in enumerate(tables):
            expanded = [p for _, p in s.beam(table, shard.codes, shard.offsets, shard.targets, shard.entries, cfg)[0]]
            assert places[i == k].tolist() == expanded
    points = np.arange(len(grown.ids))[::13]
    i, places = grown.walk(tables, SearchConfig(l_size=40, m=16))
    grown.choose(points, i, places, 5)
    for k, p in enumerate(points):
        c = np.sort(places[(i == k) & (places != p)])
        assert grown.near[p, : grown.size[p]].tolist() == c[graph.robust_prune(grown.vecs[p], c, grown.vecs[c], 5)].tolist()
    with pytest.raises(OverflowError):
        grown.walk(tables, SearchConfig(l_size=12, m=16, max_expanded=12))  # each expands some that drop off its list


def test_merging_into_shards_with_few_rows_or_none(spark, tmp_path):
    """Of eight shards some hold nothing before, rows alike are many, and a row is merged into an index that was emptied."""
    x = np.concatenate([noise(3), np.repeat(noise(1, seed=8), 300, axis=0), noise(20, seed=9)])
    st, v = store.IndexStore(spark, f"file://{tmp_path}/few"), frame(spark, x)
    st.build(v.where("vec_id < 3"), degree=8, n_shards=8)
    merged = generations.merge(st, st.load(), v.where("vec_id >= 3"), SearchConfig(l_size=8, m=32), degree=8)
    q, cfg = v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), SearchConfig(l_size=400, m=16, degree=8, max_expanded=400)
    assert same(generations.search(q, merged, cfg, not_self=True)) == exact(q, v)
    none, _ = generations.compact(st, merged, v.select("vec_id"), degree=8)
    assert none.rows.count() == 0
    again = generations.merge(st, none, v.where("vec_id >= 310"), degree=8)
    assert same(generations.search(q, again, cfg, not_self=True)) == exact(q, v.where("vec_id >= 310"))


# -- device files -------------------------------------------------------------------------------------------


def test_device_files_are_written_and_read_by_tasks(spark, tmp_path):
    x = np.random.default_rng(4).integers(-3000, 3000, (500, 64)).astype("<i2")
    at = f"file://{tmp_path}/out"
    df = frame(spark, x).withColumn("more", F.lit("x")).repartition(7)
    device.write(df, "VEC", at, part_bytes=128 * 90)
    names = sorted(os.listdir(tmp_path / "out"))
    assert len(names) >= 6 and all(n.startswith("VEC.") for n in names)  # nothing pending is left
    assert b"".join((tmp_path / "out" / n).read_bytes() for n in names) == x.tobytes()
    back = device.read(spark, at, "VEC", range_bytes=128 * 37)
    assert back.rdd.getNumPartitions() > len(names)  # files of several ranges
    assert sorted((r.vec_id, r.vec) for r in back.collect()) == [(i, r.tolist()) for i, r in enumerate(x)]
    with pytest.raises(FileExistsError):
        device.write(df, "VEC", at)


def test_one_large_file_is_read_by_ranges(spark, tmp_path):
    x = np.random.default_rng(5).integers(0, 2**32, (1000, 10), dtype=np.uint64).astype("<u4")
    x.tofile(tmp_path / "GT.BIN")
    d = device.read(spark, f"{tmp_path}/GT.BIN", "GT", range_bytes=40 * 64)
    assert d.rdd.getNumPartitions() == 16
    assert sorted((r.query_id, r.dists) for r in d.collect()) == [(i, r.tolist()) for i, r in enumerate(x)]


def test_what_does_not_fit_is_an_error_and_leaves_no_part(spark, tmp_path):
    for k, bad in enumerate(([1] * 63, [40_000] * 64, None, [None] * 64)):
        rows = spark.createDataFrame([(0, [1] * 64), (1, bad)], "vec_id bigint, vec array<int>")
        with pytest.raises(Exception, match="numbers|fit"):
            device.write(rows, "VEC", f"file://{tmp_path}/{k}")
        assert not os.path.exists(tmp_path / f"{k}") or not os.listdir(tmp_path / f"{k}")
    device.write(rows.where("1 = 0"), "VEC", f"file://{tmp_path}/empty")
    assert device.read(spark, f"file://{tmp_path}/empty", "VEC").count() == 0
    with pytest.raises(FileNotFoundError):
        device.read(spark, f"file://{tmp_path}/none", "VEC")
    (tmp_path / "odd").write_bytes(b"123")
    with pytest.raises(ValueError, match="whole rows"):
        device.read(spark, f"file://{tmp_path}/odd", "VEC")


# -- as-of join ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("by", [["k"], []])
def test_asof_join_against_a_scan(spark, by):
    """Ties, repeated rows, nulls in time, key and value, a key that holds most rows, keys and times without a sample."""
    r = np.random.default_rng(6)
    key = lambda: [None, 0, 0, 0, 0, 1, 2][r.integers(0, 7)]
    left = [(i, key(), None if r.random() < 0.1 else int(r.integers(0, 60))) for i in range(150)] + [(7, 0, 30), (7, 0, 30), (8, 5, 30), (9, 0, -1)]
    right = [(1000 + i, key(), None if r.random() < 0.1 else int(r.integers(0, 60)), None if r.random() < 0.2 else float(i)) for i in range(120)]
    a = spark.createDataFrame(left, "id bigint, k int, t int").repartition(5)
    b = spark.createDataFrame(right, "sample bigint, k int, t int, v double").select("sample", *by, "t", "v").repartition(4)

    def plain(i, k, t):
        fits = [(s[2], s[0], s[3]) for s in right if t is not None and s[2] is not None and s[2] <= t and (not by or (k is not None and s[1] == k))]
        return (i, k, t, *(max(fits, key=lambda s: s[:2])[1:] if fits else (None, None)))

    got = [tuple(x) for x in asof_join(a, b, "t", "sample", by).collect()]
    order = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(got, key=order) == sorted((plain(*x) for x in left), key=order)
    assert asof_join(a.where("1 = 0"), b, "t", "sample", by).count() == 0
    assert {(x.sample, x.v) for x in asof_join(a, b.where("1 = 0"), "t", "sample", by).collect()} == {(None, None)}
    with pytest.raises(ValueError):
        asof_join(a, b.withColumn("id", F.lit(1)), "t", "sample", by)
