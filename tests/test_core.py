import binascii
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from beamlake.config import GEARS, SearchConfig, gear_config
from beamlake.functions import checksum, dsp, energy
from beamlake.functions.vector import address, address_parts, adc_sum, dot, l2sq, quantize, subtract
from beamlake.operators import build, graph, measure, mutate, pq, resume, stats
from beamlake.operators import search as s
from beamlake.sources import binary
from beamlake.sources.files import FileStore, write_lines
from beamlake.streaming import arrival, paced


@pytest.fixture(scope="module")
def data(spark, sf_dir):
    base, q = build.base_vectors(spark, sf_dir).cache(), build.query_vectors(spark, sf_dir).limit(12).cache()
    return base, q, build.build_index(base)


def rows(df, *keys):
    return sorted(tuple(r) for r in (df.select(*keys) if keys else df).collect())


@pytest.mark.parametrize(
    "bad",
    [{"l_size": 0}, {"m": 8}, {"k": 0}, {"degree": 0}, {"rerank": "none"}, {"rerank": "two_stage", "m": 32}, {"rerank": "two_stage", "refine": 5}, {"rerank": "partial", "partial": 3}, {"max_hops": 0}, {"max_hops": 5, "early_stop": True}, {"l_size": 50, "max_expanded": 20}],
)
def test_config_rejects(bad):
    with pytest.raises(ValueError):
        SearchConfig(**bad)


def test_gear_config():
    assert [(gear_config(g).l_size, gear_config(g).m) for g in range(6)] == [(n, m) for _, _, n, m in GEARS]
    with pytest.raises(ValueError):
        gear_config(6)


def test_vector_expressions(spark):
    d = spark.createDataFrame([([0.0015, -0.0015, 0.5], [1, 2, 3], [4, 0, -3], [[5, 7], [1, 9]], [1, 0])], "f array<float>, a array<int>, b array<int>, t array<array<bigint>>, c array<smallint>")
    r = d.select(quantize(F.col("f")), l2sq(F.col("a"), F.col("b")), dot(F.col("a"), F.col("b")), subtract(F.col("a"), F.col("b")), adc_sum(F.col("t"), F.col("c"))).first()
    x = np.float32([0.0015, -0.0015, 0.5]).astype(float)
    assert list(r[0]) == np.floor(x * 1000 + 0.5).astype(int).tolist()
    assert (r[1], r[2], list(r[3]), r[4]) == (9 + 4 + 36, -5, [-3, 2, 6], 8)


def test_address_round_trip(spark):
    d = spark.createDataFrame([(1023, 63, 2047, 31), (0, 0, 0, 0), (5, 6, 7, 3)], "b int, p int, o int, t int")
    a = d.withColumn("a", address(F.col("b"), F.col("p"), F.col("o"), F.col("t"))).withColumns(address_parts(F.col("a")))
    for r in a.collect():
        assert (r.b, r.p, r.o, r.t) == (r.addr_block, r.addr_page, r.addr_offset, r.addr_type) and 0 <= r.a < 2**32


def test_energy(spark):
    v = spark.createDataFrame([(2.5,), (2.8,), (3.0,), (3.01,), (3.3,)], "v double")
    r = [x.g for x in v.select(energy.adaptive_gear(F.col("v")).alias("g")).collect()]

    def gear(volts):
        budget = math.floor(0.0047 * 500000 * 0.4 * (volts**2 - 2.8**2) / 0.079904) if volts > 2.8 else 0
        return max([0, *(g for g, cost, _, _ in GEARS if g and budget >= cost)])

    assert r == [gear(x) for x in (2.5, 2.8, 3.0, 3.01, 3.3)] and r[-1] == 5 and r[2] == 0 and r[3] == 1
    assert energy.voltage(F.lit(4095)) is not None


def test_policies(spark):
    q = spark.createDataFrame([(1, 3.3), (2, 2.0)], "query_id bigint, voltage double")
    replay = spark.createDataFrame([(1, 4)], "query_id bigint, gear int")
    get = lambda *a, **k: rows(energy.with_gear(q, *a, **k), "query_id", "gear", "l_size", "m")
    assert get("fixed", gear=3) == [(1, 3, 10, 32), (2, 3, 10, 32)]
    assert get("adaptive") == [(1, 5, 20, 32), (2, 0, 10, 16)]
    assert get("replay", replay=replay) == [(1, 4, 15, 32), (2, 0, 10, 16)]
    assert get("power_event") == [(1, 0, 10, 16), (2, 0, 10, 16)]
    with pytest.raises(ValueError):
        energy.with_gear(q, "none")


def brute(base, q, k):
    b, qs = base.orderBy("vec_id").collect(), q.collect()
    ids, x = np.array([r.vec_id for r in b]), np.array([r.vec for r in b], dtype=np.int64)
    out = {}
    for r in qs:
        d = ((x - np.array(r.vec)) ** 2).sum(axis=1)
        at = np.lexsort((ids, d))[:k]
        out[r.query_id] = list(zip(ids[at].tolist(), d[at].tolist(), strict=True))
    return out


def test_exact_search_in_blocks(spark, data, monkeypatch):
    base, q, _ = data
    want = brute(base, q, 10)
    for shard in (16384, 100):
        monkeypatch.setattr("beamlake.operators.blocked.SHARD", shard)
        monkeypatch.setattr("beamlake.operators.blocked.BLOCK", 5 if shard == 100 else 2048)
        got = {}
        for qid, rank, v, d in rows(s.exact_search(q, base, 10)):
            assert rank == len(got.setdefault(qid, [])) + 1
            got[qid].append((v, d))
        assert got == want


def plain_beam(table, codes, neighbors, entry, size):
    dist = lambda v: int(sum(table[j][c] for j, c in enumerate(codes[v])))
    lst, seen, visited, expanded = [(dist(entry), entry)], {entry}, set(), []
    while any(v not in visited for _, v in lst):
        d, p = next(x for x in lst if x[1] not in visited)
        visited.add(p)
        expanded.append((d, p))
        for n in dict.fromkeys(neighbors[p]):
            if n not in seen:
                seen.add(n)
                lst.append((dist(n), n))
        lst = sorted(lst)[:size]
    return expanded


@pytest.mark.parametrize("m", [16, 32])
def test_search_matches_plain_search(spark, data, m):
    _, q, index = data
    codes = {r.vec_id: r[f"pq{m}"] for r in index.codes.collect()}
    near = {r.vec_id: r.neighbors for r in index.graph.collect()}
    got = {r.query_id: [(e.dist, e.vec_id) for e in r.expanded] for r in s.search(q, index, SearchConfig(l_size=10, m=m)).collect()}
    for r in q.collect():
        t = pq.tables(np.array([r.vec]) - index.mean, index.books[m], m)[0]
        assert got[r.query_id] == plain_beam(t, codes, near, index.entry, 10)


def test_rounds_match_the_held_index(spark, data):
    _, q, index = data
    q = q.limit(3)
    mixed = q.withColumn("l_size", F.when(F.col("query_id") % 20 == 0, 3).otherwise(6))
    for q, cfg in ((q, SearchConfig(l_size=4)), (q, SearchConfig(l_size=4, max_hops=3)), (q, SearchConfig(l_size=4, early_stop=True)), (mixed, SearchConfig(l_size=4))):
        a, b = s.search(q, index, cfg), s.search_rounds(q, index, cfg)
        pick = lambda d: sorted((r.query_id, r.hops, r.n_new, r.n_dup, [tuple(e) for e in r.expanded], [tuple(e) for e in r.list]) for r in d.collect())
        assert pick(a) == pick(b)


def test_expansion_limit_is_an_error(spark, data):
    _, q, index = data
    with pytest.raises(Exception, match="vertices expanded"):
        s.search(q, index, SearchConfig(l_size=10, max_expanded=10)).collect()


def test_rerank_modes_and_recall(spark, data):
    base, q, index = data
    truth = s.exact_search(q, base, 10)
    for mode, m in (("full", 32), ("partial", 16), ("two_stage", 16), ("list", 16)):
        found = s.ann_search(q, index, SearchConfig(l_size=20, m=m, rerank=mode)).cache()
        d = rows(found.join(base, "vec_id").join(q.withColumnRenamed("vec", "q"), "query_id").where(l2sq(F.col("q"), F.col("vec")) != F.col("dist_sq")))
        assert d == []
        by_id = [r.recall for r in s.recall(found, truth, 10, by="id").collect()]
        by_distance = [r.recall for r in s.recall(found, truth, 10).collect()]
        assert np.mean(by_distance) >= np.mean(by_id) > 0.75


@pytest.mark.parametrize("m", [16, 32])
def test_trained_codebook(spark, data, m):
    base, _, index = data
    x = np.array([r.vec for r in base.orderBy("vec_id").collect()]) - index.mean
    error = lambda book: pq.tables(x, book, m).min(axis=2).sum()
    books = [pq.train_codebook(base.repartition(n), index.mean, m, rounds) for n, rounds in ((1, 0), (3, 1), (2, 4))]
    assert error(books[0]) > error(books[1]) > error(books[2])
    assert error(books[1]) < error(x[: pq.CENTROIDS])  # better than a sample of rows
    assert np.array_equal(books[1], pq.train_codebook(base, index.mean, m, 1))  # whole numbers: no order of rows matters
    book, width = books[1], 64 // m  # a round of plain k-means
    at = pq.encode_array(x, books[0], m)
    for s_ in (0, m - 1):
        own = x[:, s_ * width : (s_ + 1) * width]
        for c in range(0, 256, 17):
            held = own[at[:, s_] == c]
            assert book[c, s_ * width : (s_ + 1) * width].tolist() == (held.sum(axis=0) // len(held) if len(held) else books[0][c, s_ * width : (s_ + 1) * width]).tolist()


def test_odd_vectors_take_no_part(spark, tmp_path):
    good = [float(i % 7) for i in range(64)]
    rows = [(1, good), (2, None), (3, good[:5]), (4, [float("nan"), *good[1:]]), (5, [float("inf"), *good[1:]]), (6, [None, *good[1:]]), (None, good), (7, []), (8, [1e9, *good[1:]])]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [r.vec_id for r in build.quantized(spark, str(tmp_path)).collect()] == [1]


def test_graph_checks(spark, data):
    base, _, index = data
    assert all(r.violations == 0 for r in graph.integrity(base, index.graph, index.codes).collect())
    broken = index.graph.limit(3).withColumn("neighbors", F.array("vec_id", F.lit(-1).cast("bigint"), F.lit(-1).cast("bigint")))
    bad = {r.check: r.violations for r in graph.integrity(base, broken, index.codes).collect()}
    assert bad["edges_dangling"] == 6 and bad["edges_self"] == 3 and bad["edges_repeated"] == 3 and bad["graph_missing"] == base.count() - 3
    back = rows(graph.reverse_edges(index.graph), "vec_id", "src")
    assert back == sorted((d, v) for v, near in rows(index.graph) for d in set(near))
    chain = spark.createDataFrame([(i, [i + 1]) for i in range(40)] + [(40, [])], "vec_id bigint, neighbors array<bigint>")
    assert rows(graph.reachable(chain, 0)) == [(i, i) for i in range(41)]
    assert graph.in_degree(index.graph).agg(F.sum("in_degree")).first()[0] == 32 * base.count()
    assert graph.reachable(index.graph, index.entry).count() == base.count()


def test_fake_ring(spark):
    t = binary.fake_ring(spark)
    index = s.Index(t["vectors"], t["graph"], t["codes"], np.zeros(64, np.int64), {16: np.tile(np.arange(64), (256, 1)), 32: np.tile(np.arange(64), (256, 1))}, 0)
    q = t["queries"].limit(5)
    found = s.ann_search(q, index, SearchConfig(l_size=10))
    assert found.where("dist_sq <> 0").count() == 0 and found.count() == 50
    assert sorted({r.vec_id for r in found.collect()}) == list(range(10))  # all tie: the smallest ids


def test_robust_prune():
    p, v = np.array([0, 0]), np.array([[1, 0], [2, 0], [0, 3], [5, 5]])
    assert graph.robust_prune(p, np.arange(4), v, 3) == [0, 2]
    assert graph.robust_prune(p, np.arange(4), v, 1) == [0]


@pytest.mark.parametrize("pool", [256, 4])
def test_pruning_from_pools(spark, data, monkeypatch, pool):
    monkeypatch.setattr(mutate, "POOL", pool)
    base, _, _ = data
    v = {r.vec_id: np.array(r.vec, dtype=np.int64) for r in base.collect()}
    r = np.random.default_rng(6)
    pairs = [(p, int(o)) for p in (3, 40, 77) for o in r.choice(sorted(set(v) - {p}), 120, replace=False)] + [(5, 9), (5, 9)]
    points = base.where("vec_id in (3, 5, 40, 77)")
    got = {x.vec_id: x.neighbors for x in mutate.pruned(points, spark.createDataFrame(pairs, "vec_id bigint, other bigint"), base, 12).collect()}
    for p in (3, 5, 40, 77):
        ids = np.array(sorted({o for q, o in pairs if q == p}))
        assert got[p] == [int(ids[i]) for i in graph.robust_prune(v[p], ids, np.stack([v[i] for i in ids]), 12)]


def test_insert_delete_compact(spark, data):
    base, q, _ = data
    small = base.where("vec_id < 300").cache()
    index = build.build_index(small, degree=16)
    new = base.where("vec_id between 300 and 330")
    grown = mutate.insert_vectors(index, new, SearchConfig(l_size=20, degree=16), degree=16)
    assert all(r.violations == 0 for r in graph.integrity(grown.vectors, grown.graph, grown.codes).collect())
    assert grown.graph.agg(F.max(F.size("neighbors"))).first()[0] <= 16
    probe = new.withColumnRenamed("vec_id", "query_id")
    hit = s.ann_search(probe, grown, SearchConfig(l_size=20, m=32, degree=16)).where("rank = 1 and dist_sq = 0 and vec_id = query_id").count()
    assert hit >= 0.9 * new.count()
    with pytest.raises(ValueError):
        mutate.insert_vectors(grown, new.limit(1), degree=16)
    dead = mutate.delete_vectors(None, new.select("vec_id"))
    dead = mutate.delete_vectors(dead, small.where("vec_id = 0").select("vec_id"))
    left = mutate.compact(grown, dead, degree=16)
    assert left.vectors.count() == small.count() - 1 and left.entry == 1
    assert all(r.violations == 0 for r in graph.integrity(left.vectors, left.graph, left.codes).collect())
    cfg = SearchConfig(l_size=20, degree=16)
    found = s.ann_search(q, grown, cfg, deleted=dead)
    assert found.join(dead, "vec_id").count() == 0 and found.count() == 10 * q.count()
    both = s.search_with_delta(q, index, new, cfg, deleted=mutate.delete_vectors(None, new.limit(3)), not_self=True)
    truth = s.exact_search(q, small.unionByName(mutate.without_deleted(new, new.limit(3))), 10, not_self=True)
    assert both.count() == 10 * q.count() and np.mean([r.recall for r in s.recall(both, truth, 10).collect()]) > 0.85
    assert spark.range(1).select(mutate.is_delta(F.lit(5), 5)).first()[0]


def test_resume_after_a_crash(spark, tmp_path):
    p = resume.Progress(spark, f"file://{tmp_path}/run")
    q = spark.range(40).withColumnRenamed("id", "query_id")
    assert p.restore() is None and p.pending(q).count() == 40
    calls = []

    def work(part):
        if len(calls) == 2:
            raise RuntimeError("power failure")
        calls.append(part.count())
        return part.withColumn("answer", F.col("query_id") * 2)

    with pytest.raises(RuntimeError):
        p.run(q, work)
    done = p.restore().count()
    assert 0 < done < 40 and p.pending(q).count() == 40 - done
    calls.clear()
    out = resume.Progress(spark, p.path).run(q, lambda part: part.withColumn("answer", F.col("query_id") * 2))
    assert rows(out, "query_id", "answer") == [(i, 2 * i) for i in range(40)]
    assert resume.Progress(spark, f"file://{tmp_path}/none").attempts().count() == 0
    assert {(r.attempts, r.query_id in {x.query_id for x in out.collect()}) for r in p.attempts().collect()} <= {(1, True), (2, True)} and p.attempts().where("attempts = 2").count() > 0
    FileStore(spark).delete(f"{p.path}/gen={p.generations()[0]}")
    with pytest.raises(RuntimeError, match="incomplete"):
        p.restore()


def test_stats(spark):
    d = spark.createDataFrame([(1, 3, 40, 10), (2, 5, 60, 20)], "query_id bigint, hops int, n_new int, n_dup int")
    r = stats.profile(d).first()
    assert (r.n_hops, r.hops_per_query, r.new_per_hop) == (8, 4.0, 12.5)
    assert stats.profile(d.where("1 = 0")).first().hops_per_query == 0
    assert rows(stats.bytes_model(d, 16))[0] == (1, 640, 384, 384, 1408)
    assert tuple(resume.attempt_stats(spark.createDataFrame([(1, 1), (2, 3)], "query_id bigint, attempts int")).first()) == (2, 1, 2)


def test_phases_of_real_runs(spark, tmp_path):
    phases = measure.Phases(spark)
    p = resume.Progress(spark, f"file://{tmp_path}/p", phases)
    d = spark.range(30).select(F.col("id").alias("query_id"))
    p.commit(d)
    p.commit(d.where("query_id < 5"))
    assert p.restore().count() == 35
    with pytest.raises(ZeroDivisionError), phases.of("commit") as call:
        call.touched(7)
        raise ZeroDivisionError
    calls = [(c.phase, c.rows(), c.failed) for c in phases.calls]
    assert calls == [("commit", 30, False), ("commit", 5, False), ("restore", None, False), ("commit", None, True)]
    by = {r.phase: r for r in measure.profile(phases.table()).collect()}
    assert (by["commit"].calls, by["commit"].failed, by["commit"].rows) == (3, 1, 35) and by["restore"].bytes == by["commit"].bytes - 7 > 0
    assert 0 < by["commit"].least_us <= by["commit"].mean_us <= by["commit"].greatest_us <= by["commit"].total_us
    assert measure.profile(measure.Phases(spark).table()).count() == 0


def test_binary_parts_and_ranges(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(4).integers(-3000, 3000, (120, 64)).astype("<i2")
    (tmp_path / "N").mkdir()
    for i in range(12):
        x[10 * i : 10 * i + 10].tofile(tmp_path / "N" / f"VEC.{i}.BIN")  # VEC.10 is no second part
    want = [(i, r.tolist()) for i, r in enumerate(x)]
    assert rows(binary.read(spark, f"file://{tmp_path}/N", "VEC")) == want
    monkeypatch.setattr(binary, "RANGE_BYTES", 100)
    assert rows(binary.read(spark, f"file://{tmp_path}/N", "VEC")) == want
    monkeypatch.setattr(binary, "PART_ROWS", 50)
    binary.write(binary.read(spark, f"file://{tmp_path}/N", "VEC"), "VEC", f"file://{tmp_path}/out")
    assert FileStore(spark).names(f"file://{tmp_path}/out") and rows(binary.read(spark, f"file://{tmp_path}/out", "VEC")) == want


def test_binary_files(spark, tmp_path):
    x = np.random.default_rng(1).integers(-3000, 3000, (70, 64)).astype("<i2")
    for i, part in enumerate(np.array_split(x, [30, 30, 55])):
        part.tofile(tmp_path / f"VEC.{i}.BIN")
    v = binary.read(spark, f"file://{tmp_path}", "VEC").orderBy("vec_id").collect()
    assert [r.vec_id for r in v] == list(range(70)) and np.array_equal(np.array([r.vec for r in v]), x)
    packed = {r.id: bytes(r.bytes) for r in binary.to_bytes(spark.createDataFrame(v), "VEC").collect()}
    assert b"".join(packed[i] for i in range(70)) == x.tobytes()
    (tmp_path / "GT").mkdir()
    np.array([[2**32 - 1 - i for i in range(10)]], dtype="<u4").tofile(tmp_path / "GT" / "GT.BIN")
    assert binary.read(spark, f"file://{tmp_path}/GT", "GT").first().dists[0] == 2**32 - 1
    (tmp_path / "BAD").mkdir()
    (tmp_path / "BAD" / "x").write_bytes(b"123")
    with pytest.raises(ValueError):
        binary.read(spark, f"file://{tmp_path}/BAD", "VEC")
    (tmp_path / "CB").mkdir()
    np.arange(16 * 256 * 4).astype("<i2").tofile(tmp_path / "CB" / "C.BIN")
    c = binary.codebook(binary.read(spark, f"file://{tmp_path}/CB", "CODEBOOK")).where("subspace = 3 and centroid = 7").first()
    assert list(c.c) == np.arange(16 * 256 * 4).astype("<i2").reshape(16, 256, 4)[3, 7].tolist()


def test_files(spark, tmp_path):
    fs, at = FileStore(spark), f"file://{tmp_path}/a"
    assert fs.mkdirs(at) and fs.stat(at)["is_dir"] and not fs.exists(f"{at}/x")
    fs.write_text(f"{at}/x", "one\ntwo")
    assert [r.value for r in fs.read_lines(f"{at}/x").collect()] == ["one", "two"] and fs.stat(f"{at}/x")["size"] == 7
    assert fs.rename(f"{at}/x", f"{at}/y") and "y" in fs.names(at) and fs.delete(f"{at}/y")
    write_lines(spark.range(2), "row %d", [F.col("id")], f"{at}/lines")
    assert sorted(r.value for r in fs.read_lines(f"{at}/lines").collect()) == ["row 0", "row 1"]


def test_streams(spark, data, tmp_path):
    _, q, index = data
    q.write.parquet(f"{tmp_path}/in")
    stream = paced.search_stream(paced.queries_from(spark, f"{tmp_path}/in"), index, SearchConfig(), f"{tmp_path}/out", f"{tmp_path}/ck", once=True)
    stream.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert rows(got, "query_id", "rank", "vec_id", "dist_sq") == rows(s.ann_search(q, index, SearchConfig()))
    a = paced.arrivals(spark, 5, 7)
    assert a.isStreaming and a.columns == ["arrival", "seq", "query_id"]
    due = rows(paced.schedule(spark.range(0, 50, 5).withColumnRenamed("id", "query_id").repartition(3), 4), "query_id", "seq", "due_ms")
    assert due == [(5 * i, i, 250 * i) for i in range(10)]
    v = spark.createDataFrame([("2024-01-01 00:00:05", 3.0), ("2024-01-01 00:00:50", 3.2)], "ts string, voltage double").withColumn("ts", F.to_timestamp("ts"))
    assert paced.voltage_by_minute(v).first().n == 2


def test_arrivals_decided_by_state_equal_a_fold(spark, tmp_path):
    """A stream that stops and goes on in the middle, over batches of any cut in time, and the plain rule."""
    r = np.random.default_rng(8)
    rows = [(None if i % 17 == 0 else int(r.integers(0, 4)), i, i // 3, None if r.random() < 0.6 else int(r.integers(2000, 4096))) for i in range(240)]
    kind = "device bigint, event_id bigint, ts bigint, raw int"
    for k, (a, b) in enumerate(((0, 30), (30, 33), (33, 200), (200, 240))):
        spark.createDataFrame(rows[a:b], kind).repartition(3).write.mode("append").parquet(f"file://{tmp_path}/in")
        events = spark.readStream.schema(kind).parquet(f"file://{tmp_path}/in")
        arrival.decide_stream(events, f"file://{tmp_path}/out", f"file://{tmp_path}/ck", once=True).awaitTermination(180)
        assert len([d for d in os.listdir(tmp_path / "out") if d.startswith("batch=")]) == k + 1
    got = rows_of = sorted(spark.read.schema(arrival.OUT).parquet(f"file://{tmp_path}/out").drop("batch").collect(), key=lambda x: x.event_id)
    want, store, seq = [], {}, {}
    for device, event, _, raw in rows:
        if raw is not None:
            v = raw * 1.2 * 4 / 4096
            store[device] = 0.0047 * 500000 * 0.4 * (v * v - 2.8 * 2.8) if v > 2.8 else 0.0
            continue
        have = math.floor(store.get(device, 0.0) / 0.079904)
        gear, cost = next(((g, c) for g, c, *_ in reversed(GEARS) if have >= c), (energy.WAIT, 0))
        store[device] = store.get(device, 0.0) - cost * 0.079904
        want.append((device, event, seq.get(device, 0), gear, store[device]))
        seq[device] = seq.get(device, 0) + 1
    assert [tuple(x)[:4] for x in got] == [x[:4] for x in want] and {x[3] for x in want} > {energy.WAIT}
    assert [x.energy_uj for x in got] == pytest.approx([x[4] for x in want])
    assert sorted(map(tuple, arrival.decide(spark.createDataFrame(rows, kind).repartition(4)).collect()), key=lambda x: x[1]) == [tuple(x) for x in rows_of]


def sat(x, bits=16):
    return max(-(1 << bits - 1), min((1 << bits - 1) - 1, x))


def test_dsp(spark):
    a, b = [32767, -32768, 100, -3, 5, 5, 0, 7], [1, -1, 3, 4, -32768, 32767, 9, -9]
    d = spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>")
    A, B = F.col("a"), F.col("b")
    one = lambda c: d.select(c).first()[0]
    assert one(dsp.add(A, B)) == [sat(x + y) for x, y in zip(a, b)] and one(dsp.sub(A, B)) == [sat(x - y) for x, y in zip(a, b)]
    assert one(dsp.mac(A, B)) == 2 * sum(x * y for x, y in zip(a, b))
    assert one(dsp.mpy(A, B)) == [x * y >> 15 for x, y in zip(a, b)]
    assert one(dsp.negate(A)) == [sat(-x) for x in a] and one(dsp.offset(A, 9)) == [sat(x + 9) for x in a]
    hi, at = dsp.maximum(F.array(*[F.lit(x) for x in (1, 9, 9, 2)]))
    assert (one(hi), one(at)) == (9, 2)
    lo, at = dsp.minimum(F.array(*[F.lit(x) for x in (1, 9, 1, 2)]))
    assert (one(lo), one(at)) == (1, 2)
    assert one(dsp.interleave(A, B))[:4] == [32767, 1, -32768, -1] and one(dsp.deinterleave(dsp.interleave(A, B), 1, 2)) == b
    assert one(dsp.iq31_to_q15(dsp.q15_to_iq31(A))) == a and one(dsp.fill(3, 2)) == [3, 3]
    m = one(dsp.transpose(dsp.to_matrix(A, 4)))
    assert m == [[32767, 5], [-32768, 5], [100, 0], [-3, 7]]
    x, y = np.array(a).reshape(2, 4), np.array(b).reshape(4, 2)
    assert one(dsp.matrix_mpy(dsp.to_matrix(A, 4), dsp.to_matrix(B, 2))) == [[int((int(v) >> 15) + 32768) % 65536 - 32768 for v in r] for r in x @ y]
    assert one(dsp.sinusoid(4, math.pi / 2)) == [0, 32767, 0, -32767]
    z = dsp.complex_vector(A, B)
    assert tuple(one(dsp.complex_mac(z, z))) == (sum(p * p - q * q for p, q in zip(a, b)), 2 * sum(p * q for p, q in zip(a, b)))
    assert [tuple(r) for r in one(dsp.complex_fir(z, [(16384, 0), (0, 16384)]))][1] == (sat((-32768 * 16384 - 1 * 16384) >> 15), sat((-1 * 16384 + 32767 * 16384) >> 15))


def test_biquads(spark):
    a = [1000, -2000, 3000, 30000, -32768, 5, 32767, 32767]
    part = lambda x, k: x * k >> 15

    def df1(x, b, c, state=(0, 0, 0, 0)):
        x1, x2, y1, y2 = state
        out = []
        for v in x:
            y = sat(part(v, b[0]) + 2 * part(x1, b[1]) + part(x2, b[2]) + 2 * part(y1, c[0]) + part(y2, c[1]))
            x1, x2, y1, y2 = v, x1, y, y1
            out.append(y)
        return out, x1, x2, y1, y2

    def df2(x, b, c, bias=0, state=(0, 0)):
        w1, w2 = state
        out, low, high = [], 32767, -32768
        for v in x:
            w = sat(bias + part(v, c[0]) + 2 * part(w1, c[1]) + part(w2, c[2]))
            out.append(sat(part(w, b[0]) + 2 * part(w1, b[1]) + part(w2, b[2])))
            w1, w2, low, high = w, w1, min(low, w), max(high, w)
        return out, w1, w2, low, high

    d = spark.createDataFrame([(a,)], "a array<bigint>")
    one = lambda c: tuple(d.select(c).first()[0])
    b, c = (8192, 4096, 2048), (8192, -4096)
    whole, first = df1(a, b, c), df1(a[:3], b, c)
    assert one(dsp.biquad_df1(F.col("a"), b, c)) == whole
    assert first[0] + list(one(dsp.biquad_df1(F.slice("a", 4, 5), b, c, first[1:]))[0]) == whole[0]  # the state goes on
    c = (16384, 8192, -4096)
    whole, first = df2(a, b, c, 300), df2(a[:3], b, c, 300)
    assert one(dsp.biquad_df2(F.col("a"), b, c, 300)) == whole
    assert first[0] + list(one(dsp.biquad_df2(F.slice("a", 4, 5), b, c, 300, first[1:3]))[0]) == whole[0]
    stages = [(b, c, 7), ((16384, 0, -8192), (32767, 4096, 2048), -150)]
    want = a
    for stage in stages:
        want = df2(want, *stage)[0]
    assert list(d.select(dsp.biquad_cascade(F.col("a"), stages, 2)).first()[0]) == want


@pytest.mark.parametrize("bits,auto,inverse", [(16, False, False), (16, True, False), (32, False, True)])
def test_fixed_point_transforms(spark, bits, auto, inverse):
    r = np.random.default_rng(3)
    top = 1 << bits - 1
    rows = [(r.integers(-top // s, top // s, n).tolist(), r.integers(-top // s, top // s, n).tolist()) for n, s in ((64, 1), (64, 50), (8, 3), (1, 1), (2, 1))] + [(None, None)]
    d = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>").withColumn("z", dsp.complex_vector(F.col("a"), F.col("b")))
    for x in d.select("a", "b", dsp.fft_fixed(F.col("z"), bits, auto, inverse).alias("f")).collect():
        if x.a is None:
            assert x.f is None or x.f.re is None
            continue
        z = np.array(x.a) + 1j * np.array(x.b)
        exact = (np.fft.ifft(z) * len(z) if inverse else np.fft.fft(z)) / 2**x.f.shift
        assert np.abs(np.array(x.f.re) + 1j * np.array(x.f.im) - exact).max() < 12 + np.abs(exact).max() * 2e-3 * (bits == 16)
        assert x.f.shift == len(z).bit_length() - 1 if not auto else x.f.shift <= len(z).bit_length() - 1
    with pytest.raises(ValueError):
        dsp.fft_rows(np.zeros((1, 6), int), np.zeros((1, 6), int))


@pytest.mark.parametrize(("bits", "auto"), [(16, False), (16, True), (32, False)])
@pytest.mark.parametrize("n", [2, 4, 16, 64, 256])
def test_real_transforms_by_halves(bits, auto, n):
    """Against floating point; and back again, but for the mean of the odd places, which comes back on the even ones."""
    r = np.random.default_rng(n)
    x = np.concatenate([r.integers(-3000, 3000, (6, n)) // (n if auto else 1) << (0 if bits == 16 else 14), np.zeros((1, n), np.int64)])
    re, im, count = dsp.rfft_rows(x, bits, auto)
    f = np.fft.rfft(x, axis=1)[:, : n // 2]
    scale = 2.0 / (n // 2) if bits == 32 else 2.0 ** -count[:, None]
    room = 1 << 16 if bits == 32 else 8 + n if auto else 8  # factors have 16 bits in either width; what is never halved keeps every product's cut
    assert np.abs(re - f.real * scale).max() < room and np.abs(im - f.imag * scale).max() < room
    back, want = dsp.irfft_rows(re, im, count, bits, auto), (x + x[:, 1::2].mean(axis=1)[:, None] * (-1) ** np.arange(n)) * (8 / n if bits == 32 else 1)
    assert np.abs(back - want).max() < (room if bits == 32 else 32 if auto else 4 * n)


def test_fft(spark):
    a = [float(x) for x in np.random.default_rng(2).integers(-100, 100, 16)]
    d = spark.createDataFrame([(a, [{"re": x, "im": 1.0} for x in a])], "a array<double>, z array<struct<re:double,im:double>>")
    f = d.select(dsp.rfft(F.col("a")).alias("f"), dsp.cfft(F.col("z")).alias("g"))
    r = f.first()
    assert np.allclose([complex(*x) for x in r.f], np.fft.rfft(a) / 16) and np.allclose([complex(*x) for x in r.g], np.fft.fft(np.array(a) + 1j) / 16)
    back = f.select(dsp.irfft(F.col("f")), dsp.cifft(F.col("g"))).first()
    assert np.allclose(back[0], a) and np.allclose([x.re for x in back[1]], a)


def test_checksums(spark):
    words = [b"", b"123456789", bytes(range(256))]
    d = spark.createDataFrame([(w,) for w in words], "d binary")
    for r in d.select("d", checksum.crc32(F.col("d")).alias("a"), checksum.crc16(F.col("d")).alias("b"), checksum.crc16_arrow(F.col("d")).alias("c")).collect():
        assert (r.a, r.b, r.c) == (binascii.crc32(r.d), binascii.crc_hqx(bytes(r.d), 0xFFFF), binascii.crc_hqx(bytes(r.d), 0xFFFF))
    key = F.lit("0123456789abcdef")
    assert [bytes(r[0]) for r in d.select(checksum.decrypt(checksum.encrypt(F.col("d"), key), key)).collect()] == words
