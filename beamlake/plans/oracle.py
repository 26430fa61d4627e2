"""The registered queries as DuckDB SQL."""

from __future__ import annotations

from beamlake.config import GEARS
from beamlake.operators.pq import LEVELS, ROUNDS

_VECTORS = """
allv AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000.0::DOUBLE + 0.5::DOUBLE) AS INTEGER)) AS vec FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64),
base AS MATERIALIZED (SELECT vec_id, vec FROM allv),
qs AS (SELECT vec_id AS query_id, vec FROM allv WHERE vec_id % 10 = 0)"""

_L2 = "list_sum(list_transform(range(1, 65), lambda i: CAST({a}[i] - {b}[i] AS BIGINT) * ({a}[i] - {b}[i])))"

_EXACT = f"""
exact AS (SELECT query_id, rank, vec_id, dist_sq FROM (
  SELECT query_id, vec_id, dist_sq, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist_sq, vec_id) AS INTEGER) AS rank
  FROM (SELECT query_id, vec_id, CAST({_L2.format(a="qs.vec", b="base.vec")} AS BIGINT) AS dist_sq FROM qs CROSS JOIN base WHERE base.vec_id <> query_id)) WHERE rank <= 10)"""

_MEAN = """
mean_d AS (SELECT d, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS mean FROM (SELECT unnest(range(0, 64)) AS d, unnest(vec) AS x FROM base) GROUP BY d),
mean AS MATERIALIZED (SELECT list(mean ORDER BY d) AS mu FROM mean_d),
spread AS MATERIALIZED (SELECT list(x ORDER BY d) AS sp FROM (SELECT d, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x
  FROM (SELECT unnest(range(0, 64)) AS d, unnest(list_transform(range(1, 65), lambda i: abs(vec[i] - mu[i]))) AS x FROM base, mean) GROUP BY d))"""


def _part(who: str, key: str, m: int) -> str:
    """Centred subvectors v of a table's rows, by subspace s."""
    w = 64 // m
    return f"SELECT {key}, s, list_transform(range(s * {w} + 1, s * {w} + {w} + 1), lambda i: vec[i] - mu[i]) AS v FROM {who}, mean, range({m}) r(s)"


def _dist(m: int) -> str:
    return "CAST(" + " + ".join(f"(v[{j}] - c[{j}]) * (v[{j}] - c[{j}])" for j in range(1, 64 // m + 1)) + " AS BIGINT)"


def _book(m: int) -> str:
    """cb{m}(s, centroid, c): means of the cells of a grid, then rounds of k-means; sub{m}: the rows' subvectors."""
    w, levels = 64 // m, LEVELS[m]
    by = levels // 4 if levels > 4 else 1
    cell = " + ".join(f"greatest(0, least({levels - 1}, CAST(floor(CAST(v[{j + 1}] AS DOUBLE) / st[{j + 1}]) AS BIGINT) + {levels // 2})) * {levels**j}" for j in range(w))
    mean = f"SELECT s, cell, j, CAST(floor(CAST(sum(v[j + 1]) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM {{src}}, range({w}) q(j) GROUP BY s, cell, j"
    out = f"""
sub{m} AS MATERIALIZED ({_part("base", "vec_id", m)}),
st{m} AS MATERIALIZED (SELECT s, list_transform(range(s * {w} + 1, s * {w} + {w} + 1), lambda i: sp[i] // {by} + 1) AS st FROM spread, range({m}) r(s)),
in{m}_0 AS MATERIALIZED (SELECT s, v, {cell} AS cell FROM sub{m} JOIN st{m} USING (s)),
mid{m} AS (SELECT s, cell, j, (cell // CAST(pow({levels}, j) AS BIGINT) % {levels} - {levels // 2}) * st[j + 1] + st[j + 1] // 2 AS x FROM st{m}, range(256) p(cell), range({w}) q(j)),
cb{m}_0 AS MATERIALIZED (SELECT s, cell AS centroid, list(coalesce(a.x, b.x) ORDER BY j) AS c FROM mid{m} b LEFT JOIN ({mean.format(src=f"in{m}_0")}) a USING (s, cell, j) GROUP BY s, cell)"""
    for k in range(1, ROUNDS + 1):
        out += f""",
in{m}_{k} AS MATERIALIZED (SELECT s, v, cell FROM (SELECT vec_id, s, min({_dist(m)} * 256 + centroid) % 256 AS cell FROM sub{m} JOIN cb{m}_{k - 1} USING (s) GROUP BY vec_id, s) JOIN sub{m} USING (vec_id, s)),
cb{m}_{k} AS MATERIALIZED (SELECT b.s, centroid, CASE WHEN any_value(a.x) IS NULL THEN any_value(c) ELSE list(a.x ORDER BY j) END AS c
  FROM cb{m}_{k - 1} b LEFT JOIN ({mean.format(src=f"in{m}_{k}")}) a ON a.s = b.s AND a.cell = b.centroid GROUP BY b.s, centroid)"""
    return out + f",\ncb{m} AS MATERIALIZED (SELECT CAST(s AS INTEGER) AS s, CAST(centroid AS INTEGER) AS centroid, c FROM cb{m}_{ROUNDS})"


def _codes(m: int) -> str:
    return f"""
enc{m} AS (SELECT vec_id, CAST(s AS INTEGER) AS subspace, CAST(min({_dist(m)} * 256 + centroid) % 256 AS INTEGER) AS code FROM sub{m} JOIN cb{m} USING (s) GROUP BY vec_id, s),
code{m} AS MATERIALIZED (SELECT vec_id, list(code ORDER BY subspace) AS code FROM enc{m} GROUP BY vec_id)"""


def _adc(m: int) -> str:
    return f"""
adc{m} AS MATERIALIZED (SELECT query_id, CAST(s AS INTEGER) AS subspace, centroid, {_dist(m)} AS dist FROM ({_part("qs", "query_id", m)}) JOIN cb{m} USING (s)),
t{m} AS MATERIALIZED (SELECT query_id, list(dist ORDER BY subspace, centroid) AS t FROM adc{m} GROUP BY query_id)"""


_GRAPH = f"""
edge AS MATERIALIZED (SELECT src, CAST(rank - 1 AS INTEGER) AS slot, dst FROM (
  SELECT a.vec_id AS src, b.vec_id AS dst, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_L2.format(a="a.vec", b="b.vec")}, b.vec_id) AS rank
  FROM base a JOIN base b ON a.vec_id <> b.vec_id) WHERE rank <= 32)"""


def _score(code: str, m: int) -> str:
    return f"CAST(list_sum(list_transform(range({m}), lambda j: t[j * 256 + {code}[j + 1] + 1])) AS BIGINT)"


def _beam(m: int, size: int, hops: int | None = None, early: bool = False, tag: str = "", who: str = "") -> str:
    """Expanded vertices, list and counters of every query (that `who` keeps); one row of state per query and hop."""
    open_ = "list_filter(lst, lambda z: z.v = 0)"
    go = f"len({open_}) > 0"
    if hops is not None:
        go += f" AND hops < {hops}"
    if early:
        go += f" AND NOT (len(lst) >= {size} AND hops > 0 AND {open_}[1].d >= lst[-1].d)"
    return f"""
entry{tag} AS (SELECT min(vec_id) AS e FROM base),
nb{tag} AS MATERIALIZED (SELECT src, list({{'id': dst, 'code': code}} ORDER BY slot) AS ns FROM edge JOIN code{m} ON vec_id = dst GROUP BY src),
beam{tag}(query_id, hops, lst, seen, exp, n_new, n_dup) AS (
  SELECT query_id, 0, [{{'d': {_score("code", m)}, 'id': e, 'v': 0}}], [e], CAST([] AS STRUCT(d BIGINT, id BIGINT)[]), 1, 0
  FROM t{m}, entry{tag} JOIN code{m} ON vec_id = e {who}
  UNION ALL
  SELECT query_id, hops + 1,
    list_sort(list_concat(list_transform(lst, lambda z: {{'d': z.d, 'id': z.id, 'v': CASE WHEN z.id = p.id THEN 1 ELSE z.v END}}),
      list_transform(fresh, lambda z: {{'d': {_score("z.code", m)}, 'id': z.id, 'v': 0}})))[1:{size}],
    list_concat(seen, list_transform(fresh, lambda z: z.id)), list_append(exp, {{'d': p.d, 'id': p.id}}), n_new + CAST(len(fresh) AS INTEGER), n_dup + CAST(len(ns) - len(fresh) AS INTEGER)
  FROM (SELECT b.*, t, ns, list_filter(ns, lambda z: NOT list_contains(seen, z.id)) AS fresh
    FROM (SELECT *, {open_}[1] AS p FROM beam{tag} WHERE {go}) b JOIN nb{tag} n ON n.src = b.p.id JOIN t{m} USING (query_id)) s
),
final{tag} AS (SELECT * FROM beam{tag} WHERE NOT ({go}))"""


def _search(m: int, size: int, rest: str, more: str = "", **kw: object) -> str:
    parts = [_VECTORS, _MEAN, _book(m), _codes(m), _adc(m), _GRAPH, _beam(m, size, **kw)]  # type: ignore[arg-type]
    return "WITH RECURSIVE" + ",".join(parts) + (("," + more) if more else "") + "\n" + rest


def _with(*parts: str, rest: str) -> str:
    return "WITH" + ",".join(parts) + "\n" + rest


_COUNTERS = "SELECT query_id, CAST(hops AS INTEGER) AS hops, CAST(n_new AS INTEGER) AS n_new, CAST(n_dup AS INTEGER) AS n_dup FROM final"


def _rerank(pairs: str) -> str:
    """The ten best of pairs(query_id, vec_id) by exact distance."""
    return f"""
pairs AS ({pairs}),
ranked AS (SELECT query_id, vec_id, dist_sq, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist_sq, vec_id) AS INTEGER) AS rank
  FROM (SELECT p.query_id, p.vec_id, CAST({_L2.format(a="qs.vec", b="base.vec")} AS BIGINT) AS dist_sq FROM pairs p JOIN qs USING (query_id) JOIN base ON base.vec_id = p.vec_id WHERE p.vec_id <> query_id)),
top AS (SELECT query_id, rank, vec_id, dist_sq FROM ranked WHERE rank <= 10)"""


_ALL = "SELECT query_id, unnest(list_transform(exp, lambda z: z.id)) AS vec_id FROM final"
_TOP = "SELECT * FROM top"

_RAW = """
smp AS (SELECT event_id, user_id, CAST(least(4095, floor(value * 8.0::DOUBLE)) AS INTEGER) AS raw FROM events),
volt AS (SELECT *, CAST(raw AS DOUBLE) * 0.001171875::DOUBLE AS voltage FROM smp),
en AS (SELECT *, CASE WHEN voltage > 2.8::DOUBLE THEN {f}::DOUBLE * (voltage * voltage - {v}::DOUBLE) ELSE 0.0::DOUBLE END AS energy_uj FROM volt),
bud AS (SELECT *, CAST(floor(energy_uj / 0.079904::DOUBLE) AS BIGINT) AS budget FROM en)""".format(f=repr(0.0047 * 500000 * 0.4), v=repr(2.8 * 2.8))

_GEAR = "CAST(CASE WHEN voltage <= 2.8::DOUBLE THEN 0 ELSE greatest(0, " + ", ".join(f"CASE WHEN budget >= {c} THEN {g} ELSE 0 END" for g, c, _, _ in GEARS if g) + ") END AS INTEGER)"
_GEARS = "gears(gear, l_size, m) AS (VALUES " + ", ".join(f"(CAST({g} AS INTEGER), CAST({n} AS INTEGER), CAST({m} AS INTEGER))" for g, _, n, m in GEARS) + ")"
_PER_QUERY = f"""
vmax AS (SELECT user_id, max(voltage) AS voltage FROM volt GROUP BY user_id),
qv AS (SELECT query_id, coalesce(voltage, 3.1::DOUBLE) AS voltage FROM qs LEFT JOIN vmax ON user_id = query_id),
qb AS (SELECT *, CAST(floor((CASE WHEN voltage > 2.8::DOUBLE THEN {0.0047 * 500000 * 0.4!r}::DOUBLE * (voltage * voltage - {2.8 * 2.8!r}::DOUBLE) ELSE 0.0::DOUBLE END) / 0.079904::DOUBLE) AS BIGINT) AS budget FROM qv),
qg AS (SELECT query_id, voltage, {_GEAR} AS gear FROM qb), {_GEARS}"""

_PAIRS = _VECTORS + """,
pr AS (SELECT vec_id, list_transform(vec, lambda x: CAST(x AS BIGINT) * 60) AS a, list_reverse(list_transform(vec, lambda x: CAST(x AS BIGINT) * 60)) AS b FROM allv),
e AS (SELECT vec_id, unnest(range(0, 64)) AS p, unnest(a) AS a, unnest(b) AS b FROM pr)"""


def _sat(x: str, bits: int = 16) -> str:
    h = (1 << (bits - 1)) - 1
    return f"greatest({-h - 1}, least({h}, {x}))"


def _low(x: str, bits: int = 16) -> str:
    h, n = 1 << (bits - 1), 1 << bits
    return f"(((({x}) + {h}) % {n} + {n}) % {n} - {h})"


def _shr(x: str, k: int) -> str:
    return f"CAST(floor(CAST({x} AS DOUBLE) / {1 << k}) AS BIGINT)"


def _complex_sql() -> str:
    s = lambda x: _sat(x)
    c = lambda x: _low(_shr(x, 15))
    # x = a + ib, y = b + ia
    cols = {
        "add_re": s("a + b"), "add_im": s("b + a"), "sub_re": s("a - b"), "sub_im": s("b - a"), "conj_re": "a", "conj_im": s("-b"),
        "mpy_re": c("a * b - b * a"), "mpy_im": c("a * a + b * b"), "real_re": c("a * b"), "real_im": c("b * b"),
        "scale_re": c("a * 8192 + b * 8192"), "scale_im": c("b * 8192 - a * 8192"), "shift_re": s("a * 2"), "shift_im": s("b * 2"),
    }
    return _with(_PAIRS, rest="SELECT vec_id, CAST(p AS INTEGER) AS pos, " + ", ".join(f"{v} AS {k}" for k, v in cols.items()) + " FROM e")


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["exact_knn"] = _with(_VECTORS, _EXACT, rest="SELECT * FROM exact")
    q["ground_truth"] = _with(_VECTORS, _EXACT, rest="SELECT query_id, rank, dist_sq FROM exact")
    q["quantize_vectors"] = _with(_VECTORS, rest="SELECT vec_id, CAST(unnest(range(0, 64)) AS INTEGER) AS dim, unnest(vec) AS value FROM allv")
    q["vector_mean"] = _with(_VECTORS, _MEAN, rest="SELECT CAST(d AS INTEGER) AS dim, mean FROM mean_d")
    q["l2_distance_matrix_topk"] = _with(
        _VECTORS,
        rest=f"""SELECT query_id, rank, vec_id, dist_sq FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist_sq, vec_id) AS INTEGER) AS rank FROM (
  SELECT allv.vec_id AS query_id, qs.query_id AS vec_id, CAST({_L2.format(a="allv.vec", b="qs.vec")} AS BIGINT) AS dist_sq FROM allv CROSS JOIN qs)) WHERE rank <= 3""",
    )
    for m in (16, 32):
        w = 64 // m
        q[f"pq_codebook{m}"] = _with(_VECTORS, _MEAN, _book(m), rest=f"SELECT s AS subspace, centroid, CAST(i AS INTEGER) AS pos, CAST(c[i + 1] AS INTEGER) AS value FROM cb{m}, range({w}) r(i)")
        q[f"pq_encode{m}"] = _with(_VECTORS, _MEAN, _book(m), _codes(m), rest=f"SELECT vec_id, subspace, code FROM enc{m}")
        q[f"adc_table{m}"] = _with(_VECTORS, _MEAN, _book(m), _adc(m), rest=f"SELECT query_id, subspace, centroid, dist FROM adc{m}")
        q[f"adc_scan_topk{m}"] = _with(
            _VECTORS, _MEAN, _book(m), _codes(m), _adc(m),
            rest=f"""SELECT query_id, rank, vec_id, dist FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS INTEGER) AS rank
  FROM (SELECT query_id, vec_id, {_score("code", m)} AS dist FROM t{m} CROSS JOIN code{m})) WHERE rank <= 10""",
        )
    q["knn_graph"] = _with(_VECTORS, _GRAPH, rest="SELECT src, slot, dst FROM edge")
    q["cell_graph"] = q["knn_graph"]
    q["index_manifest"] = _with(
        _VECTORS, _GRAPH,
        rest="""SELECT CAST(1 AS BIGINT) AS generation, (SELECT count(*) FROM base) AS vectors, (SELECT count(*) FROM edge) AS edges, CAST(1 AS BIGINT) AS shards, (SELECT min(vec_id) FROM base) AS entry, true AS agrees""",
    )
    q["graph_in_degree"] = _with(_VECTORS, _GRAPH, rest="SELECT vec_id, count(dst) AS in_degree FROM base LEFT JOIN edge ON dst = vec_id GROUP BY vec_id")
    q["reverse_edges"] = _with(_VECTORS, _GRAPH, rest="SELECT dst AS vec_id, CAST(row_number() OVER (PARTITION BY dst ORDER BY src) - 1 AS INTEGER) AS slot, src FROM edge")
    q["graph_reachable"] = "WITH RECURSIVE" + ",".join([_VECTORS, _GRAPH]) + """,
reach(vec_id, hops) AS (SELECT min(vec_id), 0 FROM base UNION SELECT dst, hops + 1 FROM reach JOIN edge ON src = vec_id WHERE hops < 40)
SELECT vec_id, CAST(min(hops) AS INTEGER) AS hops FROM reach GROUP BY vec_id"""
    checks = {
        "vectors_unique": "SELECT vec_id FROM base GROUP BY vec_id HAVING count(*) > 1",
        "graph_unique": "SELECT src FROM edge GROUP BY src, slot HAVING count(*) > 1",
        "codes_unique": "SELECT vec_id FROM code16 GROUP BY vec_id HAVING count(*) > 1",
        "graph_missing": "SELECT vec_id FROM base WHERE vec_id NOT IN (SELECT src FROM edge)",
        "codes_missing": "SELECT vec_id FROM base WHERE vec_id NOT IN (SELECT vec_id FROM code16)",
        "edges_dangling": "SELECT dst FROM edge WHERE dst NOT IN (SELECT vec_id FROM base)",
        "edges_self": "SELECT src FROM edge WHERE src = dst",
        "edges_repeated": "SELECT src FROM edge GROUP BY src HAVING count(*) > count(DISTINCT dst)",
    }
    q["index_integrity"] = _with(_VECTORS, _MEAN, _book(16), _codes(16), _GRAPH, rest=" UNION ALL ".join(f"SELECT '{k}' AS \"check\", (SELECT count(*) FROM ({v})) AS violations" for k, v in checks.items()))
    q["address_codec"] = _with(
        _VECTORS,
        rest="""SELECT vec_id, (3::BIGINT << 27) | ((vec_id // 32 // 64) << 17) | ((vec_id // 32 % 64) << 11) | (vec_id % 32 * 64) AS address, CAST(vec_id % 32 * 64 AS INTEGER) AS addr_offset,
  CAST(vec_id // 32 % 64 AS INTEGER) AS addr_page, CAST(vec_id // 32 // 64 AS INTEGER) AS addr_block, CAST(3 AS INTEGER) AS addr_type FROM base""",
    )
    log = "SELECT query_id, CAST(i AS INTEGER) AS step, {x}[i].id AS vec_id, {x}[i].d AS dist FROM (SELECT query_id, exp, list_sort(exp) AS srt, unnest(range(1, len(exp) + 1)) AS i FROM final)"
    q["greedy_search"] = _search(16, 10, log.format(x="exp"))
    q["greedy_search_by_distance"] = _search(16, 10, log.format(x="srt"))
    q["greedy_hops"] = _search(16, 10, _COUNTERS)
    q["greedy_hops_limited"] = _search(16, 20, _COUNTERS, hops=8)
    q["greedy_early_stop"] = _search(16, 20, _COUNTERS, early=True)
    q["ann_topk"] = _search(32, 20, _TOP, _rerank(_ALL))
    q["partial_rerank"] = _search(16, 20, _TOP, _rerank("SELECT query_id, unnest(list_transform(list_sort(exp)[1:20], lambda z: z.id)) AS vec_id FROM final"))
    q["list_rerank"] = _search(16, 20, _TOP, _rerank("SELECT query_id, unnest(list_transform(lst, lambda z: z.id)) AS vec_id FROM final"))
    long = f"""v AS (SELECT * FROM ({_ALL}) WHERE vec_id <> query_id), {_book(32)}, {_codes(32)}, {_adc(32)},
lng AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY {_score("code", 32)}, vec_id) AS r FROM v JOIN code32 USING (vec_id) JOIN t32 USING (query_id))"""
    q["two_stage_rerank"] = _search(16, 20, _TOP, long + "," + _rerank("SELECT query_id, vec_id FROM lng WHERE r <= 30"))
    q["recall_by_distance"] = _search(
        32, 20, "SELECT q.query_id, CAST(count(x.dist_sq) AS DOUBLE) / 10.0::DOUBLE AS recall FROM qs q LEFT JOIN top t USING (query_id) LEFT JOIN (SELECT DISTINCT query_id, dist_sq FROM exact) x ON x.query_id = t.query_id AND x.dist_sq = t.dist_sq GROUP BY q.query_id", _rerank(_ALL) + "," + _EXACT
    )
    q["recall_by_id"] = _search(
        32, 20, "SELECT q.query_id, CAST(count(x.vec_id) AS DOUBLE) / 10.0::DOUBLE AS recall FROM qs q LEFT JOIN top t USING (query_id) LEFT JOIN exact x ON x.query_id = t.query_id AND x.vec_id = t.vec_id GROUP BY q.query_id", _rerank(_ALL) + "," + _EXACT
    )
    q["flash_bytes_model"] = _search(
        16, 10, "SELECT query_id, CAST(n_new * 16 AS BIGINT) AS code_bytes, CAST(hops * 128 AS BIGINT) AS list_bytes, CAST(hops * 128 AS BIGINT) AS vector_bytes, CAST(n_new * 16 + hops * 256 AS BIGINT) AS total_bytes FROM final"
    )
    q["search_profile"] = _search(
        16, 10,
        """SELECT n_query, CAST(h AS BIGINT) AS n_hops, CAST(n AS BIGINT) AS n_new, CAST(d AS BIGINT) AS n_dup, CAST(h AS DOUBLE) / n_query AS hops_per_query, CAST(n AS DOUBLE) / CAST(h AS DOUBLE) AS new_per_hop,
  CAST(d AS DOUBLE) / CAST(n + d AS DOUBLE) AS dup_ratio FROM (SELECT count(*) AS n_query, sum(hops) AS h, sum(n_new) AS n, sum(n_dup) AS d FROM final)""",
    )
    q["voltage_from_raw"] = _with(_RAW, rest="SELECT event_id, raw, voltage FROM volt")
    q["gear_select"] = _with(_RAW, rest=f"SELECT event_id, energy_uj, budget, {_GEAR} AS gear FROM bud")
    q["gear_search_config"] = _with(_VECTORS, _RAW, _PER_QUERY, rest="SELECT query_id, voltage, gear, l_size, m FROM qg JOIN gears USING (gear)")
    left = " ".join(f"WHEN floor(f.energy / 0.079904::DOUBLE) >= {cost} THEN {{{g}}}" for g, cost, *_ in sorted(GEARS, reverse=True))
    gears, costs = (left.format(*[r[k] for r in sorted(GEARS)]) for k in (0, 1))
    q["arrival_decisions"] = f"""WITH RECURSIVE ev AS MATERIALIZED (
  SELECT user_id AS device, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
    CASE WHEN event_type <> 'purchase' THEN CAST(CAST(least(4095, floor(value * 8.0::DOUBLE)) AS INTEGER) AS DOUBLE) * 0.001171875::DOUBLE END AS volts FROM events
), f(device, n, event_id, energy, seq, gear) AS (
  SELECT DISTINCT device, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), 0.0::DOUBLE, CAST(-1 AS BIGINT), CAST(NULL AS INTEGER) FROM ev
  UNION ALL
  SELECT f.device, e.n, e.event_id,
    CASE WHEN volts > 2.8::DOUBLE THEN {0.0047 * 500000 * 0.4!r}::DOUBLE * (volts * volts - {2.8 * 2.8!r}::DOUBLE) WHEN volts IS NOT NULL THEN 0.0::DOUBLE ELSE f.energy - (CASE {costs} ELSE 0 END) * 0.079904::DOUBLE END,
    f.seq + CASE WHEN volts IS NULL THEN 1 ELSE 0 END, CASE WHEN volts IS NULL THEN CAST(CASE {gears} ELSE 254 END AS INTEGER) END
  FROM f JOIN ev e ON e.device = f.device AND e.n = f.n + 1
)
SELECT device, event_id, seq, gear, energy AS energy_uj FROM f WHERE gear IS NOT NULL"""
    for name, by in (("gear_at_arrival", "a.user_id = s.user_id AND "), ("gear_at_arrival_of_all", "")):
        q[name] = _with(
            _RAW,
            rest=f"""SELECT event_id, sample_id, v AS voltage, {_GEAR} AS gear FROM (
  SELECT *, CAST(floor((CASE WHEN voltage > 2.8::DOUBLE THEN {0.0047 * 500000 * 0.4!r}::DOUBLE * (voltage * voltage - {2.8 * 2.8!r}::DOUBLE) ELSE 0.0::DOUBLE END) / 0.079904::DOUBLE) AS BIGINT) AS budget FROM (
  SELECT a.event_id, s.sample_id, s.voltage AS v, coalesce(s.voltage, 3.1::DOUBLE) AS voltage FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') a
  ASOF LEFT JOIN (SELECT v.event_id AS sample_id, v.user_id, ts, voltage FROM volt v JOIN events e USING (event_id) WHERE event_type <> 'purchase') s ON {by}a.ts >= s.ts))""",
        )
    q["gear_replay"] = _with(
        _VECTORS, " " + _GEARS,
        rest="SELECT query_id, gear, l_size, m FROM (SELECT query_id, CAST(CASE WHEN query_id % 20 = 0 THEN query_id // 20 % 6 ELSE 0 END AS INTEGER) AS gear FROM qs) JOIN gears USING (gear)",
    )
    q["pending_queries"] = _with(_VECTORS, rest="SELECT query_id FROM qs WHERE query_id % 30 <> 0")
    q["attempt_stats"] = """SELECT count(*) AS queries, CAST(sum(CASE WHEN attempts > 1 THEN 1 ELSE 0 END) AS BIGINT) AS missed, CAST(sum(attempts - 1) AS BIGINT) AS restarts
FROM (SELECT user_id, 1 + sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS attempts FROM events GROUP BY user_id)"""
    left = _EXACT.replace("WHERE base.vec_id <> query_id", "WHERE base.vec_id <> query_id AND base.vec_id % 7 <> 0")
    q["delete_tombstones"] = q["delta_scan"] = _with(_VECTORS, left, rest="SELECT * FROM exact")
    q["ann_tombstones_sharded"] = q["compacted_index_search"] = q["delete_tombstones"]
    q["merged_index_search"] = q["exact_knn"]
    q["merged_index_edges"] = _with(_VECTORS, rest="SELECT 'rows' AS \"check\", count(*) AS n FROM base UNION ALL SELECT unnest(['lost', 'astray', 'long', 'self']), 0")
    q["ann_tombstones"] = _search(32, 20, _TOP, _rerank(f"SELECT * FROM ({_ALL}) WHERE vec_id % 7 <> 0"))
    q["commit_restore"] = q["exact_knn"]
    # Of the parts 0 to 3 by query number, the run is stopped while at work on the third.
    q["attempts_recorded"] = _with(_VECTORS, rest="SELECT query_id, CAST(CASE WHEN query_id // 10 % 4 = 2 THEN 2 ELSE 1 END AS BIGINT) AS attempts FROM qs")
    # Four parts are attempted, the third twice; results are restored before each part and at the end of either run.
    ten = "(SELECT count(*) FROM qs) * 10"
    q["measured_phases"] = _with(
        _VECTORS,
        rest=f"""SELECT phase, CAST(calls AS BIGINT) AS calls, CAST(0 AS BIGINT) AS failed, CAST(n AS BIGINT) AS rows, true AS has_bytes, true AS timed FROM (VALUES
  ('attempt', 5, (SELECT count(*) + count(*) FILTER (WHERE query_id // 10 % 4 = 2) FROM qs)), ('commit', 4, {ten}), ('restore', 9, NULL), ('search', 1, (SELECT count(*) FROM qs)), ('rerank', 1, {ten})) t(phase, calls, n)""",
    )
    q["robust_prune"] = "WITH RECURSIVE" + ",".join([_VECTORS, _GRAPH]) + f""",
cand AS (SELECT e.src, list({{'d': {_L2.format(a="a.vec", b="b.vec")}, 'id': dst, 'v': b.vec}}) AS l FROM edge e JOIN base a ON a.vec_id = e.src JOIN base b ON b.vec_id = e.dst GROUP BY e.src),
rp(src, kept, alive) AS (
  SELECT src, CAST([] AS BIGINT[]), list_sort(l) FROM cand
  UNION ALL
  SELECT src, list_append(kept, alive[1].id), list_filter(alive[2:], lambda z: {1.2 * 1.2!r}::DOUBLE * {_L2.format(a="z.v", b="alive[1].v")} > z.d) FROM rp WHERE len(alive) > 0 AND len(kept) < 16
)
SELECT src, CAST(unnest(range(0, len(kept))) AS INTEGER) AS slot, unnest(kept) AS dst FROM rp WHERE len(alive) = 0 OR len(kept) = 16"""
    whole = " UNION ALL ".join(f"SELECT '{k}' AS \"check\", CAST(0 AS BIGINT) AS violations" for k in checks)
    q["insert_integrity"] = whole
    q["compact_integrity"] = f"{whole} UNION ALL SELECT 'vectors_left', count(*) FROM embeddings WHERE vec_id % 7 <> 0"
    beams = [_beam(m, n, tag=f"_{g}", who=f"WHERE query_id IN (SELECT query_id FROM qg WHERE gear = {g})") for g, _, n, m in GEARS]
    every = " UNION ALL ".join(f"SELECT query_id, {g} AS gear, unnest(list_transform(exp, lambda z: z.id)) AS vec_id FROM final_{g}" for g, *_ in GEARS)
    parts = [_VECTORS, _MEAN, _book(16), _book(32), _codes(16), _codes(32), _adc(16), _adc(32), _GRAPH, _RAW, _PER_QUERY, *beams, _rerank(every)]
    q["gear_ann"] = "WITH RECURSIVE" + ",".join(parts) + "\nSELECT t.query_id, rank, vec_id, dist_sq, gear FROM top t JOIN qg ON qg.query_id = t.query_id"
    pos = "vec_id, CAST(p AS INTEGER) AS pos, "
    q["dsp_vector"] = _with(
        _PAIRS,
        rest=f"SELECT {pos}{_sat('a + b')} AS add_q, {_sat('a - b')} AS sub_q, {_low(_shr('a * b', 15))} AS mpy_q, abs(a) AS abs_q, {_sat('-a')} AS neg_q, {_sat('a + 20000')} AS offset_q, {_low(_shr('a * 16384', 13))} AS scale_q, {_sat('a * 4')} AS shift_q, {_shr('a', 3)} AS back_q FROM e",
    )
    q["dsp_iq31"] = _with(
        _PAIRS,
        rest=f"SELECT {pos}{_sat('a * 65536 + b * 65536', 32)} AS add_q, {_sat('a * 65536 - b * 65536', 32)} AS sub_q, {_sat('-a * 65536', 32)} AS neg_q, a AS narrow_q, {_sat('a * 131072', 32)} AS shift_q FROM e",
    )
    last = lambda v, x: f"CAST(64 - list_position(list_reverse({v}), {x}) AS BIGINT)"
    q["dsp_reduce"] = _with(
        _PAIRS + ", u AS (SELECT *, list_transform(a, lambda x: (x + 65536) % 65536) AS ua FROM pr)",
        rest=f"SELECT vec_id, CAST(2 * list_sum(list_transform(range(1, 65), lambda i: a[i] * b[i])) AS BIGINT) AS mac_q, list_max(a) AS max_q, {last('a', 'list_max(a)')} AS max_at, list_min(a) AS min_q, {last('a', 'list_min(a)')} AS min_at, list_max(ua) AS umax_q, {last('ua', 'list_max(ua)')} AS umax_at FROM u",
    )
    q["dsp_complex"] = _complex_sql()
    total = "CAST(list_sum(list_transform(range(0, 8), lambda k: a[p // 8 * 8 + k + 1] * b[k * 8 + p % 8 + 1])) AS BIGINT)"
    q["dsp_matrix"] = _with(
        _PAIRS + ", f AS (SELECT vec_id, a, b, unnest(range(0, 64)) AS p FROM pr)",
        rest=f"SELECT {pos}{_sat('a[p + 1] + b[p + 1]')} AS add_q, {_sat('a[p + 1] - b[p + 1]')} AS sub_q, {_low(_shr(total, 15))} AS mpy_q, a[p % 8 * 8 + p // 8 + 1] AS trans_q, {_sat('-a[p + 1]')} AS neg_q FROM f",
    )
    taps = " + ".join(f"{t} * CASE WHEN p >= {k} THEN a[p - {k} + 1] ELSE 0 END" for k, t in enumerate((8192, 16384, 8192, -4096)))
    q["dsp_fir"] = _with(_PAIRS + ", f AS (SELECT vec_id, a, unnest(range(0, 64)) AS p FROM pr)", rest=f"SELECT {pos}{_sat(_shr('(' + taps + ')', 15))} AS fir_q FROM f")
    q["dsp_utility"] = _with(
        _PAIRS + ", f AS (SELECT vec_id, a, b, unnest(range(0, 64)) AS p FROM pr)",
        rest=f"SELECT {pos}CASE WHEN p % 2 = 0 THEN a[p // 2 + 1] ELSE b[p // 2 + 1] END AS inter_q, b[p + 1] AS channel_q, CAST(7 AS BIGINT) AS fill_q FROM f",
    )
    place = "row_number() OVER (ORDER BY {0}) - 1 AS {0}"
    long = "SELECT {key}, CAST(p AS INTEGER) AS pos, CAST({v}[p + 1] AS BIGINT) AS value FROM ({src}), range({n}) r(p)"
    q["binary_vectors"] = _with(_VECTORS, rest=long.format(key="vec_id", v="vec", n=64, src=f"SELECT {place.format('vec_id')}, vec FROM base"))
    q["binary_queries"] = _with(_VECTORS, rest=long.format(key="query_id", v="vec", n=64, src=f"SELECT {place.format('query_id')}, vec FROM qs"))
    lists = "SELECT src, list(dst ORDER BY slot) AS l FROM edge GROUP BY src"
    q["binary_neighbors"] = _with(_VECTORS, _GRAPH, rest=long.format(key="vec_id", v="l", n=32, src=f"SELECT row_number() OVER (ORDER BY src) - 1 AS vec_id, l FROM ({lists})"))
    both = f"SELECT {place.format('vec_id')}, list_concat(a.code, b.code) AS l FROM code16 a JOIN code32 b USING (vec_id)"
    q["binary_codes"] = _with(_VECTORS, _MEAN, _book(16), _codes(16), _book(32), _codes(32), rest=long.format(key="vec_id", v="l", n=48, src=both))
    q["binary_ground_truth"] = _with(_VECTORS, _EXACT, rest="SELECT query_id, CAST(rank - 1 AS INTEGER) AS pos, dist_sq AS value FROM (SELECT dense_rank() OVER (ORDER BY query_id) - 1 AS query_id, rank, dist_sq FROM exact)")
    books = " UNION ALL ".join(f"SELECT CAST({m} AS INTEGER) AS m, s AS subspace, centroid, CAST(p AS INTEGER) AS pos, CAST(c[p + 1] AS INTEGER) AS value FROM cb{m}, range({64 // m}) r(p)" for m in (16, 32))
    q["binary_codebooks"] = _with(_VECTORS, _MEAN, _book(16), _book(32), rest=books)
    q["binary_mean"] = _with(_VECTORS, _MEAN, rest="SELECT CAST(0 AS BIGINT) AS row, CAST(d AS INTEGER) AS pos, mean AS value FROM mean_d")
    q["config_checks"] = """SELECT CAST(l AS INTEGER) AS l_size, CAST(m AS INTEGER) AS m, rr AS rerank, CAST(p AS INTEGER) AS partial, CAST(f AS INTEGER) AS refine, CAST(h AS INTEGER) AS max_hops, e AS early_stop,
  l < 1 OR l > 1000 OR m NOT IN (16, 32) OR (rr = 'two_stage' AND (m = 32 OR f < 10)) OR (rr = 'partial' AND p < 10) OR (h IS NOT NULL AND (h < 1 OR e)) AS refused
FROM (VALUES (0), (1), (2000)) a(l), (VALUES (8), (16), (32)) b(m), (VALUES ('full'), ('partial'), ('two_stage'), ('list')) c(rr), (VALUES (3), (20)) d(p), (VALUES (5), (30)) g(f), (VALUES (NULL), (0), (5)) i(h), (VALUES (false), (true)) j(e)"""
    q["ring_search"] = "SELECT q AS query_id, CAST(i + 1 AS INTEGER) AS rank, i AS vec_id, CAST(0 AS BIGINT) AS dist_sq FROM range(100) a(q), range(10) b(i)"
    return q
