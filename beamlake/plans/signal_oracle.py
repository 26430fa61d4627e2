"""The queries of signal_queries as DuckDB SQL. BIGINT >> is an arithmetic shift there, as in Spark."""

from __future__ import annotations

from beamlake.config import GEARS
from beamlake.plans.oracle import _PER_QUERY, _RAW, _VECTORS, _low, _sat, _with
from beamlake.plans.signal_queries import DF1, DF2, TAPS, TRANSFORMS


def _in(bits: int) -> str:
    """pr(vec_id, a, b): vectors of a width; e(vec_id, p, a, b): their elements."""
    x = _sat("CAST(x AS BIGINT) * 60")
    v = f"list_transform(vec, lambda x: {x})"
    if bits == 32:
        v = f"list_transform({v}, lambda x: x * 65536 + ((x * 40503) % 65536 + 65536) % 65536)"
    return f"""{_VECTORS},
pr AS MATERIALIZED (SELECT vec_id, {v} AS a, list_reverse({v}) AS b FROM allv),
e AS (SELECT vec_id, unnest(range(0, 64)) AS p, unnest(a) AS a, unnest(b) AS b FROM pr)"""


_AT = "vec_id, CAST(p AS INTEGER) AS pos, "
_F = ", f AS (SELECT vec_id, a, b, unnest(range(0, 64)) AS p FROM pr)"


def _sr(x: str, k: int) -> str:
    return f"(({x}) >> {k})"


def _columns(cols: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in cols.items())


def _fir(taps: list[int], bits: int, x: str, i: str = "p") -> str:
    """Sum of taps times earlier elements of list x; 32-bit products are cut first."""
    part = lambda k, t: f"CASE WHEN {i} >= {k} THEN {x}[{i} - {k} + 1] * {t} ELSE 0 END"
    return " + ".join(_sr(part(k, t), 31) if bits == 32 else part(k, t) for k, t in enumerate(taps))


def _complex_fir(bits: int) -> str:
    re, im = [t << bits - 16 for t in TAPS], [-u << bits - 16 for u in reversed(TAPS)]
    end = 0 if bits == 32 else 15
    minus = lambda t: [-x for x in t]
    if bits == 32:  # a difference of cut products, not the cut of a negated one
        real = f"({_fir(re, 32, 'a')}) - ({_fir(im, 32, 'b')})"
    else:
        real = f"({_fir(re, 16, 'a')}) + ({_fir(minus(im), 16, 'b')})"
    imag = f"({_fir(im, bits, 'a')}) + ({_fir(re, bits, 'b')})"
    return _with(_in(bits) + _F, rest=f"SELECT {_AT}{_sat(_sr(real, end), bits)} AS fir_re, {_sat(_sr(imag, end), bits)} AS fir_im FROM f")


def _q(x: str, k: int) -> str:
    return _sr(f"{x} * {k}", 15)


def _df1(src: str, tag: str, b: tuple, c: tuple) -> str:
    """Recursion over places; out{tag}(vec_id, out, x1, x2, y1, y2)."""
    y = _sat(f"{_q('x', b[0])} + 2 * {_q('x1', b[1])} + {_q('x2', b[2])} + 2 * {_q('y1', c[0])} + {_q('y2', c[1])}")
    zero = "CAST(0 AS BIGINT)"
    return f"""
r{tag}(vec_id, i, a, out, x1, x2, y1, y2) AS (SELECT vec_id, 0, a, CAST([] AS BIGINT[]), {zero}, {zero}, {zero}, {zero} FROM {src}
  UNION ALL SELECT vec_id, i + 1, a, list_append(out, y), x, x1, y, y1 FROM (SELECT *, {y} AS y FROM (SELECT *, a[i + 1] AS x FROM r{tag} WHERE i < 64))),
out{tag} AS (SELECT vec_id, out, x1, x2, y1, y2 FROM r{tag} WHERE i = 64)"""


def _df2(src: str, tag: str, b: tuple, c: tuple, bias: int = 0) -> str:
    w = _sat(f"{bias} + {_q('x', c[0])} + 2 * {_q('q1', c[1])} + {_q('q2', c[2])}")
    y = _sat(f"{_q('w', b[0])} + 2 * {_q('q1', b[1])} + {_q('q2', b[2])}")
    zero = "CAST(0 AS BIGINT)"
    return f"""
r{tag}(vec_id, i, a, out, q1, q2, low, high) AS (SELECT vec_id, 0, a, CAST([] AS BIGINT[]), {zero}, {zero}, CAST(32767 AS BIGINT), CAST(-32768 AS BIGINT) FROM {src}
  UNION ALL SELECT vec_id, i + 1, a, list_append(out, {y}), w, q1, least(low, w), greatest(high, w) FROM (SELECT *, {w} AS w FROM (SELECT *, a[i + 1] AS x FROM r{tag} WHERE i < 64))),
out{tag} AS (SELECT vec_id, out, q1, q2, low, high FROM r{tag} WHERE i = 64)"""


def _next(tag: str) -> str:
    return f"(SELECT vec_id, out AS a FROM out{tag})"


def _fft(bits: int, auto: bool, inverse: bool, real: bool = False) -> str:
    """Six stages over rows (vec_id, i, re, im)."""
    im = "CAST(0 AS BIGINT)" if real else "b[rev + 1]"
    first = f"SELECT vec_id, i, a[rev + 1] AS re, {im} AS im, CAST(0 AS BIGINT) AS sh FROM (SELECT vec_id, a, b, i, {_reversed(6)} AS rev FROM pr, range(64) r(i))"
    out = _in(bits) + _stages(first, 6, bits, auto, inverse)
    return "WITH" + out + "\nSELECT vec_id, CAST(i AS INTEGER) AS pos, re, im, CAST(sh AS INTEGER) AS shift FROM s6"


def _reversed(log: int) -> str:
    return " + ".join(f"((i >> {k}) & 1) * {1 << log - 1 - k}" for k in range(log))


def _stages(first: str, log: int, bits: int, auto: bool, inverse: bool = False, tag: str = "") -> str:
    """Tables s{tag}0 (first) to s{tag}{log}, one per stage; h holds each vector's halvings."""
    sign, one, edge, s = (1 if inverse else -1), 1 << bits - 1, 1 << bits - 2, bits - 1
    out = f""",
s{tag}0 AS MATERIALIZED ({first})"""
    for k in range(log):
        half = 1 << k
        wide = f"max(CASE WHEN re >= {edge} OR re < {-edge} OR im >= {edge} OR im < {-edge} THEN 1 ELSE 0 END)" if auto else "1"
        cut = lambda x: f"CAST(greatest({-one}, least({one - 1}, floor({one}.0::DOUBLE * {x} + 0.5::DOUBLE))) AS BIGINT)"
        wr, wi = cut(f"cos(pi() * j / {half})"), cut(f"{sign} * sin(pi() * j / {half})")
        if half == 1:
            tr, ti = "br", "bi"
        elif half == 2:
            tr, ti = f"CASE WHEN j = 0 THEN br ELSE {-sign} * bi END", f"CASE WHEN j = 0 THEN bi ELSE {sign} * br END"
        else:
            tr, ti = f"{_sr('br * wr', s)} - {_sr('bi * wi', s)}", f"{_sr('br * wi', s)} + {_sr('bi * wr', s)}"
        out += f""",
h{tag}{k} AS (SELECT vec_id, {wide} AS h FROM s{tag}{k} GROUP BY vec_id),
t{tag}{k} AS MATERIALIZED (SELECT vec_id, i, ar, ai, h, sh, {tr} AS tr, {ti} AS ti FROM (SELECT *, {wr} AS wr, {wi} AS wi FROM (
  SELECT x.vec_id, x.i, x.i % {half} AS j, x.re AS ar, x.im AS ai, y.re AS br, y.im AS bi, h, x.sh FROM s{tag}{k} x JOIN s{tag}{k} y ON y.vec_id = x.vec_id AND y.i = x.i + {half} JOIN h{tag}{k} h ON h.vec_id = x.vec_id WHERE x.i % {2 * half} < {half}))),
s{tag}{k + 1} AS MATERIALIZED (SELECT vec_id, i, (ar + tr) >> h AS re, (ai + ti) >> h AS im, sh + h AS sh FROM t{tag}{k} UNION ALL SELECT vec_id, i + {half}, (ar - tr) >> h, (ai - ti) >> h, sh + h FROM t{tag}{k})"""
    return out


def _split(src: str, name: str, bits: int) -> str:
    """name(vec_id, i, re, im, sh): 32 bins of a real transform of 64 places from those of a complex one of 32."""
    wide = bits != 16
    by, two = (0, 2) if wide else (1, 1)
    cut = lambda x: f"(CAST(greatest(-32768, least(32767, floor(32768.0::DOUBLE * {x} + 0.5::DOUBLE))) AS BIGINT) >> {by})"
    low = lambda x: _low(x, bits)
    tr, ti = f"{_sr('br * c', 15)} - {_sr('bi * d', 15)}", f"{_sr('br * d', 15)} + {_sr('bi * c', 15)}"
    return f""",
p{name} AS MATERIALIZED (SELECT vec_id, i, sh, ar, ai, {tr} AS tr, {ti} AS ti FROM (
  SELECT x.vec_id, x.i, x.sh, (x.re + y.re) >> {by} AS ar, (x.im - y.im) >> {by} AS ai, {low('x.re - y.re')} AS br, {low('x.im + y.im')} AS bi, {cut('cos(pi() * x.i / 32)')} AS c, {cut('-sin(pi() * x.i / 32)')} AS d
  FROM {src} x JOIN {src} y ON y.vec_id = x.vec_id AND y.i = 32 - x.i WHERE x.i BETWEEN 1 AND 15)),
{name} AS MATERIALIZED (
  SELECT vec_id, i, {low(f'{two} * (re + im)')} AS re, CAST(0 AS BIGINT) AS im, sh FROM {src} WHERE i = 0
  UNION ALL SELECT vec_id, i, {low(f'{two} * re')}, {low(f'-{two} * im')}, sh FROM {src} WHERE i = 16
  UNION ALL SELECT vec_id, i, {low('ar + ti')}, {low('ai - tr')}, sh FROM p{name}
  UNION ALL SELECT vec_id, 32 - i, {low('ar - ti')}, {low('-(ai + tr)')}, sh FROM p{name})"""


def _halves(bits: int, auto: bool, back: bool) -> str:
    """A real transform by halves, and its inverse."""
    first = f"SELECT vec_id, i, a[2 * rev + 1] AS re, a[2 * rev + 2] AS im, CAST(0 AS BIGINT) AS sh FROM (SELECT vec_id, a, i, {_reversed(5)} AS rev FROM pr, range(32) r(i))"
    out = _in(bits) + _stages(first, 5, bits, auto) + _split("s5", "f", bits)
    if not back:
        return "WITH" + out + "\nSELECT vec_id, CAST(i AS INTEGER) AS pos, re, im, CAST(sh AS INTEGER) AS shift FROM f"
    h = 1 << bits - 1
    up = lambda x, n: f"greatest({-h}, least({h - 1}, CAST({x} AS HUGEINT) * (1::HUGEINT << CAST({n} AS INTEGER))))"
    # The wide form doubles while all components stay in the middle eighth of the width.
    free = "0" if bits == 16 else f"CASE WHEN min(least(re, im, -re, -im)) = 0 THEN 0 ELSE (SELECT count(*) FROM range(32) q(j) WHERE min(least(re, im, -re, -im)) * (1::HUGEINT << CAST(j AS INTEGER)) > {-h // 8}) END"
    out += f""",
w AS MATERIALIZED (SELECT vec_id, CAST({free} AS BIGINT) AS free FROM f GROUP BY vec_id),
c AS MATERIALIZED (SELECT vec_id, i, CAST({up('re', 'free')} AS BIGINT) AS re, CAST({up(_low('-im', bits), 'free')} AS BIGINT) AS im, CAST(0 AS BIGINT) AS sh FROM f JOIN w USING (vec_id))"""
    out += _split("c", "g", bits)
    again = f"SELECT r.vec_id, r.i, g.re, g.im, CAST(0 AS BIGINT) AS sh FROM (SELECT vec_id, i, {_reversed(5)} AS rev FROM g) r JOIN g ON g.vec_id = r.vec_id AND g.i = r.rev"
    out += _stages(again, 5, bits, bits == 16, tag="g")
    by = "-free" if bits != 16 else "sg5.sh + fs - 5" if auto else "sg5.sh"
    moved = lambda x: f"CASE WHEN n >= 0 THEN CAST({up(x, 'greatest(n, 0)')} AS BIGINT) ELSE {x} >> CAST(greatest(-n, 0) AS INTEGER) END"
    return "WITH" + out + f""",
o AS (SELECT vec_id, i, {moved('re')} AS re, {moved('im')} AS im FROM (SELECT sg5.*, {by} AS n FROM sg5 JOIN w USING (vec_id) JOIN (SELECT vec_id AS v, max(sh) AS fs FROM f GROUP BY vec_id) ON v = vec_id))
SELECT vec_id, CAST(2 * i AS INTEGER) AS pos, re AS value FROM o UNION ALL SELECT vec_id, CAST(2 * i + 1 AS INTEGER), {_low('-im', bits)} FROM o"""


def _crc(width: int) -> str:
    """Bit by bit, over the bytes of props."""
    hexed = "list_transform(range(1, octet_length(encode(props)) + 1), lambda i: (strpos('0123456789ABCDEF', hex(encode(props))[2 * i - 1]) - 1) * 16 + strpos('0123456789ABCDEF', hex(encode(props))[2 * i]) - 1)"
    if width == 32:  # reflected
        step = "c"
        for _ in range(8):
            step = f"list_transform([{step}], lambda z: CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384) ELSE z >> 1 END)[1]"
        step = step.replace("[c]", "[xor(c, x)]")
        return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {hexed}), lambda c, x: {step}), 4294967295)"
    step = "c"
    for _ in range(8):
        step = f"list_transform([{step}], lambda z: CASE WHEN z & 32768 <> 0 THEN xor((z << 1) & 65535, 4129) ELSE (z << 1) & 65535 END)[1]"
    step = step.replace("[c]", "[xor(c, x << 8)]")
    return f"list_reduce(list_prepend(CAST(65535 AS BIGINT), {hexed}), lambda c, x: {step})"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    c31 = lambda x: _low(_sr(x, 31), 32)
    s31 = lambda x: _sat(x, 32)
    one = {"abs_q": s31("abs(a)"), "neg_q": s31("-a"), "offset_q": s31("a + 1500000000"), "scale_q": _low(_sr("a * 1073741824", 29), 32), "shift_q": s31("a * 4")}
    q["dsp_vector31"] = _with(_in(32), rest=f"SELECT {_AT}{_columns(one | {'add_q': s31('a + b'), 'sub_q': s31('a - b'), 'mpy_q': c31('a * b'), 'back_q': _sr('a', 3)})} FROM e")
    low = {"abs15": _sat("abs(x)"), "abs31": s31("abs(y)"), "neg15": _sat("-x"), "neg31": s31("-y")}
    q["dsp_absolute"] = _with(_in(16), rest=f"SELECT {_AT}{_columns(low)} FROM (SELECT vec_id, p, CASE WHEN p = 0 THEN -32768 ELSE a END AS x, CASE WHEN p = 0 THEN -2147483648 ELSE a * 65536 END AS y FROM e)")
    last = lambda v, x: f"CAST(64 - list_position(list_reverse({v}), {x}) AS BIGINT)"
    ends = {f"{u}{k}_{n}": f"list_{k}({v})" if n == "q" else last(v, f"list_{k}({v})") for u, v in (("", "a"), ("u", "ua")) for k in ("max", "min") for n in ("q", "at")}
    unsigned = ", u AS (SELECT *, list_transform(a, lambda x: (x + {0}) % {0}) AS ua FROM pr)"
    mac = "CAST(list_sum(list_transform(range(1, 65), lambda i: (a[i] * b[i]) >> 31)) AS BIGINT)"
    q["dsp_reduce31"] = _with(_in(32) + unsigned.format(1 << 32), rest=f"SELECT vec_id, {mac} AS mac_q, {_columns(ends)} FROM u")
    q["dsp_umin15"] = _with(_in(16) + unsigned.format(1 << 16), rest=f"SELECT vec_id, {ends['umin_q']} AS umin_q, {ends['umin_at']} AS umin_at FROM u")
    h = 536870912
    wide = {
        "add_re": s31("a + b"), "add_im": s31("b + a"), "sub_re": s31("a - b"), "sub_im": s31("b - a"), "conj_re": "a", "conj_im": s31("-b"),
        "mpy_re": c31("a * b - b * a"), "mpy_im": c31("a * a + b * b"), "real_re": c31("a * b"), "real_im": c31("b * b"),
        "scale_re": c31(f"a * {h} + b * {h}"), "scale_im": c31(f"b * {h} - a * {h}"), "shift_re": s31("a * 2"), "shift_im": s31("b * 2"),
    }
    q["dsp_complex31"] = _with(_in(32), rest=f"SELECT {_AT}{_columns(wide)} FROM e")
    total = lambda x: f"CAST(list_sum(list_transform(range(1, 65), lambda i: {x})) AS BIGINT)"
    q["dsp_complex_mac"] = f"""SELECT * FROM ({_with(_in(16), rest=f"SELECT vec_id, {total('a[i] * b[i] - b[i] * a[i]')} AS re15, {total('a[i] * a[i] + b[i] * b[i]')} AS im15 FROM pr")}) JOIN
({_with(_in(32), rest=f"SELECT vec_id, {total('((a[i] * b[i]) >> 31) - ((b[i] * a[i]) >> 31)')} AS re31, {total('((a[i] * a[i]) >> 31) + ((b[i] * b[i]) >> 31)')} AS im31 FROM pr")}) USING (vec_id)"""
    m15 = {"abs_q": _sat("abs(a)"), "offset_q": _sat("a + 20000"), "scale_q": _low(_sr("a * 16384", 13)), "shift_q": _sat("a * 4"), "back_q": _sr("a", 3)}
    q["dsp_matrix15"] = _with(_in(16), rest=f"SELECT {_AT}{_columns(m15)} FROM e")
    product = "CAST(list_sum(list_transform(range(0, 8), lambda k: (a[p // 8 * 8 + k + 1] * b[k * 8 + p % 8 + 1]) >> 31)) AS BIGINT)"
    m31 = {k: v.replace("abs(a)", "abs(a[p + 1])").replace("-a", "-a[p + 1]").replace("a +", "a[p + 1] +").replace("a *", "a[p + 1] *") for k, v in one.items()}
    m31 |= {"add_q": s31("a[p + 1] + b[p + 1]"), "sub_q": s31("a[p + 1] - b[p + 1]"), "mpy_q": _low(product, 32), "trans_q": "a[p % 8 * 8 + p // 8 + 1]"}
    q["dsp_matrix31"] = _with(_in(32) + _F, rest=f"SELECT {_AT}{_columns(m31)} FROM f")
    q["dsp_fir31"] = _with(_in(32) + _F, rest=f"SELECT {_AT}{s31(_fir([t << 16 for t in TAPS], 32, 'a'))} AS fir_q FROM f")
    q["dsp_complex_fir15"], q["dsp_complex_fir31"] = _complex_fir(16), _complex_fir(32)
    q["dsp_utility31"] = _with(
        _in(32) + _F,
        rest=f"""SELECT {_AT}CASE WHEN p % 2 = 0 THEN a[p // 2 + 1] ELSE b[p // 2 + 1] END AS inter_q, b[p + 1] AS channel_q, CAST(-2147483648 AS BIGINT) AS fill_q, CAST(5 AS BIGINT) AS fill_re, CAST(-6 AS BIGINT) AS fill_im,
  a[p + 1] AS pair_re, b[p + 1] AS pair_im, CAST(floor(32767.0::DOUBLE * sin(p * 0.1::DOUBLE) + 0.5::DOUBLE) AS BIGINT) AS sin_q FROM f""",
    )
    stages = [
        _df1("pr", "_1", *DF1[0]), _df1(_next("_1"), "_c1", *DF1[1]), _df2("pr", "_2", *DF2[0][:2]), _df2(_next("_2"), "_c2", *DF2[1][:2]),
        _df2("pr", "_3", *DF2[0]), _df2(_next("_3"), "_c3", *DF2[1]),
    ]
    names = {"df1_q": "_1", "df2_q": "_2", "ext_q": "_3", "cascade1_q": "_c1", "cascade2_q": "_c2", "cascade_ext_q": "_c3"}
    joins = " ".join(f"JOIN out{t} o{t} USING (vec_id)" for t in names.values())
    head = "WITH RECURSIVE" + _in(16) + "," + ",".join(stages)
    q["dsp_biquad"] = f"{head}\nSELECT vec_id, CAST(p AS INTEGER) AS pos, {_columns({k: f'o{t}.out[p + 1]' for k, t in names.items()})} FROM pr {joins}, range(64) r(p)"
    q["dsp_biquad_state"] = f"{head}\nSELECT vec_id, x1, x2, y1, y2, q1, q2, low, high FROM out_1 JOIN out_3 USING (vec_id)"
    dft = lambda f, sign: f"list_sum(list_transform(range(0, 64), lambda n: {sign}a[n + 1] * {f}(2 * pi() * CAST(k * n % 64 AS DOUBLE) / 64))) / 64"
    cents = lambda x: f"CAST(floor(({x}) * 100 + 0.3::DOUBLE) AS BIGINT)"
    q["dsp_fft"] = _with(_in(16), rest=f"SELECT vec_id, CAST(k AS INTEGER) AS pos, {cents(dft('cos', ''))} AS re, {cents(dft('sin', '-'))} AS im, a[k + 1] AS back FROM pr, range(33) r(k)")
    for name, bits, auto, inverse in TRANSFORMS:
        q[name] = _fft(bits, auto, inverse)
    for name, bits, auto in (("fixed15", 16, False), ("auto15", 16, True), ("q31", 32, False)):
        q[f"rfft_halves_{name}"], q[f"irfft_{name}"] = _halves(bits, auto, False), _halves(bits, auto, True)
    q["rfft_fixed15"], q["rfft_auto15"], q["rfft31"] = _fft(16, False, False, True), _fft(16, True, False, True), _fft(32, False, False, True)
    q["checksums"] = f"SELECT event_id, {_crc(32)} AS crc32, {_crc(16)} AS crc16 FROM events"
    q["aes_round_trip"] = "SELECT event_id, CAST((octet_length(encode(props)) // 16 + 1) * 16 AS BIGINT) AS n, true AS same, props FROM events"
    q["file_lines"] = "SELECT printf('%05d|%s|%d', event_id, event_type, user_id) AS line FROM events"
    steps = ["mkdir", "write", "forward", "rename", "list", "truncate", "unlink", "gone"]
    q["file_operations"] = " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS step, '{k}' AS operation, true AS ok" for i, k in enumerate(steps))
    for name, gear in (("gear_fixed", 4), ("gear_power_event", 0)):
        _, _, size, m = GEARS[gear]
        q[name] = _with(_VECTORS, rest=f"SELECT query_id, CAST({gear} AS INTEGER) AS gear, CAST({size} AS INTEGER) AS l_size, CAST({m} AS INTEGER) AS m FROM qs")
    q["voltage_log"] = _with(
        _VECTORS, _RAW, _PER_QUERY,
        rest="""SELECT event_id AS seq, user_id AS query_id, raw, voltage, CAST(CASE WHEN energy_uj <= 0 THEN 254 WHEN gear IS NOT NULL AND event_id = last THEN gear ELSE 255 END AS INTEGER) AS op
FROM en LEFT JOIN (SELECT query_id, gear FROM qg) ON query_id = user_id LEFT JOIN (SELECT user_id AS u, max(event_id) AS last FROM en WHERE energy_uj > 0 GROUP BY user_id) ON u = user_id""",
    )
    q["arrival_schedule"] = _with(_VECTORS, rest="SELECT query_id, row_number() OVER (ORDER BY query_id) - 1 AS seq, (row_number() OVER (ORDER BY query_id) - 1) * 250 AS due_ms FROM qs")
    q["phase_statistics"] = """WITH t AS (SELECT event_type AS phase, CAST(floor(value) AS BIGINT) AS x FROM events), g AS (
SELECT phase, count(*) AS calls, CAST(sum(x) AS BIGINT) AS total, min(x) AS least, max(x) AS greatest FROM t GROUP BY phase)
SELECT *, CAST(total AS DOUBLE) / calls AS mean, CAST(total AS DOUBLE) / CAST((SELECT sum(x) FROM t) AS DOUBLE) AS share FROM g"""
    return q

