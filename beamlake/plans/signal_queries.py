"""Registered queries of the fixed-point functions in both widths, filters, transforms, checksums, and files."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamlake.functions import checksum, dsp, energy
from beamlake.operators import build, stats
from beamlake.operators.tables import shared_dir
from beamlake.plans.ann_queries import _exploded, _gear_queries, _samples
from beamlake.sources.files import FileStore, write_lines
from beamlake.streaming.paced import schedule

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _inputs(spark: SparkSession, sf_dir: str, bits: int = dsp.Q15) -> DataFrame:
    """vec_id and vectors a, and b, which is a reversed; of 32 bits all bits are in use."""
    narrow = F.transform("vec", lambda x: dsp.clamp((x * 60).cast("bigint"), dsp.Q15))
    wide = F.transform(narrow, lambda x: x * 65536 + F.pmod(x * 40503, F.lit(65536)))
    v = build.quantized(spark, sf_dir).select("vec_id", (narrow if bits == dsp.Q15 else wide).alias("a"))
    return v.withColumn("b", F.reverse("a"))


def _complex(spark: SparkSession, sf_dir: str, bits: int) -> DataFrame:
    return _inputs(spark, sf_dir, bits).select("vec_id", "b", dsp.complex_vector(F.col("a"), F.col("b")).alias("x"), dsp.complex_vector(F.col("b"), F.col("a")).alias("y"))


def _halves(parts: dict) -> dict:
    part = {"re": lambda z: z["re"], "im": lambda z: z["im"]}
    return {f"{k}_{p}": F.transform(v, f) for k, v in parts.items() for p, f in part.items()}


@query
def dsp_vector31(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = dsp.IQ31
    return _exploded(
        _inputs(spark, sf_dir, w), add_q=dsp.add(F.col("a"), F.col("b"), w), sub_q=dsp.sub(F.col("a"), F.col("b"), w), mpy_q=dsp.mpy(F.col("a"), F.col("b"), w), abs_q=dsp.absolute(F.col("a"), w), neg_q=dsp.negate(F.col("a"), w),
        offset_q=dsp.offset(F.col("a"), 1500000000, w), scale_q=dsp.scale(F.col("a"), 1073741824, 2, w), shift_q=dsp.shift(F.col("a"), 2, w), back_q=dsp.shift(F.col("a"), -3, w),
    )


@query
def dsp_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute values and negatives with the least number of either width in the first place."""
    low = lambda a, bits: F.concat(F.array(F.lit(-(1 << bits - 1)).cast("bigint")), F.slice(a, 2, 63))
    p = _inputs(spark, sf_dir).select("vec_id", low(F.col("a"), 16).alias("a"), low(dsp.q15_to_iq31(F.col("a")), 32).alias("b"))
    return _exploded(p, abs15=dsp.absolute(F.col("a")), abs31=dsp.absolute(F.col("b"), 32), neg15=dsp.negate(F.col("a")), neg31=dsp.negate(F.col("b"), 32))


@query
def dsp_reduce31(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = dsp.IQ31
    p = _inputs(spark, sf_dir, w)
    pairs = {"max": dsp.maximum(F.col("a")), "min": dsp.minimum(F.col("a")), "umax": dsp.maximum(dsp.unsigned(F.col("a"), w)), "umin": dsp.minimum(dsp.unsigned(F.col("a"), w))}
    return p.select("vec_id", dsp.mac(F.col("a"), F.col("b"), w).alias("mac_q"), *[c.cast("bigint").alias(f"{k}_{n}") for k, both in pairs.items() for n, c in zip(("q", "at"), both, strict=True)])


@query
def dsp_umin15(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, at = dsp.minimum(dsp.unsigned(F.col("a")))
    return _inputs(spark, sf_dir).select("vec_id", lo.alias("umin_q"), at.cast("bigint").alias("umin_at"))


@query
def dsp_complex31(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, x, y = dsp.IQ31, F.col("x"), F.col("y")
    parts = {
        "add": dsp.complex_add(x, y, w), "sub": dsp.complex_sub(x, y, w), "conj": dsp.complex_conjugate(x, w), "mpy": dsp.complex_mpy(x, y, w),
        "real": dsp.complex_mpy_real(x, F.col("b"), w), "scale": dsp.complex_scale(x, 536870912, -536870912, w), "shift": dsp.complex_shift(x, 1, w),
    }
    return _exploded(_complex(spark, sf_dir, w), **_halves(parts))


@query
def dsp_complex_mac(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _complex(spark, sf_dir, dsp.Q15).select("vec_id", dsp.complex_mac(F.col("x"), F.col("y")).alias("s"))
    b = _complex(spark, sf_dir, dsp.IQ31).select("vec_id", dsp.complex_mac(F.col("x"), F.col("y"), dsp.IQ31).alias("l"))
    return a.join(b, "vec_id").select("vec_id", F.col("s.re").alias("re15"), F.col("s.im").alias("im15"), F.col("l.re").alias("re31"), F.col("l.im").alias("im31"))


@query
def dsp_matrix15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 matrices: the functions of one matrix."""
    m, row = _inputs(spark, sf_dir).select("vec_id", dsp.to_matrix(F.col("a"), 8).alias("a")), lambda f: F.flatten(dsp.each_row(F.col("a"), f))
    return _exploded(m, abs_q=row(lambda x: dsp.absolute(x)), offset_q=row(lambda x: dsp.offset(x, 20000)), scale_q=row(lambda x: dsp.scale(x, 16384, 2)), shift_q=row(lambda x: dsp.shift(x, 2)), back_q=row(lambda x: dsp.shift(x, -3)))


@query
def dsp_matrix31(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, flat = dsp.IQ31, F.flatten
    m, row = _inputs(spark, sf_dir, w).select("vec_id", dsp.to_matrix(F.col("a"), 8).alias("a"), dsp.to_matrix(F.col("b"), 8).alias("b")), lambda f: F.flatten(dsp.each_row(F.col("a"), f))
    return _exploded(
        m, abs_q=row(lambda x: dsp.absolute(x, w)), neg_q=row(lambda x: dsp.negate(x, w)), offset_q=row(lambda x: dsp.offset(x, 1500000000, w)), scale_q=row(lambda x: dsp.scale(x, 1073741824, 2, w)),
        shift_q=row(lambda x: dsp.shift(x, 2, w)), add_q=flat(dsp.matrix_zip(F.col("a"), F.col("b"), lambda x, y: dsp.add(x, y, w))), sub_q=flat(dsp.matrix_zip(F.col("a"), F.col("b"), lambda x, y: dsp.sub(x, y, w))),
        mpy_q=flat(dsp.matrix_mpy(F.col("a"), F.col("b"), w)), trans_q=flat(dsp.transpose(F.col("a"))),
    )


TAPS = [8192, 16384, 8192, -4096]


@query
def dsp_fir31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(_inputs(spark, sf_dir, dsp.IQ31), fir_q=dsp.fir(F.col("a"), [t << 16 for t in TAPS], dsp.IQ31))


def _complex_fir(spark: SparkSession, sf_dir: str, bits: int) -> DataFrame:
    taps = [(t << bits - 16, -u << bits - 16) for t, u in zip(TAPS, reversed(TAPS), strict=True)]
    return _exploded(_complex(spark, sf_dir, bits), **_halves({"fir": dsp.complex_fir(F.col("x"), taps, bits)}))


@query
def dsp_complex_fir15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _complex_fir(spark, sf_dir, dsp.Q15)


@query
def dsp_complex_fir31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _complex_fir(spark, sf_dir, dsp.IQ31)


@query
def dsp_utility31(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _complex(spark, sf_dir, dsp.IQ31).select("vec_id", "b", "x", F.transform("x", lambda z: z["re"]).alias("a"))
    inter, fill = dsp.interleave(F.col("a"), F.col("b")), dsp.complex_fill(5, -6, 64)
    return _exploded(
        p, inter_q=F.slice(inter, 1, 64), channel_q=dsp.deinterleave(inter, 1, 2), fill_q=dsp.fill(-2147483648, 64), **_halves({"fill": fill, "pair": F.col("x")}), sin_q=dsp.sinusoid(64, 0.1)
    )


#: Two stages of form 1, and of form 2 with its input gain and bias; the middle coefficients are halves.
DF1 = [((8192, 4096, 2048), (8192, -4096)), ((16384, 0, -8192), (4096, 2048))]
DF2 = [((8192, 4096, 2048), (16384, 8192, -4096), 300), ((16384, 0, -8192), (32767, 4096, 2048), -150)]


@query
def dsp_biquad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both forms and their cascades, over whole vectors."""
    return _exploded(
        _inputs(spark, sf_dir), df1_q=dsp.biquad_df1(F.col("a"), *DF1[0])["out"], df2_q=dsp.biquad_df2(F.col("a"), *DF2[0][:2])["out"], ext_q=dsp.biquad_df2(F.col("a"), *DF2[0])["out"],
        cascade1_q=dsp.biquad_cascade(F.col("a"), DF1, 1), cascade2_q=dsp.biquad_cascade(F.col("a"), [s[:2] for s in DF2], 2), cascade_ext_q=dsp.biquad_cascade(F.col("a"), DF2, 2),
    )


@query
def dsp_biquad_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States after a vector, least and greatest state of the extended form."""
    one, two = dsp.biquad_df1(F.col("a"), *DF1[0]), dsp.biquad_df2(F.col("a"), *DF2[0])
    p = _inputs(spark, sf_dir).select("vec_id", one.alias("f"), two.alias("g"))
    return p.select("vec_id", *[F.col(f"f.{k}").alias(k) for k in ("x1", "x2", "y1", "y2")], *[F.col(f"g.{k}").alias(k) for k in ("q1", "q2", "low", "high")])


@query
def dsp_fft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra in floating point, in hundredths (cut where sums of 64ths never lie), and what the inverse gives, rounded."""
    real = dsp.rfft(F.transform("a", lambda x: x.cast("double")))
    p = _inputs(spark, sf_dir).select("vec_id", "a", real.alias("f")).withColumn("back", dsp.irfft(F.col("f")))
    cents = lambda x: F.floor(x * 100 + 0.3).cast("bigint")
    z = p.select("vec_id", "a", "f", "back", F.explode(F.sequence(F.lit(0), F.lit(32))).alias("pos"))
    f = F.col("f")[F.col("pos")]
    return z.select("vec_id", "pos", cents(f["re"]).alias("re"), cents(f["im"]).alias("im"), F.floor(F.col("back")[F.col("pos")] + 0.5).cast("bigint").alias("back"))


def _spectrum(p: DataFrame) -> DataFrame:
    z = p.select("vec_id", F.col("f.shift").alias("shift"), F.posexplode(F.arrays_zip(F.col("f.re").alias("re"), F.col("f.im").alias("im"))).alias("pos", "z"))
    return z.select("vec_id", "pos", F.col("z.re").alias("re"), F.col("z.im").alias("im"), "shift")


def _transform(name: str, bits: int, **how: bool) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _spectrum(_complex(spark, sf_dir, bits).select("vec_id", dsp.fft_fixed(F.col("x"), bits, **how).alias("f")))

    run.__name__ = name
    query(run)


#: name, width, automatic scaling, inverse.
TRANSFORMS = [
    ("cfft_fixed15", 16, False, False), ("cfft_auto15", 16, True, False), ("cfft31", 32, False, False),
    ("cifft_fixed15", 16, False, True), ("cifft_auto15", 16, True, True), ("cifft31", 32, False, True),
]
for _name, _bits, _auto, _inverse in TRANSFORMS:
    _transform(_name, _bits, auto=_auto, inverse=_inverse)


@query
def rfft_fixed15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spectrum(_inputs(spark, sf_dir).select("vec_id", dsp.fft_real(F.col("a")).alias("f")))


@query
def rfft_auto15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spectrum(_inputs(spark, sf_dir).select("vec_id", dsp.fft_real(F.col("a"), auto=True).alias("f")))


@query
def rfft31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spectrum(_inputs(spark, sf_dir, dsp.IQ31).select("vec_id", dsp.fft_real(F.col("a"), dsp.IQ31).alias("f")))


def _half_transforms(name: str, bits: int, auto: bool) -> None:
    def forward(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _spectrum(_inputs(spark, sf_dir, bits).select("vec_id", dsp.fft_real_halves(F.col("a"), bits, auto).alias("f")))

    def back(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = _inputs(spark, sf_dir, bits).select("vec_id", dsp.fft_real_halves(F.col("a"), bits, auto).alias("f"))
        return f.select("vec_id", F.posexplode(dsp.ifft_real(F.col("f.re"), F.col("f.im"), F.col("f.shift"), bits, auto)).alias("pos", "value"))

    forward.__name__, back.__name__ = f"rfft_halves_{name}", f"irfft_{name}"
    query(forward)
    query(back)


#: Real transforms by a complex one of half the length and a split, and back.
for _name, _bits, _auto in (("fixed15", 16, False), ("auto15", 16, True), ("q31", 32, False)):
    _half_transforms(_name, _bits, _auto)


# -- checksums, cipher, files ------------------------------------------------------------------------------


@query
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", checksum.crc32(F.col("props")).alias("crc32"), checksum.crc16(F.col("props")).cast("bigint").alias("crc16"))


@query
def aes_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single blocks of 256-bit AES, without chaining: length and sameness of ciphertexts, and the text again."""
    e, key = spark.read.parquet(f"{sf_dir}/events.parquet"), F.lit("0123456789abcdef0123456789abcdef")
    c = e.select("event_id", "props", checksum.encrypt(F.col("props").cast("binary"), key, "ECB").alias("c"), checksum.encrypt(F.col("props").cast("binary"), key, "ECB").alias("d"))
    return c.select("event_id", F.octet_length("c").cast("bigint").alias("n"), (F.col("c") == F.col("d")).alias("same"), checksum.decrypt(F.col("c"), key, "ECB").cast("string").alias("props"))


@query
def file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted lines, written and read again."""
    at = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    write_lines(e, "%05d|%s|%d", [F.col("event_id"), F.col("event_type"), F.col("user_id")], at)
    return FileStore(spark).read_lines(at).select(F.col("value").alias("line"))


@query
def file_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What operations on small files give, in order."""
    fs, at = FileStore(spark), f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    made = fs.mkdirs(at) and fs.stat(at)["is_dir"]
    fs.write_text(f"{at}/a", "one\ntwo\n")
    fs.append_text(f"{at}/a", "three\n")
    steps = [("mkdir", made), ("write", fs.stat(f"{at}/a")["size"] == 14), ("forward", fs.read_bytes(f"{at}/a", 4, 3) == b"two"), ("rename", fs.rename(f"{at}/a", f"{at}/b")), ("list", fs.names(at) == ["b"])]
    fs.truncate(f"{at}/b", 4)
    steps += [("truncate", fs.read_bytes(f"{at}/b") == b"one\n"), ("unlink", fs.delete(f"{at}/b")), ("gone", not fs.exists(f"{at}/b"))]
    fs.delete(at)
    return spark.createDataFrame([(i, k, bool(v)) for i, (k, v) in enumerate(steps)], "step int, operation string, ok boolean")


# -- energy, arrivals, statistics --------------------------------------------------------------------------


@query
def gear_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return energy.with_gear(build.query_vectors(spark, sf_dir), "fixed", gear=4).select("query_id", "gear", "l_size", "m")


@query
def gear_power_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return energy.with_gear(build.query_vectors(spark, sf_dir), "power_event").select("query_id", "gear", "l_size", "m")


@query
def voltage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample with what it led to: the gear of its query, a wait for energy, or nothing yet."""
    log = energy.voltage_log(_samples(spark, sf_dir).select(F.col("event_id").alias("seq"), F.col("user_id").alias("query_id"), "raw", "voltage"))
    gears = _gear_queries(spark, sf_dir).select("query_id", "gear")
    return energy.tagged(log, gears).select("seq", "query_id", "raw", "voltage", "op")


@query
def arrival_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(build.query_vectors(spark, sf_dir), 4)


@query
def phase_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timers by kind of event: calls, total, least, greatest and mean, and each kind's share."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return stats.phases(e.select(F.col("event_type").alias("phase"), F.floor("value").cast("bigint").alias("elapsed")))
