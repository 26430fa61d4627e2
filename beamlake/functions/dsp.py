"""Fixed-point vector functions on array columns. q15: 16 bits, iq31: 32 bits; both as BIGINT inside.

Where `bits` is asked for, results saturate at that width; `wrap` keeps the low bits instead.
Complex vectors are arrays of struct(re, im); matrices are arrays of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Q15, IQ31 = 16, 32
CPLX = "array<struct<re:bigint,im:bigint>>"


def _l(x: Column) -> Column:
    return x.cast("bigint")


def clamp(x: Column, bits: int) -> Column:
    hi = (1 << (bits - 1)) - 1
    return F.greatest(F.lit(-hi - 1).cast("bigint"), F.least(F.lit(hi).cast("bigint"), x))


def wrap(x: Column, bits: int) -> Column:
    """The low bits, as a signed number."""
    half = 1 << (bits - 1)
    return F.pmod(x + F.lit(half), F.lit(1 << bits)) - F.lit(half)


def add(a: Column, b: Column, bits: int = Q15) -> Column:
    return F.zip_with(a, b, lambda x, y: clamp(_l(x) + _l(y), bits))


def sub(a: Column, b: Column, bits: int = Q15) -> Column:
    return F.zip_with(a, b, lambda x, y: clamp(_l(x) - _l(y), bits))


def mpy(a: Column, b: Column, bits: int = Q15) -> Column:
    """Fractional product: the upper bits of x * y. Only -1 times -1 leaves the width, and wraps."""
    return F.zip_with(a, b, lambda x, y: wrap(F.shiftright(_l(x) * _l(y), bits - 1), bits))


def mac(a: Column, b: Column, bits: int = Q15) -> Column:
    """Dot product; 16-bit inputs are summed and doubled, 32-bit products are cut to their upper bits first."""
    p = F.zip_with(a, b, lambda x, y: _l(x) * _l(y) if bits == Q15 else F.shiftright(_l(x) * _l(y), 31))
    s = F.aggregate(p, F.lit(0).cast("bigint"), lambda t, x: t + x)
    return s * 2 if bits == Q15 else s


def absolute(a: Column, bits: int = Q15) -> Column:
    """The least number of the width has no counterpart and becomes the greatest."""
    return F.transform(a, lambda x: clamp(F.abs(_l(x)), bits))


def negate(a: Column, bits: int = Q15) -> Column:
    return F.transform(a, lambda x: clamp(-_l(x), bits))


def offset(a: Column, c: int, bits: int = Q15) -> Column:
    return F.transform(a, lambda x: clamp(_l(x) + F.lit(c), bits))


def scale(a: Column, factor: int, shift: int, bits: int = Q15) -> Column:
    return F.transform(a, lambda x: wrap(F.shiftright(_l(x) * F.lit(factor), bits - 1 - shift), bits))


def shift(a: Column, k: int, bits: int = Q15) -> Column:
    return F.transform(a, lambda x: clamp(F.shiftleft(_l(x), k), bits) if k >= 0 else F.shiftright(_l(x), -k))


def maximum(a: Column) -> tuple[Column, Column]:
    """Largest value and its place, the last on ties."""
    top = F.array_max(a)
    return top, F.size(a) - F.array_position(F.reverse(a), top)


def minimum(a: Column) -> tuple[Column, Column]:
    top = F.array_min(a)
    return top, F.size(a) - F.array_position(F.reverse(a), top)


def unsigned(a: Column, bits: int = Q15) -> Column:
    return F.transform(a, lambda x: F.pmod(_l(x), F.lit(1 << bits)))


def fill(value: int, n: int) -> Column:
    return F.array_repeat(F.lit(value).cast("bigint"), n)


def interleave(*channels: Column) -> Column:
    """Elements of the channels in turn."""
    zipped = F.arrays_zip(*[c.alias(f"c{i}") for i, c in enumerate(channels)])
    return F.flatten(F.transform(zipped, lambda z: F.array(*[_l(z[f"c{i}"]) for i in range(len(channels))])))


def deinterleave(a: Column, channel: int, channels: int) -> Column:
    return F.filter(a, lambda x, i: i % channels == channel)


def q15_to_iq31(a: Column) -> Column:
    return F.transform(a, lambda x: F.shiftleft(_l(x), 16))


def iq31_to_q15(a: Column) -> Column:
    return F.transform(a, lambda x: F.shiftright(_l(x), 16))


def sinusoid(n: int, step: float, amplitude: int = 32767) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(F.lit(float(amplitude)) * F.sin(i * F.lit(step)) + 0.5).cast("bigint"))


def complex_vector(re: Column, im: Column) -> Column:
    return F.zip_with(re, im, lambda x, y: F.struct(_l(x).alias("re"), _l(y).alias("im")))


def _z(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def complex_add(a: Column, b: Column, bits: int = Q15) -> Column:
    return F.zip_with(a, b, lambda x, y: _z(clamp(x["re"] + y["re"], bits), clamp(x["im"] + y["im"], bits)))


def complex_sub(a: Column, b: Column, bits: int = Q15) -> Column:
    return F.zip_with(a, b, lambda x, y: _z(clamp(x["re"] - y["re"], bits), clamp(x["im"] - y["im"], bits)))


def complex_conjugate(a: Column, bits: int = Q15) -> Column:
    return F.transform(a, lambda x: _z(x["re"], clamp(-x["im"], bits)))


def complex_mpy(a: Column, b: Column, bits: int = Q15) -> Column:
    cut = lambda v: wrap(F.shiftright(v, bits - 1), bits)
    return F.zip_with(a, b, lambda x, y: _z(cut(x["re"] * y["re"] - x["im"] * y["im"]), cut(x["re"] * y["im"] + x["im"] * y["re"])))


def complex_mpy_real(a: Column, b: Column, bits: int = Q15) -> Column:
    cut = lambda v: wrap(F.shiftright(v, bits - 1), bits)
    return F.zip_with(a, b, lambda x, y: _z(cut(x["re"] * _l(y)), cut(x["im"] * _l(y))))


def complex_mac(a: Column, b: Column, bits: int = Q15) -> Column:
    """Sum of products; 32-bit products are cut to their upper bits first, as mac does."""
    cut = lambda v: v if bits == Q15 else F.shiftright(v, 31)
    zero = _z(F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))
    p = F.zip_with(a, b, lambda x, y: _z(cut(x["re"] * y["re"]) - cut(x["im"] * y["im"]), cut(x["re"] * y["im"]) + cut(x["im"] * y["re"])))
    return F.aggregate(p, zero, lambda s, x: _z(s["re"] + x["re"], s["im"] + x["im"]))


def complex_scale(a: Column, re: int, im: int, bits: int = Q15) -> Column:
    cut = lambda v: wrap(F.shiftright(v, bits - 1), bits)
    return F.transform(a, lambda x: _z(cut(x["re"] * F.lit(re) - x["im"] * F.lit(im)), cut(x["re"] * F.lit(im) + x["im"] * F.lit(re))))


def complex_shift(a: Column, k: int, bits: int = Q15) -> Column:
    one = lambda v: clamp(F.shiftleft(v, k), bits) if k >= 0 else F.shiftright(v, -k)
    return F.transform(a, lambda x: _z(one(x["re"]), one(x["im"])))


def complex_fill(re: int, im: int, n: int) -> Column:
    return F.array_repeat(_z(F.lit(re).cast("bigint"), F.lit(im).cast("bigint")), n)


def to_matrix(a: Column, columns: int) -> Column:
    """Rows of a flat vector."""
    n = (F.size(a) / columns).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(a, i * columns + 1, columns))


def each_row(m: Column, f) -> Column:
    """A vector function on every row: absolute, negate, offset, scale or shift of a matrix."""
    return F.transform(m, f)


def matrix_zip(a: Column, b: Column, f) -> Column:
    """A function of two vectors on every pair of rows: add or sub of matrices."""
    return F.zip_with(a, b, f)


def transpose(m: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(m[0]) - 1), lambda j: F.transform(m, lambda r: r[j]))


def matrix_mpy(a: Column, b: Column, bits: int = Q15) -> Column:
    """Matrix product; each sum of products is cut to its upper bits, 32-bit products before they are summed."""
    cut = lambda v: F.shiftright(v, 31) if bits == IQ31 else v
    total = lambda r, c: F.aggregate(F.zip_with(r, c, lambda x, y: cut(_l(x) * _l(y))), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return F.transform(a, lambda r: F.transform(transpose(b), lambda c: wrap(total(r, c) if bits == IQ31 else F.shiftright(total(r, c), bits - 1), bits)))


def fir(a: Column, taps: list[int], bits: int = Q15) -> Column:
    """y[i] = sum of taps[k] * a[i - k], cut to the upper bits (32-bit products before they are summed); places before the first count as 0."""
    cut = (lambda v: F.shiftright(v, 31)) if bits == IQ31 else (lambda v: v)
    end = 0 if bits == IQ31 else bits - 1
    t = F.array(*[F.lit(x).cast("bigint") for x in taps])

    def one(i: Column) -> Column:
        p = F.transform(F.sequence(F.lit(0), F.lit(len(taps) - 1)), lambda k: F.when(i >= k, cut(_l(F.element_at(a, F.greatest(i - k, F.lit(0)) + 1)) * t[k])).otherwise(F.lit(0).cast("bigint")))
        return clamp(F.shiftright(F.aggregate(p, F.lit(0).cast("bigint"), lambda s, x: s + x), end), bits)

    return F.transform(F.sequence(F.lit(0), F.size(a) - 1), one)


def complex_fir(a: Column, taps: list[tuple[int, int]], bits: int = Q15) -> Column:
    cut = (lambda v: F.shiftright(v, 31)) if bits == IQ31 else (lambda v: v)
    end = 0 if bits == IQ31 else bits - 1
    t = F.array(*[_z(F.lit(r).cast("bigint"), F.lit(i).cast("bigint")) for r, i in taps])
    zero = F.lit(0).cast("bigint")
    plus = lambda p: F.aggregate(p, zero, lambda s, x: s + x)

    def one(i: Column) -> Column:
        ks = F.sequence(F.lit(0), F.lit(len(taps) - 1))
        at = lambda v, k: F.when(i >= k, F.element_at(a, F.greatest(i - k, F.lit(0)) + 1)[v]).otherwise(zero)
        real = plus(F.transform(ks, lambda k: cut(at("re", k) * t[k]["re"]) - cut(at("im", k) * t[k]["im"])))
        imag = plus(F.transform(ks, lambda k: cut(at("re", k) * t[k]["im"]) + cut(at("im", k) * t[k]["re"])))
        return _z(clamp(F.shiftright(real, end), bits), clamp(F.shiftright(imag, end), bits))

    return F.transform(F.sequence(F.lit(0), F.size(a) - 1), one)


def biquad_df1(a: Column, b: tuple[int, int, int], c: tuple[int, int], state: tuple[int, int, int, int] = (0, 0, 0, 0)) -> Column:
    """Direct form 1 on q15: y = b0 x + 2 b1 x' + b2 x'' + 2 c1 y' + c2 y'', saturated. b1 and c1 are halves, so they may stand for
    coefficients up to 2; each product is cut to its upper bits. struct(out, x1, x2, y1, y2): the state goes into the next call."""
    part = lambda x, k: F.shiftright(x * F.lit(k), Q15 - 1)
    zero = F.struct(F.array().cast("array<bigint>").alias("out"), *[F.lit(v).cast("bigint").alias(k) for k, v in zip(("x1", "x2", "y1", "y2"), state, strict=True)])

    def step(s: Column, x: Column) -> Column:
        x = _l(x)
        y = clamp(part(x, b[0]) + 2 * part(s["x1"], b[1]) + part(s["x2"], b[2]) + 2 * part(s["y1"], c[0]) + part(s["y2"], c[1]), Q15)
        return F.struct(F.concat(s["out"], F.array(y)).alias("out"), x.alias("x1"), s["x1"].alias("x2"), y.alias("y1"), s["y1"].alias("y2"))

    return F.aggregate(a, zero, step)


def biquad_df2(a: Column, b: tuple[int, int, int], c: tuple[int, int, int], bias: int = 0, state: tuple[int, int] = (0, 0)) -> Column:
    """Direct form 2 on q15: w = bias + a0 x + 2 a1 w' + a2 w'', y = b0 w + 2 b1 w' + b2 w'', both saturated; c is (a0, a1, a2), a1
    and b1 are halves. struct(out, q1, q2, low, high): the state for the next call, and the extended form's least and greatest w."""
    part = lambda x, k: F.shiftright(x * F.lit(k), Q15 - 1)
    first = {"q1": state[0], "q2": state[1], "low": (1 << 15) - 1, "high": -(1 << 15)}
    zero = F.struct(F.array().cast("array<bigint>").alias("out"), *[F.lit(v).cast("bigint").alias(k) for k, v in first.items()])

    def step(s: Column, x: Column) -> Column:
        w = clamp(F.lit(bias).cast("bigint") + part(_l(x), c[0]) + 2 * part(s["q1"], c[1]) + part(s["q2"], c[2]), Q15)
        y = clamp(part(w, b[0]) + 2 * part(s["q1"], b[1]) + part(s["q2"], b[2]), Q15)
        return F.struct(F.concat(s["out"], F.array(y)).alias("out"), w.alias("q1"), s["q1"].alias("q2"), F.least(s["low"], w).alias("low"), F.greatest(s["high"], w).alias("high"))

    return F.aggregate(a, zero, step)


def biquad_cascade(a: Column, stages: list[tuple], form: int = 1) -> Column:
    """Output of stages one after the other: (b, c) of form 1, (b, c) or (b, c, bias) of form 2."""
    for stage in stages:
        a = (biquad_df1 if form == 1 else biquad_df2)(a, *stage)["out"]
    return a


# -- Fourier transforms: fixed point, and in floating point ------------------------------------------------


def twiddles(half: int, bits: int = Q15, inverse: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """cos and -sin (sin for the inverse) of k * pi / half, rounded to the width."""
    one, angle = 1 << (bits - 1), np.pi * np.arange(half) / half
    cut = lambda x: np.clip(np.floor(one * x + 0.5), -one, one - 1).astype(np.int64)
    return cut(np.cos(angle)), cut(np.sin(angle) if inverse else -np.sin(angle))


def fft_rows(re: np.ndarray, im: np.ndarray, bits: int = Q15, auto: bool = False, inverse: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Radix-2 transforms of all rows at once, in whole numbers, and each row's number of halvings.

    Every stage halves, or, with auto, only where a component left the middle half of the width in the stage before. The first two
    stages multiply by 1 and -i (i for the inverse) exactly; later ones by rounded factors, products cut to their upper bits."""
    n = re.shape[1]
    if n & (n - 1) or not n:
        raise ValueError("the length must be a power of two")
    place = np.zeros(n, dtype=np.int64)
    for i in range(1, n):
        place[i] = place[i >> 1] >> 1 | (n >> 1 if i & 1 else 0)
    re, im = re[:, place].astype(np.int64), im[:, place].astype(np.int64)
    edge, count = 1 << (bits - 2), np.zeros(len(re), dtype=np.int64)
    wide = lambda: ((re >= edge) | (re < -edge) | (im >= edge) | (im < -edge)).any(axis=1)
    half = 1
    while half < n:
        halve = wide() if auto else np.ones(len(re), dtype=bool)
        count += halve
        a_re, a_im, b_re, b_im = (x.reshape(len(re), -1, 2 * half)[:, :, k * half : (k + 1) * half] for k in (0, 1) for x in (re, im))
        if half <= 2:
            sign = 1 if inverse else -1
            t_re, t_im = b_re.copy(), b_im.copy()
            if half == 2:
                t_re[:, :, 1], t_im[:, :, 1] = -sign * b_im[:, :, 1], sign * b_re[:, :, 1]
        else:
            w_re, w_im = twiddles(half, bits, inverse)
            t_re, t_im = (b_re * w_re >> bits - 1) - (b_im * w_im >> bits - 1), (b_re * w_im >> bits - 1) + (b_im * w_re >> bits - 1)
        down = halve.astype(np.int64)[:, None, None]
        re = np.concatenate([a_re + t_re >> down, a_re - t_re >> down], axis=2).reshape(len(re), n)
        im = np.concatenate([a_im + t_im >> down, a_im - t_im >> down], axis=2).reshape(len(im), n)
        half *= 2
    return re, im, count


def fft_fixed(a: Column, bits: int = Q15, auto: bool = False, inverse: bool = False) -> Column:
    """struct(re, im, shift) of the transform of complex vectors; rows of one length go through it together."""
    kind = T.StructType([T.StructField("re", T.ArrayType(T.LongType())), T.StructField("im", T.ArrayType(T.LongType())), T.StructField("shift", T.IntegerType())])

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            out: list = [(None, None, None)] * len(d)
            by: dict[int, list[int]] = {}
            for i, v in enumerate(d["re"]):
                if v is not None:
                    by.setdefault(len(v), []).append(i)
            for rows in by.values():
                got = fft_rows(np.stack(d["re"].to_numpy()[rows]), np.stack(d["im"].to_numpy()[rows]), bits, auto, inverse)
                for i, x, y, k in zip(rows, *got, strict=True):
                    out[i] = (x, y, int(k))
            yield pd.DataFrame(out, columns=["re", "im", "shift"])

    return run(F.struct(F.transform(a, lambda x: _l(x["re"])).alias("re"), F.transform(a, lambda x: _l(x["im"])).alias("im")))


def fft_real(a: Column, bits: int = Q15, auto: bool = False) -> Column:
    """fft_fixed of real vectors."""
    return fft_fixed(F.transform(a, lambda x: _z(_l(x), F.lit(0).cast("bigint"))), bits, auto)


def _wrapped(x: np.ndarray, bits: int) -> np.ndarray:
    h = 1 << (bits - 1)
    return (x + h) % (1 << bits) - h


def split_rows(re: np.ndarray, im: np.ndarray, bits: int = Q15) -> tuple[np.ndarray, np.ndarray]:
    """The last stage of a real transform of twice the length: its bins from those of its even and odd places as one complex vector.

    Bin k and its mirror come from their half sum and half difference, the latter turned by a factor of 16 bits. The narrow form halves as it
    goes; the wide one keeps twice the scale, in the first and the middle bin as well."""
    n = re.shape[1]
    out_re, out_im = np.empty_like(re), np.zeros_like(im)
    wide = bits != Q15
    out_re[:, 0] = (re[:, 0] + im[:, 0]) * (2 if wide else 1)
    k = np.arange(1, n // 2)
    m = n - k
    c, d = (w[k] >> (0 if wide else 1) for w in twiddles(n, Q15))
    b_re, b_im = _wrapped(re[:, k] - re[:, m], bits), _wrapped(im[:, k] + im[:, m], bits)
    t_re, t_im = (b_re * c >> Q15 - 1) - (b_im * d >> Q15 - 1), (b_re * d >> Q15 - 1) + (b_im * c >> Q15 - 1)
    a_re, a_im = (x >> (0 if wide else 1) for x in (re[:, k] + re[:, m], im[:, k] - im[:, m]))
    out_re[:, k], out_im[:, k], out_re[:, m], out_im[:, m] = a_re + t_im, a_im - t_re, a_re - t_im, -(a_im + t_re)
    if n > 1:
        out_re[:, n // 2], out_im[:, n // 2] = (x[:, n // 2] * (2 if wide else 1) for x in (re, -im))
    return _wrapped(out_re, bits), _wrapped(out_im, bits)


def rfft_rows(x: np.ndarray, bits: int = Q15, auto: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half as many bins as the real rows have places, by a complex transform of half the length and a split; and each row's halvings."""
    re, im, count = fft_rows(x[:, ::2], x[:, 1::2], bits, auto)
    return *split_rows(re, im, bits), count


def _shifted(x: np.ndarray, by: np.ndarray, bits: int) -> np.ndarray:
    """Rows times two to the power `by`, to the left with saturation."""
    h = 1 << (bits - 1)
    up, down = np.maximum(by, 0)[:, None], np.maximum(-by, 0)[:, None]
    return np.clip(x << up, -h, h - 1) >> down


def irfft_rows(re: np.ndarray, im: np.ndarray, shift: np.ndarray, bits: int = Q15, auto: bool = False) -> np.ndarray:
    """The real rows of bins that rfft_rows gives, but for the mean of the odd places, which these bins hold with that of the even ones: it comes back
    on the even places. shift: the bins' halvings, which count with auto only.

    The conjugate is split and transformed forwards; the narrow form halves only where it must and shifts that back. The wide one first uses the
    bits that the bins leave free, but for two that the split needs, and gives the rows times 8 over their length."""
    n, h = re.shape[1], 1 << (bits - 1)
    low = np.minimum(np.minimum(re, im).min(axis=1), -np.maximum(re, im).max(axis=1))
    free = np.zeros(len(re), dtype=np.int64)
    if bits != Q15:
        small = (low > -h // 8) & (low < 0)
        while small.any():  # a row of zeros has nothing to scale
            free += small
            small = (low < 0) & (low << free > -h // 8)
    re, im = split_rows(_shifted(re, free, bits), _shifted(_wrapped(-im, bits), free, bits), bits)
    re, im, count = fft_rows(re, im, bits, bits == Q15)
    back = -free if bits != Q15 else count + (shift - int(np.log2(n)) if auto else 0)
    out = np.empty((len(re), 2 * n), dtype=np.int64)
    out[:, ::2], out[:, 1::2] = _shifted(re, back, bits), _wrapped(-_shifted(im, back, bits), bits)
    return out


def _by_length(columns: dict[str, Column], kind: T.StructType, f) -> Column:
    """f of matrices (or vectors) of rows of one length, once for each length in a batch; nulls where the first column is null or empty."""
    names = kind.names

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            out: list = [None] * len(d)
            by: dict[int, list[int]] = {}
            for i, v in enumerate(d.iloc[:, 0]):
                if v is not None:
                    by.setdefault(len(v), []).append(i)
            for n, rows in by.items():
                if n:
                    cols = [np.stack(d[c].to_numpy()[rows]).astype(np.int64) for c in d]
                    for i, x in zip(rows, f(*cols), strict=True):
                        out[i] = x
            yield pd.DataFrame([x or (None,) * len(names) for x in out], columns=names)

    return run(F.struct(*[c.alias(k) for k, c in columns.items()]))


def fft_real_halves(a: Column, bits: int = Q15, auto: bool = False) -> Column:
    """struct(re, im, shift) of rfft_rows of real vectors, whose length is a power of two."""
    kind = T.StructType([T.StructField("re", T.ArrayType(T.LongType())), T.StructField("im", T.ArrayType(T.LongType())), T.StructField("shift", T.IntegerType())])
    return _by_length({"a": F.transform(a, _l)}, kind, lambda x: [(p, q, int(k)) for p, q, k in zip(*rfft_rows(x, bits, auto), strict=True)])


def ifft_real(re: Column, im: Column, shift: Column, bits: int = Q15, auto: bool = False) -> Column:
    """irfft_rows of a spectrum, as a real vector."""
    both = {"re": F.transform(re, _l), "im": F.transform(im, _l), "shift": shift.cast("bigint")}
    kind = T.StructType([T.StructField("value", T.ArrayType(T.LongType()))])
    return _by_length(both, kind, lambda p, q, k: [(x,) for x in irfft_rows(p, q, k, bits, auto)])["value"]


def _batched(f, kind: str) -> Column:
    """A function of a matrix of rows as an Arrow UDF, once for each length in a batch; made on use, as that needs a session."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out: list = [None] * len(s)
            by: dict[int, list[int]] = {}
            for i, v in enumerate(s):
                if v is not None:
                    by.setdefault(len(v), []).append(i)
            for rows in by.values():
                for i, x in zip(rows, f([s.iloc[k] for k in rows]), strict=True):
                    out[i] = x
            yield pd.Series(out)

    return run


_COMPLEX = "array<struct<re:double,im:double>>"


def _pairs(m: np.ndarray) -> list[list[dict[str, float]]]:
    return [[{"re": x.real, "im": x.imag} for x in z] for z in m]


def _numbers(rows: list) -> np.ndarray:
    return np.array([[complex(x["re"], x["im"]) for x in v] for v in rows])


def rfft(a: Column) -> Column:
    """Real Fourier transform, divided by its length (one bit per stage)."""
    return _batched(lambda rows: _pairs(np.fft.rfft(np.array([np.asarray(v, float) for v in rows])) / max(1, len(rows[0]))), _COMPLEX)(a)


def irfft(a: Column) -> Column:
    """Inverse of rfft for vectors of even length."""

    def back(rows: list) -> list:
        n = 2 * (len(rows[0]) - 1)
        return (np.fft.irfft(_numbers(rows), n) * n).tolist()

    return _batched(back, "array<double>")(a)


def cfft(a: Column) -> Column:
    """Complex Fourier transform, divided by its length."""
    return _batched(lambda rows: _pairs(np.fft.fft(_numbers(rows)) / max(1, len(rows[0]))), _COMPLEX)(a)


def cifft(a: Column) -> Column:
    """Inverse of cfft."""
    return _batched(lambda rows: _pairs(np.fft.ifft(_numbers(rows)) * len(rows[0])), _COMPLEX)(a)
