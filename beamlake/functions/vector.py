"""Integer vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from beamlake.config import SCALE


def quantize(v: Column, scale: int = SCALE) -> Column:
    """Nearest integers of scale * x, halves upwards."""
    return F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale)) + F.lit(0.5)).cast("int"))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("bigint") * y.cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def l2sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance as BIGINT."""
    d = F.zip_with(a, b, lambda x, y: x.cast("bigint") - y.cast("bigint"))
    return F.aggregate(d, F.lit(0).cast("bigint"), lambda s, x: s + x * x)


def adc_sum(table: Column, code: Column) -> Column:
    """Sum over subspaces of table[s][code[s]]."""
    return F.aggregate(F.sequence(F.lit(0), F.size(code) - 1), F.lit(0).cast("bigint"), lambda a, s: a + table[s][code[s].cast("int")])


def address(block: Column, page: Column, offset: Column, kind: Column) -> Column:
    """A packed 32-bit address: 5 bits kind, 10 bits block, 6 bits page, 11 bits offset."""
    b = lambda c, n: F.shiftleft(c.cast("bigint"), n)
    return b(kind, 27).bitwiseOR(b(block, 17)).bitwiseOR(b(page, 11)).bitwiseOR(offset.cast("bigint"))


def address_parts(a: Column) -> dict[str, Column]:
    cut = lambda low, bits: F.shiftright(a.cast("bigint"), low).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    return {"addr_offset": cut(0, 11), "addr_page": cut(11, 6), "addr_block": cut(17, 10), "addr_type": cut(27, 5)}
