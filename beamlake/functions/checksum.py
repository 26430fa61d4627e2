"""Checksums and ciphers of the platform, as expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def crc32(data: Column) -> Column:
    return F.crc32(data.cast("binary"))


def crc16(data: Column, seed: int = 0xFFFF) -> Column:
    """CRC-16 with polynomial 0x1021, most significant bit first, in arithmetic on bytes."""
    octets = F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.conv(F.hex(F.substring(data.cast("binary"), i, F.lit(1))), 16, 10).cast("int"))

    def step(c: Column, b: Column) -> Column:
        x = F.shiftright(c, 8).bitwiseXOR(b)
        x = x.bitwiseXOR(F.shiftright(x, 4))
        y = F.shiftleft(c, 8).bitwiseXOR(F.shiftleft(x, 12)).bitwiseXOR(F.shiftleft(x, 5)).bitwiseXOR(x)
        return y.bitwiseAND(F.lit(0xFFFF))

    return F.when(F.octet_length(data) == 0, F.lit(seed)).otherwise(F.aggregate(octets, F.lit(seed), step))


def crc16_arrow(data: Column) -> Column:
    """The same for long inputs, a batch at a time."""
    import binascii

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if v is None else binascii.crc_hqx(bytes(v), 0xFFFF) for v in s], dtype="Int32")

    return run(data.cast("binary"))


def encrypt(data: Column, key: Column, mode: str = "GCM") -> Column:
    """AES with a key of 128, 192 or 256 bits. ECB is the platform's single blocks; GCM also proves that a text is unchanged."""
    return F.aes_encrypt(data, key, F.lit(mode))


def decrypt(data: Column, key: Column, mode: str = "GCM") -> Column:
    return F.aes_decrypt(data, key, F.lit(mode))
