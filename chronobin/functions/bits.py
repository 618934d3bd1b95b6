"""Bit arrays in binary columns, most significant bit first; lengths are in bits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def pack(bits: str) -> bytes:
    """"0110" as bytes, the last one filled with zeros."""
    return np.packbits(np.frombuffer(bits.encode(), np.uint8) - 48).tobytes()


def unpack(data: bytes, length: int) -> str:
    return "".join(map(str, np.unpackbits(np.frombuffer(data, np.uint8))[:length]))


def get(data: bytes, index: int) -> bool:
    """Whether a bit is set; out of range it is not."""
    return 0 <= index < 8 * len(data) and bool(data[index >> 3] >> (7 - (index & 7)) & 1)


def _pair(op):
    @pandas_udf(T.BinaryType())
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else op(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)).tobytes() for x, y in zip(a, b, strict=True)])

    return f


def _same(op):
    def f(x, y):
        if len(x) != len(y):
            raise ValueError("bit arrays of different lengths")
        return op(x, y)

    return f


bit_and, bit_or, bit_xor = (_pair(_same(op)) for op in (np.bitwise_and, np.bitwise_or, np.bitwise_xor))
bit_xnor = _pair(_same(lambda x, y: ~(x ^ y)))


def bit_not(data: Column, length: Column) -> Column:
    """All bits up to length flipped; the filling stays zero."""

    @pandas_udf(T.BinaryType())
    def f(a: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else np.packbits(1 - np.unpackbits(np.frombuffer(x, np.uint8))[: int(k)]).tobytes() for x, k in zip(a, n, strict=True)])

    return f(data, length)


def to_string(data: Column) -> Column:
    """The bits as "0110...", the filling of the last byte included."""
    byte = lambda i: F.lpad(F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 2), 8, "0")
    return F.when(F.octet_length(data) == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.octet_length(data)), byte), ""))


def bit_at(data: Column, index: Column) -> Column:
    """Whether a bit is set; out of range it is not, of null it is null."""
    byte = F.conv(F.hex(F.substring(data, (F.shiftright(index, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    inside = (index >= 0) & (index < F.octet_length(data) * 8)
    return F.when(data.isNull(), None).otherwise(F.coalesce(inside & (F.pmod(F.floor(byte / F.pow(F.lit(2), 7 - F.pmod(index, F.lit(8)))), F.lit(2)) == 1), F.lit(False)))


def clear(data: Column) -> Column:
    """As many zero bytes."""
    return F.unhex(F.repeat(F.lit("00"), F.octet_length(data)))


def popcount(data: Column) -> Column:
    return F.bitmap_count(data)
