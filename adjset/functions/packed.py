"""Ids packed as little-endian bytes, for parity with wire formats."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def pack(values, width: int = 8) -> bytes:
    return np.asarray(values, dtype=f"<i{width}").tobytes()


def unpack(data: bytes, width: int = 8) -> list[int]:
    return np.frombuffer(data, dtype=f"<i{width}").tolist()


def pack_column(df: DataFrame, column: str, width: int = 8) -> DataFrame:
    """An array column to bytes; null stays null."""

    @F.pandas_udf("binary")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else pack(x, width))

    return df.withColumn(column, f(column))


def unpack_column(c: Column, width: int = 8) -> Column:
    """Bytes to an array, with built-in expressions: each byte-reversed piece read as a two's-complement number."""
    n = (F.length(c) / width).cast("int")

    def number(i: Column) -> Column:
        piece = F.reverse(F.transform(F.sequence(F.lit(1), F.lit(width)), lambda k: F.hex(F.substring(c, i * width + k, F.lit(1)))))
        high, low = (F.conv(F.array_join(p, ""), 16, 10).cast("long") for p in (F.slice(piece, 1, width // 2), F.slice(piece, width // 2 + 1, width // 2)))
        half = 4 * width
        signed = F.when(high >= F.lit(1 << (half - 1)), high - F.lit(1 << half)).otherwise(high)
        return F.shiftleft(signed, half) + low

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), number)).when(c.isNotNull(), F.array().cast("array<long>"))
