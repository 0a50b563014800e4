"""Positions: milliseconds in the high bits, 20 bits that keep equal times apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 20


def encode(millis: Column, *key: Column) -> Column:
    """``millis << 20`` plus 20 bits of a hash of ``key``, the same on every run; no key gives zero bits."""
    low = F.xxhash64(*key).bitwiseAND(F.lit((1 << BITS) - 1)) if key else F.lit(0)
    return F.shiftleft(millis.cast("long"), BITS) + low


def decode(position: Column) -> Column:
    """The milliseconds of a position."""
    return F.shiftright(position, BITS)
