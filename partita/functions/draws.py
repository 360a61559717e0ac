"""Seeded draws from keys: the same on any partitioning, and in any engine that has MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed(*parts: Column) -> Column:
    """A whole number under 2^40: the first ten hexadecimal digits of the MD5 of the parts, joined by slashes."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *[p.cast("string") for p in parts])), 1, 10), 16, 10).cast("long")


def draw(key: Column, seed: int = 42) -> Column:
    """A number in [0, 1) from a key."""
    return hashed(key, F.lit(seed)) / float(1 << 40)
