"""Repeatable draws: a row's key and a salt give the same numbers on any cluster."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 1 << 32


def draw(key: Column, salt: str) -> Column:
    """A whole number from 0 to 2^32 - 1, from the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{salt}"))), 1, 8), 16, 10).cast("long")


def uniform(key: Column, salt: str) -> Column:
    """A number from 0 to below 1."""
    return draw(key, salt) / F.lit(float(SPAN))


def randint(key: Column, salt: str, low: Column, high: Column) -> Column:
    """A whole number from low to high, both included."""
    return low + F.pmod(draw(key, salt), high - low + 1)
