"""Hash-ordered draws: a seeded md5 stands in for a random permutation, so a rerun,
another cluster or another engine gives the same order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed, *keys) -> Column:
    """Sort key of a seeded shuffle."""
    parts = [F.lit(str(seed))] if not isinstance(seed, Column) else [seed.cast("string")]
    parts += [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def unit_draw(key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of an md5 string."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_chunk(key: Column, digits: int = 3) -> Column:
    """Leading hex digits of an md5: 16**digits equal slices that follow the key's order."""
    return F.substring(key, 1, digits)
