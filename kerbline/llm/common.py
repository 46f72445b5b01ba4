"""Helpers that several operators share: column packing, ASCII case, word patterns, grouped streams of Arrow rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.storage import materialise, new_folder, shared_folder  # noqa: F401

#: White space of the contracts, as characters and as a class of what lies between.
SPACE = "\t\n\x0b\x0c\r "
NOT_SPACE = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A table of at most this many rows of a few numbers each may be broadcast.
BROADCAST_ROWS = 500_000


def pack(df: DataFrame, added: Sequence[str], **named: str) -> DataFrame:
    """The columns an operator works on under names of its own, and all others, but those it adds, as one struct ``_row``.

    So no column of the input, whatever its name, can collide with a working column; an input column named like an added
    one, in capitals or not, gives way to it.
    """
    gone = {a.lower() for a in added}
    rest = [c for c in df.columns if c.lower() not in gone]
    return df.select(F.struct(*[df[f"`{c}`"] for c in rest]).alias("_row"), *[df[f"`{c}`"].alias(k) for k, c in named.items()])


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a table whose counted rows are within the limit; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if rows <= limit else df


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; the translation is only needed where other letters occur."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def name128(text: Column) -> Column:
    """Two independent 64-bit hashes of a string: equal names stand for equal strings."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"))


def spread(spark: SparkSession, least: int = 1) -> int:
    """Number of partitions of an explicit exchange."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def runs(batches: Iterable, key: Sequence[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of Arrow batches, sorted by key, as (key, rows) one group at a time, also across batches."""
    at, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            now = tuple(row[k] for k in key)
            if now != at:
                if held:
                    yield at, held
                at, held = now, []
            held.append(row)
    if held:
        yield at, held
