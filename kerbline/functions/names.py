"""What a file name or path says: photo identity, pairing key, origin, split, title."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the export suffix an augmentation tool appends, and the recognised split folders
AUGMENTATION_SUFFIX = r"(?i)_(jpe?g|png|bmp)\.rf\.[0-9a-f]+$"
SPLIT_FOLDERS = ("train", "valid", "val", "test")


def base_name(path: Column) -> Column:
    """Last path part."""
    return F.substring_index(path, "/", -1)


def drop_extension(name: Column) -> Column:
    """Name without its last extension; a leading dot does not start one."""
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def source_stem(path: Column) -> Column:
    """Identity of the photograph: all augmented copies of one photo share it."""
    return F.regexp_replace(drop_extension(base_name(path)), AUGMENTATION_SUFFIX, "")


def timestamp_key(path: Column) -> Column:
    """``YYYYMMDD_HHMMSS`` prefix that pairs a photo with its depth and label files, or null."""
    return F.nullif(F.regexp_extract(base_name(path), r"^(\d{8}_\d{6})", 1), F.lit(""))


def parse_key_ts(key: Column) -> Column:
    """Capture time written in a pairing key."""
    return F.to_timestamp_ntz(F.substring(key, 1, 15), F.lit("yyyyMMdd_HHmmss"))


def from_prefix(name: Column, prefixes: Sequence[tuple[str, str]], default: str) -> Column:
    """Value of the first matching prefix, in the given order."""
    out = None
    for prefix, value in prefixes:
        hit = name.startswith(prefix)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


def split_of(path: Column) -> Column:
    """First path part that names a split, else ``-``."""
    return F.coalesce(F.get(F.filter(F.split(path, "/"), lambda p: p.isin(*SPLIT_FOLDERS)), 0), F.lit("-"))


def title_of(file: Column) -> Column:
    """Display title: extension dropped, underscores to blanks, words capitalised."""
    return F.initcap(F.replace(drop_extension(file), F.lit("_"), F.lit(" ")))


def has_item(delimited: Column, item: str, sep: str = ";") -> Column:
    """Whether a delimited list holds an item."""
    return F.array_contains(F.split(delimited, sep), item)
