"""Catalogue of registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CATALOG: dict[str, tuple[Callable, str | None]] = {}


class Tables:
    """Lazy access to the parquet tables of one scale factor: ``t.lineitem`` and so on."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its SQL check."""

    def wrap(fn):
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = (fn, sql)
        return fn

    return wrap
