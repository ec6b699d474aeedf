"""Registry of runnable plans: name, builder and the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.session import folder_bytes, size_shuffles, tune

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


_sizes: dict[str, int] = {}


def _size_of(spark: SparkSession, folder: str) -> int:
    if folder not in _sizes:
        _sizes[folder] = folder_bytes(spark, folder)
    return _sizes[folder]


class Tables:
    """Lazy access to the Parquet tables of one data folder: ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))


def plan(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``, with its SQL twin if one exists."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"plan {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            folder = str(sf_dir).rstrip("/")
            size_shuffles(tune(spark), _size_of(spark, folder))
            return fn(Tables(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
