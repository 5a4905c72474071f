"""Registry of queries: a builder over the input tables, and the SQL that must give the same rows."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from evalloom.operators.scale import spread


class Tables:
    """Input tables of one data folder, read lazily by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    @property
    def documents(self) -> DataFrame:
        return spread(self.spark.read.parquet(self.path("documents")), "doc_id")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))


@dataclass(frozen=True)
class Entry:
    build: Callable[[Tables], DataFrame]
    sql: str | None
    covers: tuple[str, ...]


CATALOG: dict[str, Entry] = {}

FAMILIES = (  # modules of this package, in inventory order
    "contamination",
    "corpus",
    "generators",
    "documents",
    "sampling",
    "requests",
    "filters",
    "likelihood",
    "textscores",
    "instructions",
    "aggregates",
    "rollups",
    "sinks",
    "streams",
)


def query(name: str, covers: str, sql: str | None = None):
    """Register ``build(tables)`` under ``name``; ``covers`` lists the inventory rows it implements."""

    def add(build):
        if name in CATALOG:
            raise ValueError(f"query {name} registered twice")
        CATALOG[name] = Entry(build, sql, tuple(covers.split()))
        return build

    return add


def load() -> dict[str, Entry]:
    for family in FAMILIES:
        if importlib.util.find_spec(f"evalloom.plans.{family}"):
            importlib.import_module(f"evalloom.plans.{family}")
    return CATALOG


def builders() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(entry: Entry):
        return lambda spark, folder: entry.build(Tables(spark, folder))

    return {name: bind(entry) for name, entry in load().items()}


def oracles() -> dict[str, str]:
    return {name: entry.sql for name, entry in load().items() if entry.sql}
