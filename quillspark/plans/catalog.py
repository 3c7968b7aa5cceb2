"""Registry of the queries: a Spark callable each, and oracle SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import spread, tune
from ..sources.schemas import INPUTS


class Tables:
    """The given tables of one scale, read with their declared schemas."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    @property
    def texts(self) -> DataFrame:
        """``documents`` for work that is heavy per text: at least a split per core."""
        return spread(self.documents, "doc_id")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in INPUTS:
            raise AttributeError(name)
        return self.spark.read.schema(INPUTS[name]).parquet(f"{self.root}/{name}.parquet")


@dataclass(frozen=True)
class Entry:
    build: Callable[[Tables], DataFrame]
    sql: str | None


_ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``ctes`` name derived tables in ``sql``."""
    from .derived import with_ctes

    def register(fn):
        if name in _ENTRIES:
            raise ValueError(f"duplicate query {name}")
        _ENTRIES[name] = Entry(fn, None if sql is None else with_ctes(ctes, sql))
        return fn

    return register


def _load() -> None:
    from . import (  # noqa: F401
        aggregates, changes, chunk_retrieval, filters, functions, joins, knowledge, retrieval, scans,
        sessions, streams, summaries, topk)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, root, e=e: e.build(Tables(tune(spark), root)))
            for name, e in _ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: e.sql for name, e in _ENTRIES.items() if e.sql is not None}
