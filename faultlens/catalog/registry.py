"""Registry of named queries and their reference SQL."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from faultlens.catalog.views import TABLES, VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Data:
    """Lazy access to the tables and derived views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            if name in TABLES:
                self._cache[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                self._cache[name] = self.sql(VIEWS[name])
        return self._cache[name]

    def spread(self, df: DataFrame) -> DataFrame:
        """Rows dealt out evenly before work that is heavy for its bytes: dozens of regular expressions a text."""
        return df.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    def gathered(self, df: DataFrame, key: str):
        """``df`` grouped by a key of bounded groups, on a fixed number of partitions.

        The text work after it is heavy for its bytes; an explicit count keeps adaptive coalescing from merging a few
        megabytes into one task, and the grouping reuses the partitioning.
        """
        return df.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), key).groupBy(key)

    def sql(self, text: str) -> DataFrame:
        """A query whose ``{name}`` references are tables or views of this folder."""
        return self.spark.sql(text, **{name: getattr(self, name) for name in _references(text)})


# ``{name}`` is a table or view; ``{{`` and ``}}`` are literal braces.
_REFERENCE = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def _references(text: str) -> list[str]:
    return list(dict.fromkeys(_REFERENCE.findall(text)))


def _ordered_views(text: str, seen: list[str]) -> None:
    for name in _references(text):
        if name in VIEWS and name not in seen:
            _ordered_views(VIEWS[name], seen)
            seen.append(name)


def oracle_text(body: str) -> str:
    """Prefix the referenced views as CTEs and resolve ``{name}`` to plain names."""
    views: list[str] = []
    _ordered_views(body, views)
    plain = lambda text: _REFERENCE.sub(r"\1", text).replace("{{", "{").replace("}}", "}")
    ctes = [f"{name} AS (\n{plain(VIEWS[name]).strip()}\n)" for name in views]
    body = plain(body).strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def query(key: str, sql: str | None = None):
    """Register ``fn(Data) -> DataFrame`` under ``key`` with optional reference SQL."""

    def register(fn: Callable[[Data], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = lambda spark, folder: fn(Data(spark, folder))
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return register
