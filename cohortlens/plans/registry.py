"""Registry of named queries: the Spark side, and the SQL text that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortlens.fixtures import DRIVER_TABLES, VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Lazy mapping of table name to DataFrame: driver Parquet files and the views defined over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name in DRIVER_TABLES:
                self._cache[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                text = VIEWS[name]
                sources = {n: self[n] for n in re.findall(r"\{(\w+)\}", text)}
                self._cache[name] = self.spark.sql(text, **sources)
        return self._cache[name]

    def pick(self, *names: str) -> dict[str, DataFrame]:
        return {n: self[n] for n in names}


def _view_chain(names: tuple[str, ...], seen: dict[str, str]) -> None:
    for name in names:
        if name in DRIVER_TABLES or name in seen:
            continue
        deps = tuple(re.findall(r"\{(\w+)\}", VIEWS[name]))
        _view_chain(deps, seen)
        seen[name] = VIEWS[name].format(**{d: d for d in deps})


def with_views(body: str, views: tuple[str, ...]) -> str:
    """Put the view texts in front of ``body`` as common table expressions."""
    seen: dict[str, str] = {}
    _view_chain(views, seen)
    if not seen:
        return body.strip()
    ctes = ", ".join(f"{n} AS ({t.strip()})" for n, t in seen.items())
    body = body.strip()
    m = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if m:
        return f"WITH {m.group(1) or ''}{ctes}, {body[m.end():]}"
    return f"WITH {ctes} {body}"


def register(name: str, views: tuple[str, ...] | list[str] = (), sql: str | None = None):
    """Decorator: ``fn(tables) -> DataFrame`` becomes the query ``name``; ``sql`` is its check text."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            SQL[name] = with_views(sql, tuple(views))
        return fn

    return wrap
