"""Every query of the library by name, with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) under a name, with SQL whose {views} are filled in."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        from .sources.fixtures import fill

        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = fill(sql)
        return f

    return add


def load() -> None:
    """Import every module that registers queries."""
    from .plans import boxes, control, geometry, masks, report, sequences, sources, store, tensors  # noqa: F401


load()
