"""Decorator that collects queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.fixtures import with_ctes

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(key: str, ctes: str = "", sql: str | None = None):
    """Register a query under its id; `sql` runs after the named fixture CTEs."""

    def add(fn):
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = with_ctes(ctes, sql) if ctes else sql
        return fn

    return add


def r6(col: Column | str) -> Column:
    """Rounded double for comparisons."""
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, without negative zero."""
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
