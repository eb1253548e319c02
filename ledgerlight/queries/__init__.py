"""Registered queries: each operator on the driver's tables, with its SQL twin where SQL can say it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlight.queries.registry import ORACLES, QUERIES

_MODULES = ("scans", "cleaning", "joining", "aggregates", "windows", "selection", "scalars", "quarters", "modelling", "streams")


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"{__name__}.{name}")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
