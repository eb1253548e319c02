"""Training-data operators: quality, tokens, chat, shards, privacy, near copies, benchmark leaks,
web archives, licences, language, token spans, addresses and spelling variants. Nothing else in the library imports this subpackage."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MODULES = ("documents", "records", "vocabularies")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The opN queries by name."""
    out: dict[str, Callable] = {}
    for name in _MODULES:
        out |= importlib.import_module(f"{__name__}.registered.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    """SQL of those that SQL can say."""
    out: dict[str, str] = {}
    for name in _MODULES:
        out |= importlib.import_module(f"{__name__}.registered.{name}").ORACLES
    return out
