"""Unions, coalescing merges and set differences."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.session import spread


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Union by name, missing columns NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def combine_first(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outer merge on unique keys: the left value where there is one, columns united and sorted.

    Grouping the tagged union replaces the full outer join: one shuffle, and hot keys combine
    early.
    """
    cols = sorted({*left.columns, *right.columns} - set(keys))
    both = union_all([left.withColumn("_side", F.lit(0)), right.withColumn("_side", F.lit(1))])
    merged = both.groupBy(*keys).agg(*[F.min_by(f"`{c}`", F.when(F.col(f"`{c}`").isNotNull(), F.col("_side"))).alias(c) for c in cols])
    return merged.select(*keys, *[f"`{c}`" for c in cols])


def merge_forms(tables: Sequence[DataFrame], keys: Sequence[str] = ("cik", "period", "form")) -> DataFrame:
    """Feature tables of several forms or quarters: keys never overlap, so a union suffices."""
    cols = sorted({c for t in tables for c in t.columns} - set(keys))
    return union_all(tables).select(*keys, *[f"`{c}`" for c in cols])


def set_compare(left: DataFrame, right: DataFrame, cols: Sequence[str], tasks: int | None = None) -> DataFrame:
    """Distinct values with the side they occur on: both, left, right.

    `tasks`: where many distinct values are known to come, deal the rows to so many tasks.
    """
    tagged = left.select(*cols, F.lit(1).alias("_s")).unionByName(right.select(*cols, F.lit(2).alias("_s")))
    g = spread(tagged, tasks, *cols).groupBy(*cols).agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    side = F.when(F.col("_lo") != F.col("_hi"), "both").when(F.col("_lo") == 1, "left").otherwise("right")
    return g.select(*cols, side.alias("side"))


def column_diff(left: Sequence[str], right: Sequence[str]) -> dict[str, list[str]]:
    """Shared and one-sided column names."""
    a, b = set(left), set(right)
    return {"shared": sorted(a & b), "only_left": sorted(a - b), "only_right": sorted(b - a)}


def distinct_keys(df: DataFrame, keys: Sequence[str] = ("cik", "period", "form")) -> DataFrame:
    return df.select(*keys).distinct()


__all__ = ["column_diff", "combine_first", "distinct_keys", "merge_forms", "set_compare", "union_all"]
