"""Joins Spark has no operator for: as-of, nearest-date, shifted, and key/value diffs.

Points in time are dates or timestamps. The ordered part of each join runs on distinct (key, time)
rows in blocks of the time order (`ordered.last_known`), so a key may hold any number of them; the
rows are then matched back by an equi join with one row per (key, time) on the other side, which
adaptive execution splits when one key is hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.operators.ordered import last_known


def _days(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, cols: Sequence[str]):
    """Distinct left days (side 1) and right days (side 0) carrying one struct per right day."""
    row = F.struct(F.col(right_on).alias("_on"), *cols)
    have = right.filter(F.col(right_on).isNotNull()).groupBy(*by, F.col(right_on).alias("_day")).agg(F.max(row).alias("_row"))
    want = left.select(*by, F.col(left_on).alias("_day")).filter(F.col("_day").isNotNull()).distinct()
    empty = F.lit(None).cast(have.schema["_row"].dataType)
    return have.withColumn("_side", F.lit(0)).unionByName(want.withColumn("_row", empty).withColumn("_side", F.lit(1)))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_on: str,
    right_on: str,
    cols: Sequence[str],
    how: str = "inner",
) -> DataFrame:
    """Each left row with the latest right row of its key dated on or before it.

    `cols` come from the right row (several right rows on one day: the greatest wins);
    `right_on` is added too. `how='left'` keeps left rows without a match.
    """
    both = _days(left, right, by, left_on, right_on, cols)
    seen = last_known(both, by, ["_day", "_side"], {"_hit": "_row"})
    hits = seen.filter((F.col("_side") == 1) & F.col("_hit").isNotNull()).select(*by, F.col("_day").alias(left_on), "_hit")
    picked = [F.col("_hit._on").alias(right_on)] + [F.col(f"_hit.{c}").alias(c) for c in cols]
    return left.join(hits, [*by, left_on], how).select(*[left[c] for c in left.columns], *picked)


def nearest_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_on: str,
    right_on: str,
    cols: Sequence[str],
    tolerance_days: int,
) -> DataFrame:
    """Each left row with the right row of its key nearest in time, within the tolerance.

    Of two equally near days the earlier wins. Adds `right_on`, `cols` and `delta_days`.
    Only the neighbours before and after are looked at; no pairs are formed.
    """
    both = _days(left, right, by, left_on, right_on, cols)
    seen = last_known(both, by, ["_day", "_side"], {"_before": "_row"}, {"_after": "_row"}).filter(F.col("_side") == 1)
    back, fwd = F.datediff("_day", F.col("_before._on")), F.datediff(F.col("_after._on"), "_day")
    use_back = F.col("_after").isNull() | (back <= fwd)
    hits = seen.select(
        *by,
        F.col("_day").alias(left_on),
        F.when(use_back, F.col("_before")).otherwise(F.col("_after")).alias("_hit"),
        F.when(use_back, back).otherwise(fwd).alias("delta_days"),
    ).filter(F.col("delta_days") <= tolerance_days)
    picked = [F.col("_hit._on").alias(right_on)] + [F.col(f"_hit.{c}").alias(c) for c in cols]
    return left.join(hits, [*by, left_on]).select(*[left[c] for c in left.columns], *picked, "delta_days")


def shift_join(
    df: DataFrame, other: DataFrame, by: Sequence[str], month: str, shift: int, cols: Sequence[str], suffix: str, how: str = "left"
) -> DataFrame:
    """Rows of `df` with `cols` of `other` from `shift` months away (gap-safe, unlike lag/lead).

    `other` must hold one row per (by, month).
    """
    moved = other.select(*by, (F.col(month) - shift).alias(month), *[F.col(c).alias(f"{c}{suffix}") for c in cols])
    return df.join(moved, [*by, month], how)


def semi_join(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in `keys`."""
    return df.join(keys.select(*on).distinct(), list(on), "left_semi")


def anti_join(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key does not occur in `keys`."""
    return df.join(keys.select(*on).distinct(), list(on), "left_anti")


def map_dimension(df: DataFrame, dim: DataFrame, on: str, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Attach dimension columns; of several dimension rows the smallest counts.

    No broadcast hint: the measured size of the dimension decides the join strategy.
    """
    one = dim.groupBy(on).agg(F.min(F.struct(*cols)).alias("_d")).select(on, *[F.col(f"_d.{c}").alias(c) for c in cols])
    return df.join(one, on, how)


def key_diff(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many keys are in both tables, only left, only right, with shares of each side."""
    tagged = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    flags = tagged.groupBy(*keys).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    counts = flags.agg(
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("in_both"),
        F.count_if(F.col("r") == 0).alias("only_left"),
        F.count_if(F.col("l") == 0).alias("only_right"),
    )
    n_left, n_right = F.col("in_both") + F.col("only_left"), F.col("in_both") + F.col("only_right")
    return counts.select(
        "*",
        F.try_divide(F.col("in_both") * 100.0, n_left).alias("pct_of_left"),
        F.try_divide(F.col("in_both") * 100.0, n_right).alias("pct_of_right"),
    )


def shared_cells(left: DataFrame, right: DataFrame, keys: Sequence[str], feature: str, value: str) -> DataFrame:
    """Tall cells of both tables whose key occurs in both: keys, feature, v1, v2, and `first`, which is
    true on one row of each key.

    Each table is read once. The cells of a key, at most one for each feature, are put together, so the
    join of the keys also says which are in both. Tables that are bucketed alike by the keys
    (`sinks.write_tall`) are not shuffled.
    """

    def cells(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.collect_list(F.struct(F.col(feature).alias("f"), F.col(value).cast("double").alias("v"))).alias(name))

    empty = F.lit(None).cast("double")
    one = F.transform("_a", lambda x: F.struct(x["f"].alias("f"), x["v"].alias("v1"), empty.alias("v2")))
    two = F.transform("_b", lambda x: F.struct(x["f"].alias("f"), empty.alias("v1"), x["v"].alias("v2")))
    both = cells(left, "_a").join(cells(right, "_b"), list(keys))
    rows = both.select(*keys, F.posexplode(F.concat(one, two)).alias("_at", "_c")).select(*keys, F.col("_c.f").alias(feature), "_c.v1", "_c.v2", "_at")
    return rows.groupBy(*keys, feature).agg(F.max("v1").alias("v1"), F.max("v2").alias("v2"), (F.min("_at") == 0).alias("first"))


__all__ = [
    "anti_join", "asof_join", "key_diff", "map_dimension", "nearest_join",
    "semi_join", "shared_cells", "shift_join",
]
