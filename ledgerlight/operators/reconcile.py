"""Comparing tables and pipelines, duplicate audits, and catch-up summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight import config as C
from ledgerlight.functions import dates as D
from ledgerlight.functions.numeric import is_close, safe_divide
from ledgerlight.operators.joins import nearest_join, shared_cells
from ledgerlight.operators.ordered import keep_first, top_rows


def completeness_reconciliation(tall: DataFrame, combined: DataFrame, feature: str = "feature", part: str = "data_qtr") -> DataFrame:
    """Features whose counts summed over quarters differ from the combined table's."""
    parts = tall.groupBy(part, feature).agg(F.count("value").alias("n")).groupBy(feature).agg(F.sum("n").alias("sum_of_parts"))
    whole = combined.groupBy(feature).agg(F.count("value").alias("combined"))
    j = parts.join(whole, feature, "full_outer").select(
        feature, F.coalesce("sum_of_parts", F.lit(0)).alias("sum_of_parts"), F.coalesce("combined", F.lit(0)).alias("combined")
    )
    return j.withColumn("diff", F.col("sum_of_parts") - F.col("combined")).filter(F.col("diff") != 0)


def duplicate_keys(df: DataFrame, keys: Sequence[str] = ("cik", "period"), part: str = "data_qtr") -> DataFrame:
    """Keys that occur in more than one quarter, with how many."""
    g = df.groupBy(*keys).agg(F.count_distinct(part).alias("quarters"))
    return g.filter(F.col("quarters") > 1)


def duplicate_histogram(dups: DataFrame, df: DataFrame, part: str = "data_qtr") -> DataFrame:
    """Keys per number of quarters, and whether that is every quarter of the table."""
    total = df.agg(F.count_distinct(part).alias("n"))
    g = dups.groupBy("quarters").agg(F.count("*").alias("keys"))
    return g.withColumn("in_all_quarters", F.col("quarters") == total.scalar())


def value_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], feature: str = "feature", value: str = "value", eps: float = 1e-10) -> DataFrame:
    """Per feature: absolute and relative differences and mismatches over the common keys.

    Tall inputs, one row per (keys, feature), empty cells included or not; each is read once.
    """
    cells = shared_cells(left, right, keys, feature, value)
    d = F.abs(F.col("v1") - F.col("v2"))
    rel = d / (F.abs("v1") + eps) * 100
    both = F.col("v1").isNotNull() & F.col("v2").isNotNull()
    one = F.col("v1").isNull() != F.col("v2").isNull()
    g = cells.groupBy(feature).agg(
        F.avg(d).alias("mean_abs_diff"), F.max(d).alias("max_abs_diff"), F.avg(rel).alias("mean_rel_diff_pct"), F.max(rel).alias("max_rel_diff_pct"),
        (F.count_if(one) + F.count_if(d > eps)).alias("mismatches"), F.count_if(both).alias("matching_pairs"), F.count_if("first").alias("_keys"),
    )
    n = F.sum("_keys").over(Window.partitionBy())  # one row for each feature
    return g.withColumn("mismatch_pct", F.try_divide(F.col("mismatches") * 100.0, n)).drop("_keys")


def feature_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], name: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """Row-level differences of one feature over the common keys; each input is read once."""
    cells = shared_cells(left, right, keys, feature, value).filter(F.col(feature) == name)
    v1, v2 = F.col("v1"), F.col("v2")
    return cells.filter(~v1.eqNullSafe(v2)).select(*keys, "v1", "v2", F.abs(v1 - v2).alias("abs_diff"))


def overlapping_reports(batch: DataFrame, catchup: DataFrame, tolerance_days: int = C.PERIOD_TOLERANCE_DAYS) -> DataFrame:
    """Nearest batch period for each catch-up report of the same company and form."""
    left = catchup.select("cik", "form", F.col("period").alias("period_catchup")).distinct().withColumn("_d", D.parse_day(F.col("period_catchup")))
    right = batch.select("cik", "form", F.col("period").alias("period_batch")).distinct().withColumn("_b", D.parse_day(F.col("period_batch")))
    hit = nearest_join(left, right, ["cik", "form"], "_d", "_b", ["period_batch"], tolerance_days)
    return hit.select("cik", "form", "period_catchup", "period_batch", F.col("delta_days").alias("period_delta_days"))


def best_pairs(pairs: DataFrame) -> DataFrame:
    """One pair per (cik, form): the closest, then the most recent catch-up period."""
    return keep_first(pairs, ["cik", "form"], [F.col("period_delta_days"), -F.col("period_catchup")])


def compare_pairs(batch: DataFrame, catchup: DataFrame, pairs: DataFrame, features: Sequence[str], rtol: float = C.VALUE_RTOL, atol: float = C.VALUE_ATOL) -> DataFrame:
    """Closeness of the shared features of each matched pair, with all disagreeing names.

    Inputs are tall (cik, form, period, feature, value); the tolerance refers to the catch-up
    side. `features` is the shared column list, so names per pair are bounded by it.
    """
    cols = ["cik", "form", "period_catchup", "period_batch", "period_delta_days", "feature"]
    cells = pair_cells(batch, catchup, pairs, features, rtol, atol)
    bad = F.sort_array(F.collect_list(F.when(F.col("present") & ~F.col("close"), F.col("feature"))))
    g = cells.groupBy(*cols[:-1]).agg(
        F.count_if("present").alias("n_both_present"), F.count_if("close").alias("n_value_close"),
        F.count_if(F.col("v1").isNull() != F.col("v2").isNull()).alias("n_one_nan"), F.array_join(bad, ",").alias("disagreements"),
    )
    none = pairs.join(g, cols[:-1], "left")
    n = {k: F.coalesce(k, F.lit(0)) for k in ("n_both_present", "n_value_close", "n_one_nan")}
    return none.select(
        *cols[:-1], F.lit(len(features)).alias("n_shared_features"), *[v.alias(k) for k, v in n.items()],
        (n["n_both_present"] - n["n_value_close"]).alias("n_disagree"),
        safe_divide(n["n_value_close"].cast("double"), n["n_both_present"]).alias("match_rate_present"),
        (F.lit(len(features)) - n["n_both_present"] - n["n_one_nan"]).alias("n_both_nan"),
        F.coalesce("disagreements", F.lit("")).alias("disagreements"),
    )


def pair_cells(batch: DataFrame, catchup: DataFrame, pairs: DataFrame, features: Sequence[str], rtol: float = C.VALUE_RTOL, atol: float = C.VALUE_ATOL) -> DataFrame:
    """Every compared cell of the matched pairs: both values, whether both are there, whether they are close."""
    wanted = F.col("feature").isin(*features)
    b = batch.filter(wanted).select("cik", "form", F.col("period").alias("period_batch"), "feature", F.col("value").alias("v1"))
    c = catchup.filter(wanted).select("cik", "form", F.col("period").alias("period_catchup"), "feature", F.col("value").alias("v2"))
    left = pairs.join(b, ["cik", "form", "period_batch"])
    right = pairs.join(c, ["cik", "form", "period_catchup"])
    cols = ["cik", "form", "period_catchup", "period_batch", "period_delta_days", "feature"]
    both = left.select(*cols, "v1", F.lit(None).cast("double").alias("v2")).unionByName(right.select(*cols, F.lit(None).cast("double").alias("v1"), "v2"))
    cells = both.groupBy(*cols).agg(F.max("v1").alias("v1"), F.max("v2").alias("v2"))
    present = F.col("v1").isNotNull() & F.col("v2").isNotNull()
    return cells.select(*cols, "v1", "v2", present.alias("present"), F.coalesce(present & is_close(F.col("v1"), F.col("v2"), rtol, atol), F.lit(False)).alias("close"))


def disagreements(batch: DataFrame, catchup: DataFrame, pairs: DataFrame, features: Sequence[str], rtol: float = C.VALUE_RTOL, atol: float = C.VALUE_ATOL) -> DataFrame:
    """Every cell in which both sides have a value and the values are not close."""
    return pair_cells(batch, catchup, pairs, features, rtol, atol).filter("present and not close").drop("present", "close")


def source_match(bulk: DataFrame, api: DataFrame, on: Sequence[str] = ("cik", "tag", "ddate", "qtrs")) -> DataFrame:
    """Company-level bulk values against the API's: matched and mismatching pairs.

    Equal values are counted per key before the join, so repeated facts cost one row.
    """
    on = list(on)
    a = bulk.filter(F.col("segments").isNull()).groupBy(*on, "value").agg(F.count("*").alias("n"))
    b = api.groupBy(*on, F.col("value").alias("api_value")).agg(F.count("*").alias("m"))
    pairs = F.col("n") * F.col("m")
    differ = ~F.col("value").eqNullSafe(F.col("api_value"))
    return a.join(b, on).agg(F.coalesce(F.sum(pairs), F.lit(0)).alias("matched"), F.coalesce(F.sum(F.when(differ, pairs)), F.lit(0)).alias("mismatching"))


def unmatched_breakdown(bulk: DataFrame, api: DataFrame, on: Sequence[str] = ("cik", "tag")) -> DataFrame:
    """Bulk rows whose tag the API lacks: all, custom, then standard without segments, then with a value."""
    rest = bulk.join(api.select(*on).distinct(), list(on), "left_anti")
    std = F.col("custom_tag") == 0
    top = std & F.col("segments").isNull()
    return rest.agg(
        F.count("*").alias("rows"), F.count_if(~std).alias("custom"), F.count_if(std).alias("standard"),
        F.count_if(top).alias("company_level"), F.count_if(top & F.col("value").isNotNull()).alias("unexplained"),
    )


def unknown_filings(filings: DataFrame, known: DataFrame, max_per_cik: int | None = None) -> DataFrame:
    """Filings not known yet, the newest `max_per_cik` of each company."""
    new = filings.join(known.select("adsh").distinct(), "adsh", "left_anti")
    if max_per_cik is None:
        return new
    return top_rows(new, ["cik"], [F.desc_nulls_last("filed"), F.desc("adsh")], max_per_cik, "_r").drop("_r")


def catchup_actions(filings: DataFrame, bulk: DataFrame, catchup: DataFrame, facts: DataFrame, max_per_cik: int | None = None) -> DataFrame:
    """What happens to each filing of a catch-up run: (…, action).

    The known-filing labels are given to companies with nothing new; elsewhere only the new
    filings are listed, as downloaded or without facts.
    """
    flagged = (
        filings.join(bulk.select("adsh").distinct().withColumn("_b", F.lit(1)), "adsh", "left")
        .join(catchup.select("adsh").distinct().withColumn("_c", F.lit(1)), "adsh", "left")
        .join(facts.select("adsh").distinct().withColumn("_f", F.lit(1)), "adsh", "left")
    )
    fresh = F.col("_b").isNull() & F.col("_c").isNull()
    per = flagged.groupBy("cik").agg(F.count_if(fresh).alias("_new"))
    rows = flagged.join(per, "cik")
    old = rows.filter(F.col("_new") == 0).withColumn(
        "action", F.when(F.col("_b") == 1, "already_in_batch").when(F.col("_c") == 1, "already_in_catchup").otherwise("skipped")
    )
    new = rows.filter(fresh).withColumn("action", F.when(F.col("_f") == 1, "downloaded").otherwise("no_xbrl_facts"))
    if max_per_cik is not None:
        new = top_rows(new, ["cik"], [F.desc_nulls_last("filed"), F.desc("adsh")], max_per_cik, "_r").drop("_r")
    return old.unionByName(new).drop("_b", "_c", "_f", "_new")
