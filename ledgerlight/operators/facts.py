"""From raw facts to one value per reported item, its history, and feature tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight import config as C
from ledgerlight.functions import dates as D
from ledgerlight.functions.numeric import change
from ledgerlight.schema import FACT_KEY, FILING_KEY, HISTORY_KEY, require


def join_headers(num: DataFrame, sub: DataFrame, cols: Sequence[str] = ("cik", "name", "sic", "form", "period")) -> DataFrame:
    """Facts with the columns of their filing; one filing may own most facts, AQE splits it."""
    keep = [c for c in cols if c in sub.columns]
    return num.join(sub.select("adsh", *keep), "adsh")


def tag_stats(facts: DataFrame) -> DataFrame:
    """Occurrences and distinct companies per tag."""
    return facts.groupBy("tag").agg(F.count("adsh").alias("occurrences"), F.count_distinct("cik").alias("distinct_companies"))


def top_tags(stats: DataFrame, k: int = C.TOP_TAGS) -> DataFrame:
    """(rank, tag) of the k tags used by most companies; fails when there are fewer."""
    top = stats.orderBy(F.desc("distinct_companies"), "tag").limit(k)
    # k names are the feature list itself: bounded metadata
    tags = [r["tag"] for r in top.select("tag").collect()]
    if len(tags) < k:
        raise ValueError(f"asked for {k} tags, found {len(tags)}")
    return stats.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(tags)], "rank int, tag string")


def segment_profile(rows: DataFrame, keys: Sequence[str] = FACT_KEY) -> DataFrame:
    """Per fact key: distinct segments, whether a company-level row exists, whether it is alone.

    `rows` are distinct; NULL keys form groups too.
    """
    n, named = F.count("*"), F.count("segments")
    return rows.groupBy(*keys).agg(
        F.count_distinct("segments").alias("distinct_segments_non_null"),
        (named < n).alias("has_segment_null"),
        (n == 1).alias("only_1_segment"),
        ((named < n) | (n == 1)).alias("has_summary_record"),
    )


def _fact_rows(facts: DataFrame, forms: Iterable[str], by: Sequence[str] = ()) -> DataFrame:
    """Standard-tag USD facts with a value, duplicates included."""
    return facts.filter(
        (F.col("custom_tag") == 0) & F.col("form").isin(*forms) & F.col("value").isNotNull() & (F.col("uom") == C.UNIT)
    ).select(*FACT_KEY, *by, "segments", "value")


def segment_summary(facts: DataFrame, forms: Iterable[str] = C.FORMS, by: Sequence[str] = ()) -> DataFrame:
    """One row per fact key: the only row, else the company-level row, else the largest value.

    `by` adds columns to the key: with the data quarter, each quarter is summarised on its own.

    Duplicated rows change nothing below, so the full-row distinct is not run: "one row" is
    "smallest equals largest". That leaves a single shuffle, with partial aggregation.
    Ties: the largest company-level value; the first segment among equal values.
    """
    require(facts, [*FACT_KEY, "segments", "value", "uom", "custom_tag"])
    rows = _fact_rows(facts, forms, by)
    total_value = F.max(F.when(F.col("segments").isNull(), F.col("value")))
    g = rows.groupBy(*FACT_KEY, *by).agg(
        F.count("*").alias("_n"),
        F.count("segments").alias("_named"),
        total_value.alias("_total"),
        F.min("value").alias("_low"),
        F.max("value").alias("_high"),
        F.min("segments").alias("_first"),
        F.max("segments").alias("_last"),
        F.min_by("segments", F.struct(-F.col("value"), F.col("segments"))).alias("_at_high"),
    )
    has_null = F.col("_named") < F.col("_n")
    same_segment = (F.col("_named") == 0) | (~has_null & (F.col("_first") == F.col("_last")))
    single = (F.col("_low") == F.col("_high")) & same_segment
    return g.select(
        *FACT_KEY,
        *by,
        F.when(~has_null, F.col("_at_high")).alias("segments"),
        F.when(has_null, F.col("_total")).otherwise(F.col("_high")).alias("value"),
        F.lit(1).alias("summary_flag"),
        F.when(single, "single_record").when(has_null, "segments_null_summary").otherwise("max_value").alias("summary_reason"),
    )


def _dated(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One value per (history key, raw date), repaired and parsed dates, no NULL keys.

    The date is parsed from an aggregate's output, so the check on it stays above the
    grouping and runs once per item date instead of once per raw fact.
    """
    one = rows.dropna(subset=HISTORY_KEY).groupBy(*HISTORY_KEY, *by, F.col("ddate").alias("_raw")).agg(
        F.max("value").alias("value"), F.max("ddate").alias("_same")
    )
    return one.select(*HISTORY_KEY, *by, "value", D.parse_day(D.repair_year(F.col("_same"))).alias("ddate")).filter(F.col("ddate").isNotNull())


def history_points(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every dated value of an item with the item's latest date and value, interval and change.

    Collapsed to one row per (item, date) first, so an item's window holds at most its dates.
    """
    newest = F.max(F.struct("ddate", "value")).over(Window.partitionBy(*HISTORY_KEY, *by))
    p = _dated(rows, by).withColumn("_m", newest)
    p = p.select(*HISTORY_KEY, *by, "ddate", "value", F.col("_m.ddate").alias("crt_ddate"), F.col("_m.value").alias("crt_value"))
    return p.withColumns({
        "quarter_interval": D.days_to_quarter(D.round_quarter_days(F.datediff("crt_ddate", "ddate"))),
        "percentage_diff": change(F.col("crt_value"), F.col("value"), "current"),
    })


def newest_values(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Latest value of each item without its past: one aggregate, no arrays."""
    newest = F.max(F.struct("ddate", "value"))
    g = _dated(rows, by).groupBy(*HISTORY_KEY, *by).agg(newest.alias("_m"))
    return g.select(*HISTORY_KEY, *by, F.col("_m.ddate").alias("crt_ddate"), F.col("_m.value").alias("crt_value"))


def history_comparisons(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Latest value of each item with arrays of its earlier dates, values, intervals and changes.

    Groups the points where the window left them: no further shuffle.
    """
    point = F.struct("ddate", "value", "quarter_interval", "percentage_diff")
    g = history_points(rows, by).groupBy(*HISTORY_KEY, *by).agg(
        F.first("crt_ddate").alias("crt_ddate"), F.first("crt_value").alias("crt_value"), F.sort_array(F.collect_list(point)).alias("_p")
    )
    others = F.slice("_p", 1, F.size("_p") - 1)
    return g.withColumn("_o", others).select(
        *HISTORY_KEY, *by, "crt_ddate", "crt_value",
        F.col("_o.ddate").alias("other_ddates"), F.col("_o.value").alias("other_values"),
        F.col("_o.quarter_interval").alias("quarter_intervals"), F.col("_o.percentage_diff").alias("percentage_diffs"),
        F.size("_o").alias("num_historical_points"),
    )


def latest_values(df: DataFrame, forms: Iterable[str] = C.FORMS) -> DataFrame:
    """Latest fact of each item of incremental filings (no segments there)."""
    kept = df.filter(
        F.col("form").isin(*forms) & (F.col("uom") == C.UNIT) & F.col("value").isNotNull() & (F.col("qtrs") <= C.MAX_QTRS)
    ).dropna(subset=[*HISTORY_KEY, "ddate"])
    if {"version", "adsh"} <= set(df.columns):
        kept = kept.filter(~F.col("version").eqNullSafe(F.col("adsh")))
    newest = F.max(F.struct("ddate", "value"))
    g = kept.groupBy(*HISTORY_KEY).agg(newest.alias("_m"))
    return g.select(*HISTORY_KEY, F.col("_m.ddate").alias("crt_ddate"), F.col("_m.value").alias("crt_value"))


def tall_features(history: DataFrame, tags: DataFrame | Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Current values as (cik, period, form, tag, qtrs, value), kept tall for all later work."""
    out = history.filter(F.col("qtrs") <= C.MAX_QTRS)
    if tags is not None:
        out = out.join(tags.select("tag").distinct(), "tag", "left_semi") if isinstance(tags, DataFrame) else out.filter(F.col("tag").isin(*tags))
    return out.select(*HISTORY_KEY, *by, F.col("crt_value").alias("value"))


def item_names(rows: DataFrame, tags: Sequence[str]) -> list[str]:
    """`{tag}_{q}qtrs` names of the chosen tags in facts or history rows: at most 5 per tag.

    On facts the same rows count as in the history, so the names need no second history pass.
    """
    if "ddate" in rows.columns:
        rows = _fact_rows(rows, C.FORMS).groupBy("tag", "qtrs", "ddate").agg(F.max("ddate").alias("_same"))
        rows = rows.filter(D.parse_day(D.repair_year(F.col("_same"))).isNotNull())
    found = rows.filter(F.col("tag").isin(*tags) & (F.col("qtrs") <= C.MAX_QTRS)).select("tag", "qtrs").distinct().collect()
    return sorted(f"{r['tag']}_{r['qtrs']}qtrs" for r in found)


def pivot_features(history: DataFrame, tags: Sequence[str], n_history: int = C.HISTORY_QUARTERS, names: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Wide table: one row per filing (and value of `by`), `_current` and `_change_q{n}` columns, names sorted.

    Filings without a chosen tag keep their row. One pass: current and change values are
    exploded into named cells and pivoted with an explicit name list.
    """
    items = list(names) if names is not None else item_names(history, tags)
    expected = sorted(
        [f"{i}_current" for i in items] + [f"{i}_change_q{n}" for i in items for n in range(1, n_history + 1)]
    )
    chosen = F.col("tag").isin(*tags) & (F.col("qtrs") <= C.MAX_QTRS)
    item = F.concat("tag", F.lit("_"), F.col("qtrs").cast("string"), F.lit("qtrs"))
    now = F.struct(F.concat(item, F.lit("_current")).alias("c"), F.col("crt_value").alias("v"))
    cells = F.array(now)
    if n_history:
        past = F.filter(
            F.arrays_zip(F.col("quarter_intervals").alias("q"), F.col("percentage_diffs").alias("d")),
            lambda p: p["q"].between(1, n_history) & p["d"].isNotNull(),
        )
        named = F.transform(past, lambda p: F.struct(F.concat(item, F.lit("_change_q"), p["q"].cast("string")).alias("c"), p["d"].alias("v")))
        # the first entry of a cell wins, as the arrays run from old to new
        cells = F.concat(cells, named)
    none = F.array(F.struct(F.lit(None).cast("string").alias("c"), F.lit(None).cast("double").alias("v")))
    rows = history.select(*FILING_KEY, *by, F.posexplode(F.when(chosen, cells).otherwise(none)).alias("_at", "_cell"))
    rows = rows.select(*FILING_KEY, *by, F.col("_cell.c").alias("_c"), "_at", F.col("_cell.v").alias("_v"))
    wide = rows.groupBy(*FILING_KEY, *by).pivot("_c", expected).agg(F.min_by("_v", "_at"))
    return wide.select(*FILING_KEY, *by, *[f"`{c}`" for c in expected])


def completeness(wide: DataFrame, keys: Sequence[str] = ("cik", "period", "form", "data_qtr")) -> DataFrame:
    """(rank, feature, non_null_count, non_null_percentage), fullest first, name on ties.

    One pass over the table; the ranking sorts one row per column.
    """
    names = [c for c in wide.columns if c not in keys]
    one = wide.agg(F.count("*").alias("_rows"), *[F.count(f"`{c}`").alias(c) for c in names])
    tall = one.unpivot(["_rows"], [f"`{c}`" for c in names], "feature", "non_null_count")
    pct = F.try_divide(F.col("non_null_count") * 100.0, F.col("_rows"))
    rank = F.row_number().over(Window.orderBy(F.desc("non_null_count"), "feature"))
    return tall.select(rank.alias("rank"), "feature", "non_null_count", pct.alias("non_null_percentage"))


def completeness_filter(wide: DataFrame, ranking: DataFrame, mapped: DataFrame, min_pct: float = C.MIN_COMPLETENESS) -> DataFrame:
    """Well-filled columns of mapped companies, newest quarter per (cik, period); form is not kept.

    On equal quarters the first form by name wins.
    """
    good = {r["feature"] for r in ranking.filter(F.col("non_null_percentage") > min_pct).select("feature").collect()}
    cols = ["cik", "period", "data_qtr"] + [c for c in wide.columns if c in good]
    kept = wide.join(mapped.select("cik").distinct(), "cik", "left_semi")
    rest = [c for c in cols if c not in ("cik", "period")]
    form = F.col("form") if "form" in wide.columns else F.lit("")
    # newest quarter first, then the smallest form: the form's inverted characters make it the largest
    inverted = F.transform(F.split(form, ""), lambda c: -F.ascii(c))
    order = F.struct(F.col("data_qtr"), F.concat(inverted, F.array(F.lit(1))))
    one = kept.groupBy("cik", "period").agg(F.max_by(F.struct(*[f"`{c}`" for c in rest]), order).alias("_row"))
    return one.select("cik", "period", "_row.*").select(*[f"`{c}`" for c in cols])
