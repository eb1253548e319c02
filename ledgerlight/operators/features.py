"""Ratios, gradients and outlier flags on wide or tall feature tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight import config as C
from ledgerlight.functions import dates as D
from ledgerlight.functions.numeric import change, safe_divide
from ledgerlight.operators.ordered import exact_quantiles, keep_first


def find_column(columns: Sequence[str], tag: str, qtrs: int | Sequence[int] = (1, 0), suffix: str = "_current") -> str | None:
    """Feature column of a tag: each qtrs in turn, exact name first, then any case."""
    for q in [qtrs] if isinstance(qtrs, int) else qtrs:
        want = f"{tag}_{q}qtrs{suffix}"
        if want in columns:
            return want
        for c in columns:
            if c.lower() == want.lower():
                return c
    return None


def find_column_qtrs(columns: Sequence[str], tag: str, preferred: int, suffix: str = "_current") -> tuple[str | None, int | None]:
    """Column at the preferred qtrs, else at 1 or 0, and the qtrs it was found at."""
    for q in (preferred, 1, 0):
        col = find_column(columns, tag, q, suffix)
        if col:
            return col, q
    return None, None


def _ratio_column(columns: Sequence[str], numerator, denominator: str, num_qtrs, den_qtrs) -> Column | None:
    den = find_column(columns, denominator, den_qtrs)
    terms = [(sign, find_column(columns, tag, num_qtrs)) for sign, tag in numerator]
    if den is None or any(c is None for _, c in terms):
        return None
    total = reduce(lambda a, b: a + b, [F.col(f"`{c}`") * F.lit(float(sign)) for sign, c in terms])
    return safe_divide(total, F.col(f"`{den}`"))


def ratio_features(wide: DataFrame, ratios: Sequence[C.Ratio] = C.RATIOS) -> DataFrame:
    """Add the fixed ratios whose columns exist, at their pinned quarters."""
    made = {r.column: _ratio_column(wide.columns, r.numerator, r.denominator, r.num_qtrs, r.den_qtrs) for r in ratios}
    return wide.withColumns({k: v for k, v in made.items() if v is not None})


def defined_ratios(wide: DataFrame, ratios: Sequence[C.Ratio] = C.RATIOS, legacy: bool = False) -> DataFrame:
    """Add `{name}_augment` per definition, each tag at quarter 1 else 0.

    `legacy` subtracts every further numerator tag, also where the fixed ratios add debt.
    """
    made = {}
    for r in ratios:
        terms = [(sign if i == 0 or not legacy else -1, tag) for i, (sign, tag) in enumerate(r.numerator)]
        made[f"{r.name}_augment"] = _ratio_column(wide.columns, terms, r.denominator, (1, 0), (1, 0))
    return wide.withColumns({k: v for k, v in made.items() if v is not None})


def tall_ratios(tall: DataFrame, keys: Sequence[str], ratios: Sequence[C.Ratio] = C.RATIOS) -> DataFrame:
    """Fixed ratios straight from the tall table: only the needed cells are pivoted."""
    cells = sorted({(t, r.num_qtrs) for r in ratios for _, t in r.numerator} | {(r.denominator, r.den_qtrs) for r in ratios})
    aggs = [F.max(F.when((F.col("tag") == t) & (F.col("qtrs") == q), F.col("value"))).alias(f"{t}_{q}qtrs_current") for t, q in cells]
    needed = tall.filter(F.col("tag").isin(*{t for t, _ in cells}))
    wide = ratio_features(needed.groupBy(*keys).agg(*aggs), ratios)
    return wide.select(*keys, *[r.column for r in ratios])


def enhance_names(columns: Sequence[str], suffixes: Sequence[str] = C.GRADIENT_SUFFIXES) -> dict[str, str]:
    """Feature column -> its name without the suffix."""
    return {c: c[: -len(s)] for s in suffixes for c in columns if c.endswith(s)}


def gradients(
    wide: DataFrame,
    quarters: Sequence[int] = C.GRADIENT_QUARTERS,
    suffixes: Sequence[str] = C.GRADIENT_SUFFIXES,
    history: DataFrame | None = None,
) -> DataFrame:
    """Add `{base}_change_q{n}`: change against the filing 3n months before; period becomes month end.

    `wide` holds one row per (cik, period); `history` adds earlier filings for comparison
    only, the work rows win. Of several filings in a month the latest is compared with.
    All quarters come from one window pass over a company's filings: a range frame reaches
    exactly 3n months back whatever lies between. A row's values travel as one array, and names
    return at the end, so the plan has one expression for each quarter instead of each column.
    """
    names = enhance_names(wide.columns, suffixes)
    if not names:
        return wide
    rows = wide.withColumn("_work", F.lit(True))
    if history is not None:
        extra = history.select("cik", "period", *[f"`{c}`" for c in names if c in history.columns])
        known = extra.join(wide.select("cik", "period"), ["cik", "period"], "left_anti")
        rows = rows.unionByName(dedupe_filings(known).withColumn("_work", F.lit(False)), allowMissingColumns=True)
    rows = rows.withColumn("_m", D.month_index(D.parse_day(F.col("period"))))
    rows = rows.withColumn("_now", F.array(*[F.col(f"`{c}`").cast("double") for c in names]))
    by_month = Window.partitionBy("cik").orderBy("_m")
    past = {f"_h{q}": F.max_by("_now", "period").over(by_month.rangeBetween(-3 * q, -3 * q)) for q in quarters}
    seen = rows.withColumns(past).filter("_work")
    seen = seen.withColumns({f"_h{q}": F.zip_with("_now", f"_h{q}", lambda now, then: change(now, then)) for q in quarters})
    made = {f"{base}_change_q{q}": F.get(f"_h{q}", F.lit(i)) for q in quarters for i, base in enumerate(names.values())}
    period = {"period": D.to_int(D.month_end(F.col("_m")))}
    return seen.select(*[period[c].alias(c) if c in period else F.col(f"`{c}`") for c in wide.columns], *[e.alias(c) for c, e in made.items()])


def tall_gradients(tall: DataFrame, keys: Sequence[str] = ("cik", "feature"), quarters: Sequence[int] = C.GRADIENT_QUARTERS) -> DataFrame:
    """Gradients on (cik, feature, period, value) rows: (…, period, q, current, past, gradient).

    The scalable form: no width limit, one shuffle by (cik, feature), whose rows are a company's
    months. Range frames reach exactly 3n months back; a month without a row, and a row without a key, gives no gradient.
    """
    month = D.month_index(D.parse_day(F.col("period")))
    spread = tall.dropna(subset=list(keys)).select(*keys, month.alias("_m"), "period", "value").repartition(*keys)
    rows = spread.groupBy(*keys, "_m").agg(F.max_by("value", "period").alias("value"))
    by_month = Window.partitionBy(*keys).orderBy("_m")
    past = [F.struct(F.lit(q).alias("q"), F.first(F.struct("value")).over(by_month.rangeBetween(-3 * q, -3 * q)).alias("then")) for q in quarters]
    out = rows.withColumn("_past", F.array(*past)).select(*keys, "_m", "value", F.inline("_past")).filter(F.col("then").isNotNull())
    return out.select(
        *keys, D.to_int(D.month_end(F.col("_m"))).alias("period"), "q", F.col("value").alias("current"), F.col("then.value").alias("past"),
        change(F.col("value"), F.col("then.value")).alias("gradient"),
    )


def first_wins(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union keeping one row per key, the first table's when both have it."""
    both = first.withColumn("_side", F.lit(0)).unionByName(second.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    rest = [f"`{c}`" for c in both.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.min_by(F.struct(*rest), "_side").alias("_row"))
    return best.select(*keys, "_row.*").select(*[f"`{c}`" for c in first.columns])


def dedupe_filings(wide: DataFrame, order: Sequence[str] = ("form", "data_qtr")) -> DataFrame:
    """One row per (cik, period), the first by the given order."""
    return keep_first(wide, ["cik", "period"], [F.col(c) for c in order if c in wide.columns])


def _augmented(columns: Sequence[str]) -> dict[str, str]:
    """Ratio column -> ratio name, for the columns present."""
    return {r.column: r.name for r in C.RATIOS if r.column in columns}


def _any(flags: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in flags], F.lit(False))


def hard_limit_flag(wide: DataFrame) -> DataFrame:
    """flag_outlier: a ratio above 1 or below 0 where that cannot be; missing ratios pass."""
    present = _augmented(wide.columns)
    flags = [F.col(c) > 1.0 for c, n in present.items() if n in C.MAX_ONE]
    flags += [F.col(c) < 0.0 for c, n in present.items() if n in C.MIN_ZERO]
    return wide.withColumn("flag_outlier", _any(flags))


def unpivot_ratios(wide: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, ratio, value) of the ratio columns present."""
    cols = list(_augmented(wide.columns))
    return wide.unpivot([F.col(k) for k in keys], [F.col(c) for c in cols], "ratio", "value")


def quartiles(wide: DataFrame) -> DataFrame:
    """Exact quartiles per ratio column: (ratio, n, q1, median, q3)."""
    return exact_quantiles(unpivot_ratios(wide), ["ratio"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})


def bounds_of(rows: list) -> dict[str, tuple[float, float]]:
    """Extreme bounds of the ratios with a positive spread, from collected quartiles."""
    out = {}
    for r in rows:
        spread = r["q3"] - r["q1"]
        if spread > 0:
            out[r["ratio"]] = (r["q1"] - C.IQR_FACTOR * spread, r["q3"] + C.IQR_FACTOR * spread)
    return out


def _iqr_bounds(wide: DataFrame) -> dict[str, tuple[float, float]]:
    """Extreme bounds per ratio: at most one row per ratio definition reaches the driver."""
    return bounds_of(quartiles(wide).collect())


def range_checks(column: Column, ratio: str, bounds: tuple[float, float] | None = None) -> dict[str, Column]:
    """Named checks of one ratio value: typical range, logical bounds, extreme spread."""
    low, high, upper, lower = C.EXPECTED_RANGES.get(ratio, (None,) * 4)
    checks = {}
    if low is not None:
        checks["below_typical_min"] = column < low
    if high is not None:
        checks["above_typical_max"] = column > high
    if upper is not None:
        checks["exceeds_upper_bound"] = column > upper
    if lower is not None:
        checks["below_lower_bound"] = column < lower
    if bounds is not None:
        checks["extreme_iqr"] = (column < bounds[0]) | (column > bounds[1])
    return checks


def expected_range_flag(wide: DataFrame, bounds: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """flag_outlier: any ratio outside its typical range, bounds or spread, or already flagged.

    The spread is that of `wide`, or given: `quarterly.stored_bounds` knows all stored quarters.
    """
    bounds = _iqr_bounds(wide) if bounds is None else bounds
    flags = [f for c, n in _augmented(wide.columns).items() for f in range_checks(F.col(c), n, bounds.get(c)).values()]
    before = [F.col("flag_outlier")] if "flag_outlier" in wide.columns else []
    return wide.withColumn("flag_outlier", _any([*flags, *before]))


def extreme_flag(wide: DataFrame, bounds: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """flag_outlier: any ratio outside three interquartile ranges (of `wide`, or given), or already flagged."""
    bounds = _iqr_bounds(wide) if bounds is None else bounds
    flags = [(F.col(c) < lo) | (F.col(c) > hi) for c, (lo, hi) in bounds.items()]
    before = [F.col("flag_outlier")] if "flag_outlier" in wide.columns else []
    return wide.withColumn("flag_outlier", _any([*flags, *before]))


def outlier_report(wide: DataFrame) -> DataFrame:
    """Per ratio: counts of each check, mean, median, extremes of the outliers, mean/median flag."""
    quarts = quartiles(wide).collect()
    bounds = bounds_of(quarts)
    present = _augmented(wide.columns)
    v = F.col("value")
    kinds = ["below_typical_min", "above_typical_max", "exceeds_upper_bound", "below_lower_bound", "extreme_iqr"]
    checks = {k: F.lit(False) for k in kinds}
    for c, n in present.items():
        for k, f in range_checks(v, n, bounds.get(c)).items():
            checks[k] = F.when(F.col("ratio") == c, f).otherwise(checks[k])
    tall = unpivot_ratios(wide).filter(v.isNotNull())
    hit = checks["extreme_iqr"]
    stats = tall.groupBy("ratio").agg(
        F.count("*").alias("non_null"),
        F.avg("value").alias("mean_value"),
        *[F.count_if(checks[k]).alias(k) for k in kinds],
        F.min(F.when(hit, v)).alias("min_outlier"),
        F.max(F.when(hit, v)).alias("max_outlier"),
    )
    med = wide.sparkSession.createDataFrame([(r["ratio"], r["median"]) for r in quarts], "ratio string, median_value double")
    skew = F.abs(safe_divide(F.col("mean_value"), F.col("median_value")))
    return stats.join(med, "ratio").withColumn("mean_median_flag", F.coalesce((skew > 10) | (skew < 0.1), F.lit(False)))


def outlier_overlap(wide: DataFrame) -> DataFrame:
    """Sum of extreme outliers per ratio against the distinct rows that hold one."""
    bounds = _iqr_bounds(wide)
    flags = [F.coalesce((F.col(c) < lo) | (F.col(c) > hi), F.lit(False)) for c, (lo, hi) in bounds.items()]
    n = reduce(lambda a, b: a + b, [f.cast("int") for f in flags], F.lit(0))
    counts = wide.select(n.alias("n")).agg(
        F.count("*").alias("total_rows"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("outliers_without_overlap"),
        F.count_if(F.col("n") > 0).alias("outlier_rows"),
    )
    return counts.withColumn("overlap", F.col("outliers_without_overlap") - F.col("outlier_rows"))


def ratio_stats(wide: DataFrame) -> DataFrame:
    """Per ratio: non-null count, mean, median, standard deviation."""
    tall = unpivot_ratios(wide)
    basic = tall.groupBy("ratio").agg(F.count("value").alias("non_null"), F.avg("value").alias("mean_value"), F.stddev("value").alias("std_value"))
    med = exact_quantiles(tall, ["ratio"], "value", {"median_value": 0.5}).drop("n")
    return basic.join(med, "ratio", "left")


def metrics_map(wide: DataFrame, keys: Sequence[str], suffixes: Sequence[str] = ("_current", "_augment")) -> DataFrame:
    """(keys, metric, value) with the suffix removed; empty `_current` cells stay, others go."""
    cols = [c for c in wide.columns if c.endswith(tuple(suffixes))]
    tall = wide.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols]).unpivot(
        [F.col(k) for k in keys], [F.col(f"`{c}`") for c in cols], "feature", "value"
    )
    kept = tall.filter(F.col("feature").endswith("_current") | F.col("value").isNotNull())
    pattern = "(" + "|".join(suffixes) + ")$"
    return kept.select(*keys, F.regexp_replace("feature", pattern, "").alias("metric"), "value")


def industry_benchmark(wide: DataFrame, sic: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean of each metric and number of companies per (sic, period)."""
    joined = wide.join(sic.select("cik", "sic"), "cik", "left").filter(F.col("sic").isNotNull())
    return joined.groupBy("sic", "period").agg(
        F.count_distinct("cik").alias("companies"), *[F.avg(f"`{m}`").alias(m) for m in metrics]
    )


def substitute_metrics(
    available: DataFrame, mapping: Mapping[str, str], metrics: Sequence[str] = C.KEY_METRICS, ratios: Sequence[C.Ratio] = C.RATIOS
) -> tuple[list[str], list[C.Ratio]]:
    """Metrics present (or mapped to a present tag) and the ratios computable with them.

    Looks up only the tags it needs, so what reaches the driver is bounded by the configuration.
    """
    wanted = sorted({*metrics, *mapping.values(), *[t for r in ratios for t in r.tags]})
    have = {r["tag"] for r in available.filter(F.col("tag").isin(*wanted)).select("tag").distinct().collect()}

    def resolve(tag: str) -> str | None:
        return tag if tag in have else (mapping.get(tag) if mapping.get(tag) in have else None)

    present = [t for t in (resolve(m) for m in metrics) if t]
    usable = []
    for r in ratios:
        tags = [(s, resolve(t)) for s, t in r.numerator]
        den = resolve(r.denominator)
        if den and all(t for _, t in tags):
            usable.append(C.Ratio(r.name, tuple(tags), den, r.num_qtrs, r.den_qtrs))
    return present, usable


def metric_substitutes(available: DataFrame, mapping: Mapping[str, str], metrics: Sequence[str] = C.KEY_METRICS) -> DataFrame:
    """(metric, tag): each configured metric with the tag that stands for it, NULL where none is used."""
    spark = available.sparkSession
    listed = spark.createDataFrame([(m, t, i) for m in metrics for i, t in enumerate((m, mapping.get(m))) if t], "metric string, tag string, choice int")
    have = available.select("tag").join(F.broadcast(listed.select("tag").distinct()), "tag", "left_semi").distinct()
    best = listed.join(have.withColumn("_have", F.lit(1)), "tag", "left").filter("_have = 1").groupBy("metric").agg(F.min_by("tag", "choice").alias("tag"))
    return listed.select("metric").distinct().join(best, "metric", "left")


def usable_ratios(substitutes: DataFrame, ratios: Sequence[C.Ratio] = C.RATIOS) -> DataFrame:
    """(ratio,) whose tags all have a metric in use."""
    spark = substitutes.sparkSession
    needs = spark.createDataFrame([(r.name, t) for r in ratios for t in sorted(set(r.tags))], "ratio string, metric string")
    kept = needs.join(substitutes, "metric", "left").groupBy("ratio").agg(F.count("*").alias("n"), F.count("tag").alias("k"))
    return kept.filter("n = k").select("ratio")


def tag_coverage(available: DataFrame, metrics: Sequence[str] = C.KEY_METRICS, ratios: Sequence[C.Ratio] = C.RATIOS) -> DataFrame:
    """Per configured tag: tracked, used by a ratio, companies reporting it."""
    used = {t for r in ratios for t in r.tags}
    names = sorted({*metrics, *used})
    spark = available.sparkSession
    listed = spark.createDataFrame([(t, t in metrics, t in used) for t in names], "tag string, tracked boolean, in_ratio boolean")
    seen = available.filter(F.col("tag").isin(*names)).groupBy("tag").agg(F.count_distinct("cik").alias("companies"))
    return listed.join(seen, "tag", "left").withColumn("companies", F.coalesce("companies", F.lit(0)))
