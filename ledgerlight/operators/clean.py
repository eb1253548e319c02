"""Filters and cleaning."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight import config as C
from ledgerlight.functions import dates as D
from ledgerlight.functions.numeric import clean
from ledgerlight.operators.ordered import exact_quantiles, running
from ledgerlight.schema import FACT_KEY


def drop_refiled(sub: DataFrame, keys: Sequence[str] = ("cik", "form", "period")) -> DataFrame:
    """Drop every submission of a key filed more than once.

    A key with one row needs no choice, so a counting aggregate replaces the window and
    copies of a hot key collapse before the shuffle.
    """
    rest = [c for c in sub.columns if c not in keys]
    once = sub.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_row"))
    return once.filter(F.col("_n") == 1).select(*keys, "_row.*").select(*sub.columns)


def flag_custom_tags(facts: DataFrame) -> DataFrame:
    """custom_tag = 1 where the taxonomy version is the filing itself."""
    return facts.withColumn("custom_tag", F.coalesce((F.col("version") == F.col("adsh")).cast("int"), F.lit(0)))


def standard_facts(facts: DataFrame, forms: Iterable[str] = C.FORMS) -> DataFrame:
    """Standard-tag USD facts with a value, projected to the fact columns, distinct rows."""
    kept = facts.filter(
        (F.col("custom_tag") == 0) & F.col("form").isin(*forms) & F.col("value").isNotNull() & (F.col("uom") == C.UNIT)
    )
    return kept.select(*FACT_KEY, "segments", "value").distinct()


def repair_dates(df: DataFrame, col: str) -> DataFrame:
    """Repair mistyped years of a YYYYMMDD column; the column becomes text."""
    return df.withColumn(col, D.repair_year(F.col(col)))


def parse_dates(df: DataFrame, col: str) -> DataFrame:
    """YYYYMMDD to date; rows without a usable date are dropped."""
    return df.withColumn(col, D.parse_day(F.col(col))).filter(F.col(col).isNotNull())


def date_range(df: DataFrame, col: str, low: str, high: str) -> DataFrame:
    return df.filter(F.col(col).between(F.lit(low).cast("date"), F.lit(high).cast("date")))


def price_range(df: DataFrame, col: str = "close_price", low: float = C.PRICE_RANGE[0], high: float = C.PRICE_RANGE[1]) -> DataFrame:
    return df.filter(F.col(col).between(low, high))


def ticker_gaps(prices: DataFrame, date: str = "date") -> DataFrame:
    """Days since the previous price of the ticker (distinct days, so bounded per ticker)."""
    days = prices.select("ticker", date).distinct()
    prev = F.lag(date).over(Window.partitionBy("ticker").orderBy(date))
    return days.withColumn("gap_start_date", prev).withColumn("gap_days", F.datediff(date, "gap_start_date"))


def broken_tickers(prices: DataFrame, max_gap_days: int, date: str = "date") -> DataFrame:
    """Tickers whose largest gap exceeds the limit, one row per largest gap."""
    w = Window.partitionBy("ticker")
    gaps = ticker_gaps(prices, date).withColumn("max_gap_days", F.max("gap_days").over(w))
    hit = gaps.filter((F.col("gap_days") == F.col("max_gap_days")) & (F.col("max_gap_days") > max_gap_days))
    return hit.select("ticker", "max_gap_days", "gap_start_date", F.col(date).alias("gap_end_date"))


def continuous_tickers(prices: DataFrame, max_gap_days: int, date: str = "date") -> DataFrame:
    """Prices of tickers without a gap above the limit."""
    bad = broken_tickers(prices, max_gap_days, date).select("ticker").distinct()
    return prices.join(bad, "ticker", "left_anti")


def missing_months(monthly: DataFrame, keys: Sequence[str] = ("cik", "ticker"), month: str = "year_month") -> DataFrame:
    """Series whose months are not consecutive, with the missing months as text.

    Works on one row per (series, month); a month held twice breaks the series too.
    """
    months = monthly.groupBy(*keys, month).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(month)
    step = months.withColumn("_prev", F.lag(month).over(w)).withColumn("_gap", F.col(month) - F.col("_prev"))
    holes = F.when(F.col("_gap") > 1, F.sequence(F.col("_prev") + 1, F.col(month) - 1)).otherwise(F.array().cast("array<int>"))
    per = step.groupBy(*keys).agg(
        F.max(F.coalesce(F.col("_gap") != 1, F.lit(False)) | (F.col("_n") > 1)).alias("_bad"),
        F.flatten(F.sort_array(F.collect_list(holes))).alias("_holes"),
    )
    labels = F.transform("_holes", lambda m: D.month_label(m))
    return per.filter("_bad").select(*keys, F.array_join(labels, ",").alias("missing_months"))


def complete_series(monthly: DataFrame, keys: Sequence[str] = ("cik", "ticker"), month: str = "year_month") -> DataFrame:
    """Rows of series without a missing or repeated month."""
    return monthly.join(missing_months(monthly, keys, month).select(*keys), list(keys), "left_anti")


def eligible_companies(features: DataFrame, trends: DataFrame, min_quarters: int = 4, single_ticker: bool = True):
    """Both tables cut to companies with one ticker and enough distinct periods."""
    if single_ticker:
        one = trends.groupBy("cik").agg(F.count_distinct("ticker").alias("_n")).filter("_n = 1").select("cik")
        features, trends = features.join(one, "cik", "left_semi"), trends.join(one, "cik", "left_semi")
    long = features.groupBy("cik").agg(F.count_distinct("period").alias("_n")).filter(F.col("_n") >= min_quarters).select("cik")
    return features.join(long, "cik", "left_semi"), trends.join(long, "cik", "left_semi")


def standardize_columns(df: DataFrame, reference: Sequence[str], keep_extra: bool = False) -> DataFrame:
    """Columns of the reference in its order, missing ones NULL; extras dropped or kept at the end."""
    cols = [F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("double").alias(c) for c in reference]
    extra = [F.col(f"`{c}`") for c in df.columns if c not in reference] if keep_extra else []
    return df.select(*cols, *extra)


def suffix_columns(columns: Iterable[str], suffixes: Iterable[str]) -> list[str]:
    """Names ending in one of the suffixes, in table order."""
    return [c for c in columns if c.endswith(tuple(suffixes))]


def feature_columns(df: DataFrame, strategy: str = "all", threshold: float = C.COMPLETENESS_STRATEGY_MIN) -> list[str]:
    """Feature names by strategy: all, completeness (share of rows filled), current, change.

    Completeness reads one aggregate row; everything else looks at names only. Without rows every
    share is undefined and no column goes.
    """
    names = [c for c in df.columns if c.endswith(("_current", "_augment")) or "_change" in c]
    if strategy == "all":
        return names
    if strategy == "current":
        return [c for c in names if c.endswith("_current")]
    if strategy == "change":
        return [c for c in names if "_change" in c]
    if strategy == "completeness":
        row = df.agg(F.count("*").alias("_n"), *[F.count(f"`{c}`").alias(c) for c in names]).first()
        return [c for c in names if not row["_n"] or row[c] / row["_n"] >= threshold]
    raise ValueError(f"unknown strategy {strategy}")


def keep_important(df: DataFrame, ranking: DataFrame, k: int, is_feature=None) -> DataFrame:
    """Non-feature columns plus the k most important features of `ranking(rank, feature)`."""
    is_feature = is_feature or (lambda c: c.endswith(("_current", "_augment")) or "_change" in c)
    top = {r["feature"] for r in ranking.orderBy("rank", "feature").limit(k).select("feature").collect()}
    return df.select(*[f"`{c}`" for c in df.columns if not is_feature(c) or c in top])


def drop_constant(train: DataFrame, test: DataFrame, features: Sequence[str]):
    """Drop features with zero variance in train from both frames; undefined variance stays."""
    row = train.agg(*[F.var_samp(f"`{c}`").alias(c) for c in features]).first()
    flat = [c for c in features if row[c] == 0]
    return train.drop(*flat), test.drop(*flat)


def medians(df: DataFrame, features: Sequence[str]) -> dict[str, float | None]:
    """Exact median per feature (one number each on the driver)."""
    tall = df.select(*[clean(F.col(f"`{c}`")).alias(c) for c in features]).unpivot([], list(features), "feature", "value")
    rows = exact_quantiles(tall, ["feature"], "value", {"median": 0.5}).collect()
    found = {r["feature"]: r["median"] for r in rows}
    return {c: found.get(c) for c in features}


def impute_median(train: DataFrame, test: DataFrame, features: Sequence[str]):
    """Infinite and missing features become the train median, 0 when train has no value."""
    fill = medians(train, features)

    def apply(df: DataFrame) -> DataFrame:
        cols = {c: F.coalesce(clean(F.col(f"`{c}`")), F.lit(float(fill[c] or 0.0))) for c in features}
        return df.withColumns(cols)

    return apply(train), apply(test)


def impute_constant(train: DataFrame, test: DataFrame, features: Sequence[str], value: float = 0.0):
    """Missing features become a constant (trees in MLlib take no NULL)."""

    def apply(df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(clean(F.col(f"`{c}`")), F.lit(value)) for c in features})

    return apply(train), apply(test)


def quarter_split(df: DataFrame, cutoff_month: int, label: str = "data_qtr"):
    """Quarters ending up to the cutoff month, and the rest; 'catchup' rows are newer than any quarter."""
    ended = F.coalesce(D.label_end_month(F.col(label)) <= cutoff_month, F.lit(False))
    return df.filter(ended), df.filter(~ended)


def period_split(df: DataFrame, cutoff: int, col: str = "period"):
    """Rows before the cutoff, and from it on."""
    return df.filter(F.col(col) < cutoff), df.filter(F.col(col) >= cutoff)


def tag_contains(df: DataFrame, text: str, col: str = "tag") -> DataFrame:
    """Case-insensitive substring match; NULL does not match."""
    return df.filter(F.lower(F.col(col)).contains(text.lower()))


def lookup(tall: DataFrame, cik: int, period: int, tag: str | None = None, qtrs: int | None = None) -> DataFrame:
    """Filled features of one filing; the filters reach the scan."""
    out = tall.filter((F.col("cik") == cik) & (F.col("period") == period) & F.col("value").isNotNull())
    if tag is not None:
        out = out.filter(F.col("tag") == tag)
    return out if qtrs is None else out.filter(F.col("qtrs") == qtrs)


def trace_filing(sub: DataFrame, num: DataFrame, cik: int, period: int) -> DataFrame:
    """Raw facts of the filings of one company and period."""
    headers = sub.filter((F.col("cik") == cik) & (F.col("period") == period))
    return num.join(headers.select("adsh").distinct(), "adsh", "left_semi")


def company_facts(df: DataFrame, ciks: DataFrame, form: str = "10-Q") -> DataFrame:
    """Rows of one form for a list of companies."""
    return df.filter(F.col("form") == form).join(ciks.select("cik").distinct(), "cik", "left_semi")


def split_by_value(df: DataFrame, train_share: float, by: str, order: str = "bottom", seed: int = 42):
    """Split on whole values of `by`: values in order while their running row count fits the share.

    The train values are a prefix of the order, so one boundary is found on the counted
    values and both sides are plain filters. NULL goes to validation.
    """
    value = F.col(by)
    keyed = {"bottom": [value.asc()], "top": [value.desc()], "random": [_spot([by], seed).asc(), value.asc()]}
    if order not in keyed:
        raise ValueError(f"unknown order {order}")
    total = df.count()
    counts = df.filter(value.isNotNull()).groupBy(by).agg(F.count("*").alias("_n"))
    fits = running(counts, [], keyed[order], {"_cum": F.col("_n")}).filter(F.col("_cum") <= int(total * train_share))
    if order == "random":
        here = F.struct(_spot([by], seed).alias("h"), value.alias("v"))
        last = fits.agg(F.max(here).alias("m")).first()["m"]
        edge = None if last is None else F.struct(F.lit(last["h"]).alias("h"), F.lit(last["v"]).alias("v"))
        inside = F.lit(False) if edge is None else here <= edge
    else:
        last = fits.agg((F.max if order == "bottom" else F.min)(by).alias("m")).first()["m"]
        inside = F.lit(False) if last is None else (value <= F.lit(last) if order == "bottom" else value >= F.lit(last))
    inside = F.coalesce(inside & value.isNotNull(), F.lit(False))
    return df.filter(inside), df.filter(~inside)


def split_by_columns(df: DataFrame, train_share: float, rules: dict[str, str] | None, key: Sequence[str] = ("cik", "period"), seed: int = 42):
    """Split by the first rule `{column: order}` whose column exists, else by a hash of the key."""
    for col, order in (rules or {}).items():
        if col in df.columns:
            return split_by_value(df, train_share, col, order, seed)
    train, rest = hash_split(df, list(key), [train_share, 1 - train_share], seed)
    return train, rest


def _spot(keys: Sequence[str], seed: int) -> Column:
    """A number in [0, 1) from the keys: 32 bits of an MD5, which any engine can repeat."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def hash_split(df: DataFrame, keys: Sequence[str], shares: Sequence[float], seed: int = 42) -> list[DataFrame]:
    """Reproducible split: equal keys land together, whatever the partitioning."""
    spot = _spot(keys, seed)
    edges, low = [], 0.0
    for i, share in enumerate(shares):
        high = 1.0 if i == len(shares) - 1 else low + share
        edges.append((low, high))
        low = high
    return [df.filter((spot >= lo) & (spot < hi)) for lo, hi in edges]


def time_split(df: DataFrame, date: str, share: float = 0.7):
    """Rows dated before the given quantile of the dates, and the rest.

    The exact quantile keeps one counter per distinct day, so its state is bounded.
    """
    day = F.datediff(F.col(date), F.lit("1970-01-01"))
    cut = df.agg(F.percentile(day, F.lit(share)).alias("q")).first()["q"]
    inside = F.coalesce(day < F.lit(cut), F.lit(False))
    return df.filter(inside), df.filter(~inside)
