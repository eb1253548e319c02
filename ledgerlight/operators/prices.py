"""Daily prices to month-end series and forward-return labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight import config as C
from ledgerlight.functions import dates as D
from ledgerlight.functions.numeric import safe_divide
from ledgerlight.operators.ordered import last_known


def month_end_prices(prices: DataFrame, keys: Sequence[str] = ("cik", "ticker"), tiebreak: str | None = None) -> DataFrame:
    """Last price of each series and month; of several rows on that day the smallest tiebreak.

    An aggregate, not a window: daily rows shrink to months before the shuffle.
    """
    tie = F.col(tiebreak) if tiebreak else F.col("close_price")
    last = F.max_by(F.struct("date", "close_price"), F.struct(F.col("date"), -tie))
    g = prices.groupBy(*keys, D.month_index(F.col("date")).alias("year_month")).agg(last.alias("_last"))
    return g.select(*keys, F.col("_last.date").alias("month_end_date"), F.col("_last.close_price").alias("close_price"), "year_month")


def price_trends(monthly: DataFrame, horizons: Sequence[int] = C.HORIZONS, keys: Sequence[str] = ("cik", "ticker")) -> DataFrame:
    """Forward labels for every horizon in one join; rows without a future price go.

    `monthly` holds one row per (series, month). Each price is sent back to the months that
    look ahead to it.
    """
    look = monthly.select(
        *keys, "year_month", F.col("close_price").alias("future_close_price"),
        F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"),
    ).withColumn("year_month", F.col("year_month") - F.col("horizon"))
    now, future = F.col("close_price"), F.col("future_close_price")
    joined = monthly.join(look, [*keys, "year_month"]).filter(future.isNotNull())
    return joined.select(
        *keys, "month_end_date", "year_month", "horizon",
        F.coalesce((future > now).cast("int"), F.lit(0)).alias("trend_up_or_down"),
        F.coalesce((future > now * 1.05).cast("int"), F.lit(0)).alias("trend_5per_up"),
        safe_divide(future, now).alias("price_return"),
        "close_price", "future_close_price",
    )


def normalized_series(prices: DataFrame, key: str = "ticker", date: str = "date", value: str = "close_price") -> DataFrame:
    """Series scaled to 100 at its first point; the first point is an aggregate, joined back."""
    first = prices.groupBy(key).agg(F.min_by(value, F.struct(date, value)).alias("_first"))
    return prices.join(first, key).withColumn("normalized", safe_divide(F.col(value) * 100.0, F.col("_first"))).drop("_first")


def lag_features(df: DataFrame, features: Sequence[str], lags: Sequence[int] = C.LAGS, keys: Sequence[str] = ("cik",), order: Sequence[str] = ("month_end_date",)) -> DataFrame:
    """Add `{feature}_lag_{k}` by rows of a monthly series; keep rows where any feature's smallest lag exists.

    Expects month grain (one row per series and month), so a series is bounded by its months.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    made = {f"{c}_lag_{k}": F.lag(F.col(f"`{c}`"), k).over(w) for k in lags for c in features}
    out = df.withColumns(made)
    first = [f"{c}_lag_{min(lags)}" for c in features]
    return out.filter(F.coalesce(F.lit(None).cast("int"), *[F.when(F.col(f"`{c}`").isNotNull(), F.lit(1)) for c in first]).isNotNull())


def fill_gaps(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ("cik",), order: Sequence[str] = ("month_end_date",)) -> DataFrame:
    """Last known value, else the next one, else 0, per series of any length."""
    seen = last_known(df, keys, order, {f"_back_{c}": c for c in features}, {f"_next_{c}": c for c in features})
    filled = {c: F.coalesce(F.col(f"`_back_{c}`"), F.col(f"`_next_{c}`"), F.lit(0.0)) for c in features}
    return seen.withColumns(filled).select(*[F.col(f"`{c}`") for c in df.columns])


def sequences(
    df: DataFrame, features: Sequence[str], target: str, label: str | None = None, keys: Sequence[str] = ("cik",),
    order: Sequence[str] = ("month_end_date",), shortest: int = C.SEQUENCE_MIN, longest: int = C.SEQUENCE_MAX,
) -> DataFrame:
    """Per series the ordered feature vectors and targets, most recent `longest`, at least `shortest`.

    Gaps are filled from the whole series, so a series is in one task before its old rows go.
    """
    known = df.filter(F.col(target).isNotNull())
    filled = fill_gaps(known, features, keys, order)
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    recent = filled.withColumn("_age", F.row_number().over(newest)).filter(F.col("_age") <= longest)
    item = F.struct(
        (-F.col("_age")).alias("at"), F.array(*[F.col(f"`{c}`").cast("double") for c in features]).alias("x"),
        F.col(target).cast("double").alias("y"), (F.col(label) if label else F.lit(None).cast("int")).alias("label"),
    )
    g = recent.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_s")).filter(F.size("_s") >= shortest)
    return g.select(
        *keys, F.size("_s").alias("length"), F.transform("_s", lambda s: s["x"]).alias("features"),
        F.transform("_s", lambda s: s["y"]).alias("targets"), F.element_at("_s", -1)["label"].alias("last_label"),
    )


def moving_average(df: DataFrame, target: str, keys: Sequence[str] = ("cik",), order: Sequence[str] = ("month_end_date",), window: int = C.MOVING_AVERAGE_WINDOW, leaky: bool = True) -> DataFrame:
    """Mean of the last `window` targets; `leaky=False` leaves the current row out."""
    w = Window.partitionBy(*keys).orderBy(*order)
    frame = w.rowsBetween(-(window - 1), 0) if leaky else w.rowsBetween(-window, -1)
    return df.withColumn("moving_average", F.avg(target).over(frame))
