"""Buy-and-hold portfolios over month-end prices.

Windows run on monthly rows only: per ticker at most its months, and per portfolio one row
per month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight import config as C
from ledgerlight.operators.selection import score_order
from ledgerlight.operators.ordered import last_known, top_rows


def buy_and_hold(scores: DataFrame, month_prices: DataFrame, monthly: float = C.MONTHLY_INVESTMENT, top_k: int = 10) -> DataFrame:
    """Portfolio per scored month: split a fixed amount over the priced top k, never sell.

    `month_prices` holds one row per (ticker, year_month). Tickers without a price in a month
    are neither bought nor valued then; the invested sum grows only in months with a purchase.
    """
    best = top_rows(scores, ["year_month"], score_order(), top_k).select("year_month", "ticker")
    price = month_prices.filter(F.col("close_price").isNotNull()).select("ticker", "year_month", F.col("close_price").alias("price"))
    buys = best.join(price.filter("price > 0"), ["ticker", "year_month"])
    split = buys.groupBy("year_month").agg(F.count("*").alias("n"))
    bought = buys.join(split, "year_month").select("ticker", "year_month", (F.lit(monthly) / F.col("n") / F.col("price")).alias("shares"))
    months = scores.select("year_month").distinct()
    # prices of held tickers in scored months, with that month's purchases, one row each
    held = price.join(bought.select("ticker").distinct(), "ticker", "left_semi").join(months, "year_month", "left_semi")
    steps = held.join(bought.groupBy("ticker", "year_month").agg(F.sum("shares").alias("shares")), ["ticker", "year_month"], "left")
    so_far = Window.partitionBy("ticker").orderBy("year_month").rowsBetween(Window.unboundedPreceding, 0)
    owned = steps.withColumn("owned", F.sum("shares").over(so_far)).filter("owned is not null")
    value = owned.groupBy("year_month").agg(F.sum(F.col("owned") * F.col("price")).alias("portfolio_value"), F.count("*").alias("num_stocks"))
    out = months.join(value, "year_month", "left").join(split.select("year_month", F.lit(monthly).alias("spent")), "year_month", "left")
    running = Window.orderBy("year_month").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("total_invested", F.coalesce(F.sum("spent").over(running), F.lit(0.0)))
    return _returns(out.select("year_month", F.coalesce("portfolio_value", F.lit(0.0)).alias("portfolio_value"), "total_invested", F.coalesce("num_stocks", F.lit(0)).alias("num_stocks")))


def _returns(df: DataFrame) -> DataFrame:
    gain = F.when(F.col("total_invested") > 0, (F.col("portfolio_value") / F.col("total_invested") - 1) * 100).otherwise(0.0)
    return df.withColumn("cumulative_return", gain)


def dollar_cost_average(month_prices: DataFrame, start: int, end: int, monthly: float = C.MONTHLY_INVESTMENT) -> DataFrame:
    """The same amount into each ticker every month from start to end, all tickers at once.

    A month without a price buys nothing and shows the last known value.
    """
    inside = month_prices.filter(F.col("year_month").between(start, end)).select("ticker", "year_month", F.col("close_price").alias("price"))
    calendar = inside.select("ticker").distinct().withColumn("year_month", F.explode(F.sequence(F.lit(start), F.lit(end))))
    rows = calendar.join(inside, ["ticker", "year_month"], "left")
    w = Window.partitionBy("ticker").orderBy("year_month").rowsBetween(Window.unboundedPreceding, 0)
    buy = F.when(F.col("price") > 0, F.lit(monthly) / F.col("price"))
    rows = rows.withColumn("_shares", F.coalesce(F.sum(buy).over(w), F.lit(0.0))).withColumn(
        "total_invested", F.coalesce(F.sum(F.when(F.col("price") > 0, F.lit(monthly))).over(w), F.lit(0.0))
    )
    known = F.when(F.col("price").isNotNull(), F.col("_shares") * F.col("price"))
    rows = rows.withColumn("portfolio_value", F.coalesce(F.last(known, True).over(w), F.lit(0.0)))
    return _returns(rows.select("ticker", "year_month", "portfolio_value", "total_invested"))


def carry_forward(df: DataFrame, value: str, keys: list[str], order: str) -> DataFrame:
    """Replace missing values by the last known one of a series of any length."""
    seen = last_known(df, keys, [order], {"_known": value})
    return seen.withColumn(value, F.col("_known")).drop("_known")


def against_benchmark(strategy: DataFrame, bench: DataFrame) -> DataFrame:
    """Strategy and benchmark values side by side per month."""
    b = bench.select("year_month", F.col("portfolio_value").alias("benchmark_value"), F.col("cumulative_return").alias("benchmark_return"))
    return strategy.join(b, "year_month", "left").withColumn("excess_return", F.col("cumulative_return") - F.col("benchmark_return"))
