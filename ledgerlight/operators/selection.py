"""Picking companies by prediction score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight import config as C
from ledgerlight.operators.ordered import exact_quantiles, global_row_number, top_rows

SCORE_ORDER = ("y_pred_proba", "cik", "ticker")


def score_order() -> list[Column]:
    """Score descending, then company and ticker: a total order."""
    return [F.desc("y_pred_proba"), F.asc("cik"), F.asc("ticker")]


def rank_scores(scores: DataFrame) -> DataFrame:
    """Rank of every row within its month, whatever the month's size."""
    return global_row_number(scores, ["year_month"], score_order())


def _within(s: C.Strategy) -> Column:
    keep = F.lit(True)
    if s.low is not None:
        keep = keep & (F.col("y_pred_proba") >= s.low)
    if s.high is not None:
        keep = keep & (F.col("y_pred_proba") <= s.high)
    return keep


def pick(scores: DataFrame, strategy: C.Strategy) -> DataFrame:
    """Rows a strategy selects in every month, with their rank among them."""
    rows = scores.filter(_within(strategy))
    if strategy.limit is not None:
        return top_rows(rows, ["year_month"], score_order(), strategy.limit)
    return rank_scores(rows)


def pick_all(scores: DataFrame, strategies: Sequence[C.Strategy] = C.STRATEGIES) -> DataFrame:
    """All strategies over all months in two passes, tagged `strategy_name`.

    Limited strategies keep few rows per month and are cut before the shuffle; open ones are
    ranked together over range blocks.
    """

    def tagged(group: Sequence[C.Strategy]) -> DataFrame:
        names = F.filter(F.array(*[F.when(_within(s), F.lit(s.name)) for s in group]), lambda x: x.isNotNull())
        return scores.withColumn("strategy_name", F.explode(names))

    parts = []
    limited = [s for s in strategies if s.limit is not None]
    if limited:
        widest = max(s.limit for s in limited)
        limit = F.lit(0)
        for s in limited:
            limit = F.when(F.col("strategy_name") == s.name, s.limit).otherwise(limit)
        ranked = top_rows(tagged(limited), ["strategy_name", "year_month"], score_order(), widest)
        parts.append(ranked.filter(F.col("rank") <= limit))
    open_ended = [s for s in strategies if s.limit is None]
    if open_ended:
        parts.append(global_row_number(tagged(open_ended), ["strategy_name", "year_month"], score_order()))
    out = parts[0].withColumn("rank", F.col("rank").cast("long"))
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ever_top(scores: DataFrame, k: int) -> DataFrame:
    """Tickers in the top k of any month."""
    return pick(scores, C.Strategy("top", limit=k)).select("ticker").filter(F.col("ticker").isNotNull()).distinct()


def mark_tickers(scores: DataFrame, entity: DataFrame) -> DataFrame:
    """Scores with the ticker of their company; fails when none maps."""
    out = scores.drop("ticker").join(entity.select("cik", "ticker"), "cik")
    if out.isEmpty():
        raise ValueError("no score row maps to a ticker")
    return out


def market_average(df: DataFrame) -> DataFrame:
    """Mean return and rows of each month."""
    return df.groupBy("year_month").agg(F.avg("price_return").alias("market_return"), F.count("*").alias("companies"))


def strategy_average(picks: DataFrame) -> DataFrame:
    """Rows, mean return and score statistics per strategy."""
    s = F.col("y_pred_proba")
    return picks.groupBy("strategy_name").agg(
        F.count("*").alias("picks"), F.avg("price_return").alias("mean_return"), F.avg(s).alias("mean_score"),
        F.stddev(s).alias("std_score"), F.min(s).alias("min_score"), F.max(s).alias("max_score"),
    )


def score_quartiles(picks: DataFrame) -> DataFrame:
    """Exact quartiles of the scores per strategy."""
    return exact_quantiles(picks, ["strategy_name"], "y_pred_proba", {"q1_score": 0.25, "median_score": 0.5, "q3_score": 0.75}).drop("n")


def long_term_returns(picks: DataFrame, trends: DataFrame) -> DataFrame:
    """Picks with their longer-horizon return; matched on the ticker too when both carry it."""
    on = ["cik", "year_month"] + (["ticker"] if "ticker" in picks.columns and "ticker" in trends.columns else [])
    return picks.join(trends.select(*on, F.col("price_return").alias("price_return_long_term")), on)


def finalize(picks: DataFrame, trends: DataFrame) -> DataFrame:
    """Per strategy: picks, short and long mean returns, score statistics."""
    short = strategy_average(picks)
    long = long_term_returns(picks, trends).groupBy("strategy_name").agg(
        F.count("*").alias("with_long_term"), F.avg("price_return_long_term").alias("mean_long_return")
    )
    short = short.join(score_quartiles(picks), "strategy_name", "left")
    return short.join(long, "strategy_name", "left").withColumn("with_long_term", F.coalesce("with_long_term", F.lit(0)))


def benchmark(df: DataFrame, trends: DataFrame, start: int, end: int) -> DataFrame:
    """Market mean returns over start < month <= end, short and long, with counts.

    Each side is reduced per (cik, month) first: the left join's means follow from sums and
    counts, so a company with many rows costs one row.
    """
    inside = df.filter((F.col("year_month") > start) & (F.col("year_month") <= end))
    mine = inside.groupBy("cik", "year_month").agg(F.count("*").alias("n"), F.sum("price_return").alias("s"), F.count("price_return").alias("c"))
    far = trends.groupBy("cik", "year_month").agg(F.count("price_return").alias("fc"), F.sum("price_return").alias("fs"))
    j = mine.join(far, ["cik", "year_month"], "left")
    matched = F.coalesce(F.sum(F.col("n") * F.col("fc")), F.lit(0))
    return j.agg(
        F.try_divide(F.sum("s"), F.sum("c")).alias("short_term_return"),
        F.try_divide(F.sum(F.col("n") * F.col("fs")), matched).alias("long_term_return"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("num_records"),
        matched.alias("num_with_long_term"),
    )
