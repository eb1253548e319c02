"""Walk-forward back-tests: scores month by month, picks and comparison after the last month."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight import config as C
from ledgerlight.operators import portfolio, selection
from ledgerlight.plans.dataset import assemble, join_labels
from ledgerlight.session import durable, side_by_side, table_path

Scorer = Callable[[DataFrame, DataFrame], DataFrame]
KEEP = ("year_month", "cik", "period", "ticker", "price_return")
#: Months that are fitted at a time.
TOGETHER = 4


def _store_month(scores: DataFrame, path: str, month: int) -> None:
    """A month's own folder, so that months stored side by side do not meet."""
    scores.drop("year_month").write.mode("overwrite").parquet(f"{path}/year_month={month}")


def _months_at(spark: SparkSession, path: str) -> dict[int, T.StructType]:
    """Months stored at a path (one small row each) with the table's columns."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return {}
    return {r["year_month"]: df.schema for r in df.select("year_month").distinct().collect()}


def months_between(sizes: Mapping[int, int], start: int | None = None, end: int | None = None) -> list[int]:
    """Months that have rows, from `start` to `end`."""
    return [m for m in sorted(sizes) if (start is None or m >= start) and (end is None or m <= end)]


def _rows_per_month(df: DataFrame) -> dict[int, int]:
    """One small row for each month of the calendar."""
    return {r["year_month"]: r["n"] for r in df.groupBy("year_month").agg(F.count("*").alias("n")).collect()}


def _scores(data: DataFrame, path: str, keep: Sequence[str]) -> DataFrame:
    """The stored months; an empty table if there are none."""
    spark = data.sparkSession
    if have := _months_at(spark, path):
        schema = next(iter(have.values()))
    else:
        kept = [data.schema[c] for c in keep if c in data.columns]
        return spark.createDataFrame([], T.StructType([*kept, T.StructField("y_pred_proba", T.DoubleType())]))
    names = [*[c for c in keep if c in schema.names], *[c for c in schema.names if c not in keep]]
    return spark.read.schema(schema).parquet(path).select(*names)


def walk_forward(
    data: DataFrame, months: Sequence[int] | None, scorer: Scorer, keep: Sequence[str] = KEEP, min_train: int = 1, path: str | None = None,
    start: int | None = None, end: int | None = None, together: int = TOGETHER,
) -> DataFrame:
    """Score each month with a model trained on the months before it.

    `months=None`: every month of the data from `start` to `end`. The dataset is checkpointed once;
    `together` months are fitted at a time. A month's scores replace its partition of the table at
    `path` (a new one in the shared folder unless named). Months that are there already are not
    scored again, so a restart with the same path costs the months under way at most. Months with
    fewer than `min_train` earlier rows are skipped; without any other the result is empty.
    """
    data, spark = durable(data), data.sparkSession
    size = _rows_per_month(data)
    path = path or table_path(spark, "scores")
    have = _months_at(spark, path)
    wanted = months_between(size, start, end) if months is None else [m for m in months if size.get(m, 0)]
    todo = [m for m in wanted if m not in have and sum(n for k, n in size.items() if k < m) >= min_train]

    def one(month: int) -> None:
        scored = scorer(data.filter(F.col("year_month") < month), data.filter(F.col("year_month") == month))
        _store_month(scored.select(*[c for c in keep if c in scored.columns], "y_pred_proba"), path, month)

    side_by_side(spark, todo, one, together, "month")
    return _scores(data, path, keep)


def monthly_rebuild(
    features: DataFrame, trends: DataFrame, months: Sequence[int] | None, scorer: Scorer, min_train: int = C.MIN_TRAIN_ROWS, path: str | None = None,
    start: int | None = None, end: int | None = None, together: int = TOGETHER, **assembly,
) -> DataFrame:
    """Walk forward with datasets rebuilt per month.

    Train features hold only filings of earlier months; the test month's features are compared
    with them as extra history. Months with too few train rows or no test rows are skipped; without
    any other the result is empty. `months`, `start`, `end`, `together` and `path` as in `walk_forward`.
    """
    from ledgerlight.functions import dates as D

    month_of = D.month_index(D.parse_day(F.col("period")))
    features, trends, spark = durable(features), durable(trends), features.sparkSession
    path = path or table_path(spark, "scores")
    have = _months_at(spark, path)
    filed = _rows_per_month(features.select(month_of.alias("year_month")).filter("year_month is not null"))
    wanted = months_between(filed, start, end) if months is None else months

    def one(month: int) -> None:
        before = features.filter(month_of < month)
        train = durable(assemble(before, trends.filter(F.col("year_month") < month), **assembly))
        test = durable(assemble(features.filter(month_of == month), trends.filter(F.col("year_month") == month), history=before, **assembly))
        if train.count() < min_train or test.isEmpty():
            return
        out = scorer(train, test)
        _store_month(out.select(*[c for c in KEEP if c in out.columns], "y_pred_proba"), path, month)

    side_by_side(spark, [m for m in wanted if m not in have], one, together, "month")
    return _scores(join_labels(features.limit(0), trends.limit(0)), path, KEEP)


def evaluate_strategies(scores: DataFrame, long_trends: DataFrame, strategies: Sequence[C.Strategy] = C.STRATEGIES) -> tuple[DataFrame, DataFrame]:
    """(picks of all strategies, their summary with long-term returns)."""
    picks = durable(selection.pick_all(scores, strategies))
    return picks, selection.finalize(picks, long_trends)


def compare_with_benchmark(
    scores: DataFrame, month_prices: DataFrame, index_prices: DataFrame, top_k: int = 10, monthly: float = C.MONTHLY_INVESTMENT,
    start: int | None = None, end: int | None = None,
) -> DataFrame:
    """Buy-and-hold of the top k against monthly buying of one benchmark ticker."""
    if start is None or end is None:
        span = scores.agg(F.min("year_month").alias("a"), F.max("year_month").alias("b")).first()
        start, end = span["a"] if start is None else start, span["b"] if end is None else end
    hold = portfolio.buy_and_hold(scores, month_prices, monthly, top_k)
    return portfolio.against_benchmark(hold, portfolio.dollar_cost_average(index_prices, start, end, monthly))
