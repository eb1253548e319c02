"""Sinks: feature quarters and investment records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RETURNS = ("price_return", "price_return_long_term")


def write_features(df: DataFrame, path: str) -> None:
    """Feature rows partitioned by quarter; only the quarters at hand are replaced.

    Rows are brought together by quarter; the rebalance splits a large quarter into as many tasks
    and files as its bytes ask for (the advisory partition size), and joins small ones.
    """
    out = df.hint("rebalance", "data_qtr")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("data_qtr").parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature rows of all quarters; tables from before forms were kept get 'Unknown'."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    form = F.coalesce("form", F.lit("Unknown")) if "form" in df.columns else F.lit("Unknown")
    return df.withColumn("form", form).withColumn("data_qtr", F.col("data_qtr").cast("string"))


def missing_quarters(spark: SparkSession, path: str, wanted: list[str]) -> list[str]:
    """Quarters without stored features; a table that is not there misses all."""
    try:
        # partition values only: one row per quarter
        have = {r["data_qtr"] for r in spark.read.parquet(path).select(F.col("data_qtr").cast("string")).distinct().collect()}
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        have = set()
    return [q for q in wanted if q not in have]


def write_invest_records(picks: DataFrame, path: str) -> None:
    """Picks of all strategies in one table partitioned by strategy, without the returns."""
    kept = picks.drop(*[c for c in RETURNS if c in picks.columns])
    kept.write.mode("overwrite").partitionBy("strategy_name").parquet(path)


def read_invest_records(spark: SparkSession, path: str, strategy: str | None = None) -> DataFrame:
    """Stored picks, of one strategy when named (only its partition is read)."""
    df = spark.read.parquet(path)
    return df if strategy is None else df.filter(F.col("strategy_name") == strategy)


def write_tall(df: DataFrame, table: str, path: str, buckets: int, by: Sequence[str] = ("cik", "period")) -> DataFrame:
    """Tall feature rows as a table at `path`, bucketed and sorted by report; returns it.

    Aggregates by report, and diffs of two tables with equally many buckets
    (`reconcile.value_diff`), then need no shuffle. Choose the buckets so that one fits a task.
    """
    spread = df.repartition(buckets, *by)
    spread.write.mode("overwrite").bucketBy(buckets, *by).sortBy(*by).format("parquet").option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)
