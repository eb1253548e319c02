"""Training datasets: features with ratios and gradients, joined with forward labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight import config as C
from ledgerlight.functions import dates as D
from ledgerlight.operators import features as R
from ledgerlight.operators.clean import standardize_columns

LABELS = ("trend_up_or_down", "trend_5per_up", "price_return", "close_price", "future_close_price")


def join_labels(features: DataFrame, trends: DataFrame) -> DataFrame:
    """Features with the labels of their month; several tickers of a company fan out."""
    month = D.month_index(D.parse_day(F.col("period")))
    return features.withColumn("year_month", month).join(trends, ["cik", "year_month"])


def assemble(
    features: DataFrame,
    trends: DataFrame,
    history: DataFrame | None = None,
    quarters: Sequence[int] | None = C.GRADIENT_QUARTERS,
    ratios: bool = True,
    drop_outliers: bool = True,
) -> DataFrame:
    """Dedupe, ratios, gradients, hard-limit filter, labels: one lazy plan."""
    if history is not None:
        history = standardize_columns(history, features.columns)
    out = R.dedupe_filings(features)
    if ratios:
        out = R.ratio_features(out)
        history = R.ratio_features(R.dedupe_filings(history)) if history is not None else None
    if quarters:
        out = R.gradients(out, quarters, C.GRADIENT_SUFFIXES, history)
    if drop_outliers and ratios:
        out = R.hard_limit_flag(out).filter(~F.col("flag_outlier")).drop("flag_outlier")
    return join_labels(out, trends)


def benchmark_features(features: DataFrame, ratios: bool = True) -> DataFrame:
    """Deduped features with ratios, the input of industry benchmarks."""
    out = R.dedupe_filings(features)
    return R.ratio_features(out) if ratios else out
