"""From daily prices to forward-return labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ledgerlight import config as C
from ledgerlight.operators import clean, prices


def month_end_series(
    daily: DataFrame, start: str | None = None, end: str | None = None, max_gap_days: int | None = None,
    low: float = C.PRICE_RANGE[0], high: float = C.PRICE_RANGE[1], tiebreak: str | None = None,
) -> DataFrame:
    """Month-end prices of gapless series within the price range.

    Daily rows shrink to months in the first aggregate; everything after works on months.
    The daily continuity filter runs only when a limit is given.
    """
    if start is not None and end is not None:
        daily = clean.date_range(daily, "date", start, end)
    if max_gap_days is not None:
        daily = clean.continuous_tickers(daily, max_gap_days)
    monthly = clean.complete_series(prices.month_end_prices(daily, tiebreak=tiebreak))
    return clean.price_range(monthly, "close_price", low, high)


def build_trends(daily: DataFrame, horizons: Sequence[int] = C.HORIZONS, **series) -> DataFrame:
    """Forward labels of every horizon."""
    return prices.price_trends(month_end_series(daily, **series), horizons)
