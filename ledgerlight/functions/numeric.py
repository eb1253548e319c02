"""Numbers, labels and scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(value: Column) -> Column:
    """NaN and infinities become NULL."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """NULL on a zero or missing part; negative denominators divide as usual."""
    return F.when(denominator != 0, numerator / denominator)


def change(current: Column, past: Column, denominator: str = "previous") -> Column:
    """Relative change over the previous value (gradients) or over the current one (history)."""
    if denominator not in ("previous", "current"):
        raise ValueError("denominator is 'previous' or 'current'")
    return safe_divide(current - past, past if denominator == "previous" else current)


def three_class(value: Column, good: float = 0.05, bad: float = -0.05) -> Column:
    """'good' at or above one limit, 'bad' at or below the other, else 'mediocre'."""
    return F.when(value >= good, "good").when(value <= bad, "bad").when(value.isNotNull(), "mediocre")


def expected_score(p_bad: Column, p_good: Column) -> Column:
    """Expected class value in [-1, 1] moved to [0, 1]."""
    return (p_good - p_bad + 1.0) / 2.0


def minmax_score(value: Column, low: Column, high: Column) -> Column:
    """Position in the training range, clipped to [0, 1]; a flat range centres on 0.5."""
    raw = F.when(high > low, safe_divide(value - low, high - low)).otherwise(value - low + 0.5)
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over rows with both values, an aggregate; NULL where either is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x).cast("double"), F.when(both, y).cast("double")
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(r.isNotNull(), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))


def is_close(value: Column, reference: Column, rtol: float, atol: float) -> Column:
    return F.abs(value - reference) <= atol + rtol * F.abs(reference)
