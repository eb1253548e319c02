"""Dates, months and quarters as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlight import config as C


def month_index(date: Column) -> Column:
    """Months since year 0: arithmetic on it is month arithmetic."""
    return F.year(date) * 12 + F.month(date) - 1


def month_label(idx: Column) -> Column:
    """'YYYY-MM' of a month index."""
    return F.format_string("%04d-%02d", F.floor(idx / 12).cast("int"), (idx % 12 + 1).cast("int"))


def month_end(idx: Column) -> Column:
    """Last calendar day of a month index."""
    return F.last_day(F.make_date(F.floor(idx / 12).cast("int"), (idx % 12 + 1).cast("int"), F.lit(1)))


def shift_month_end(date: Column, months: int | Column) -> Column:
    """Month end `months` away, whatever the day of `date`."""
    return F.last_day(F.add_months(date, months))


def to_int(date: Column) -> Column:
    """YYYYMMDD as int."""
    return F.year(date) * 10000 + F.month(date) * 100 + F.dayofmonth(date)


def repair_year(yyyymmdd: Column) -> Column:
    """Eight-digit texts with a year past 2500 keep only its last two digits, in this century."""
    s = yyyymmdd.cast("string")
    late = (F.length(s) == 8) & (F.substring(s, 1, 4) > "2500") & s.rlike("^[0-9]{8}$")
    return F.when(late, F.concat(F.lit("20"), F.substring(s, 3, 6))).otherwise(s)


def parse_day(yyyymmdd: Column) -> Column:
    """YYYYMMDD as date; NULL when unparsable or beyond what nanosecond timestamps hold.

    The bounds compare as text and the date is cast from ISO text: this runs on raw facts, and
    the cast is far cheaper than a formatted parse.
    """
    s = yyyymmdd.cast("string")
    low, high = C.DATE_MIN.replace("-", ""), C.DATE_MAX.replace("-", "")
    iso = F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2))
    return F.when((F.length(s) == 8) & s.between(low, high), iso.try_cast("date"))


def parse_iso(text: Column) -> Column:
    """ISO date text as date, NULL when unparsable."""
    return text.try_cast("date")


def _nearest(days: Column, bounds) -> Column:
    """Nearest of ascending bounds; the smaller one wins ties."""
    bounds = list(bounds)
    out = F.lit(bounds[-1])
    for low, high in reversed(list(zip(bounds, bounds[1:]))):
        out = F.when(days * 2 <= low + high, F.lit(low)).otherwise(out)
    return out


def round_quarter_days(days: Column) -> Column:
    """Nearest of the six quarter boundaries; values <= 0 pass through."""
    return F.when(days <= 0, days).otherwise(_nearest(days, sorted(C.QUARTER_DAYS)))


def round_quarter_days_fine(days: Column) -> Column:
    """Nearest of eight boundaries, only when it is close enough."""
    near = _nearest(days, C.QUARTER_DAYS_FINE)
    return F.when((days > 0) & (F.abs(near - days) <= C.QUARTER_TOLERANCE_DAYS), near).otherwise(days)


def days_to_quarter(days: Column) -> Column:
    """Quarter number of a rounded day count."""
    out = F.lit(None).cast("int")
    for bound, quarter in C.QUARTER_DAYS.items():
        out = F.when(days == bound, F.lit(quarter)).otherwise(out)
    return out


def frame_to_qtrs(frame: Column, start: Column, end: Column) -> Column:
    """Quarters a fact spans, from its calendar frame or its dates."""
    days = F.datediff(end, start)
    spanned = F.least(F.greatest(F.bround(days / C.DAYS_PER_QUARTER).cast("int"), F.lit(0)), F.lit(4))
    digit = F.regexp_extract(frame, r"Q(\d+)", 1)
    return (
        F.when(frame.endswith("I"), 0)
        .when(days.isNotNull(), F.when(days <= 1, 0).otherwise(spanned))
        .when(frame.endswith("D") & (digit != ""), digit.try_cast("int"))
        .otherwise(0)
    )


def quarter_label(date: Column) -> Column:
    """'2024q1'."""
    return F.concat(F.year(date).cast("string"), F.lit("q"), F.quarter(date).cast("string"))


def label_end_month(label: Column) -> Column:
    """Month index of the last month of a quarter label; NULL for labels like 'catchup'."""
    return F.substring(label, 1, 4).try_cast("int") * 12 + F.substring(label, 6, 1).try_cast("int") * 3 - 1


def quarter_end_int(date: Column) -> Column:
    """YYYYMMDD of the last day of the quarter."""
    q = F.quarter(date)
    return F.year(date) * 10000 + q * 300 + F.when((q == 1) | (q == 4), 31).otherwise(30)
