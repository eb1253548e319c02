"""Table shapes and the column validator shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _struct(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in cols.items()])


_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()

SUB = _struct(adsh=_S, cik=_L, name=_S, sic=_S, fye=_S, fy=_S, fp=_S, form=_S, period=_I, filed=_I)
NUM = _struct(adsh=_S, tag=_S, version=_S, ddate=_I, qtrs=_I, uom=_S, segments=_S, coreg=_S, value=_D, footnote=_S)
BULK_COLUMNS = [f.name for f in NUM.fields]

FACT_KEY = ["cik", "tag", "ddate", "qtrs", "period", "form"]
HISTORY_KEY = ["cik", "period", "form", "tag", "qtrs"]
FILING_KEY = ["cik", "period", "form"]

_FACT = _struct(val=_D, form=_S, filed=_S, start=_S, end=_S, frame=_S, accn=_S)
_UNITS = _struct(units=T.MapType(_S, T.ArrayType(_FACT)))
COMPANY_FACTS = _struct(facts=T.MapType(_S, T.MapType(_S, _UNITS)))

_COLS = T.ArrayType(_S)
SUBMISSIONS = _struct(
    name=_S,
    tickers=_COLS,
    sic=_S,
    filings=_struct(
        recent=_struct(
            accessionNumber=_COLS, form=_COLS, filingDate=_COLS, reportDate=_COLS,
            acceptanceDateTime=_COLS, primaryDocument=_COLS, isXBRL=T.ArrayType(_I),
        )
    ),
)


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Fail early, with the names, when an operator's input lacks columns."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df
