"""Price files in two header dialects, and dated price batches."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.functions import dates as D
from ledgerlight.functions.text import normalize_name, pad_cik
from ledgerlight.sources.headers import Headers, by_header, files_of, read_named

# fixed values: (date, close) header names of the two dialects, and exchange folder names
DIALECTS = (("<DATE>", "<CLOSE>"), ("Date", "Close"))
EXCHANGE_GLOBS = ("nasdaq_stock*", "nyse_stock*", "nysemkt_stock*")


# exchange and ticker in a file's path: folder and name, or the two partition values of a written table
BY_NAME = r"([^/]+)/([^/]+)\.(?:csv|txt)$"
BY_PARTITION = r"exchange=([^/]+)/file=([^/]+)/[^/]+$"


def _text(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def price_files(spark: SparkSession, path: str) -> list[str]:
    """All `.csv` and `.txt` files below `path`."""
    return files_of(spark, path, recursiveFileLookup="true", pathGlobFilter="*.{csv,txt}")


def _dialect(spark: SparkSession, headers: Headers, date: str, close: str) -> DataFrame:
    rows = read_named(spark, headers, ",", _text(date, close), [date, close])
    return rows.select("file_path", F.col(f"`{date}`").alias("day"), F.col(f"`{close}`").try_cast("double").alias("close_price"))


def read_price_files(spark: SparkSession, path: str, upper: bool = False, layout: str = BY_NAME) -> DataFrame:
    """(ticker, exchange, date, close_price) of all price files below `path`, without a shuffle.

    Each dialect is one scan; ticker and exchange come from the path. Names with `_` or `-`
    (preferred shares) are skipped before their files are opened; unreadable dates become NULL.
    """
    files = [f for f in price_files(spark, path) if (m := re.search(layout, f)) and not re.search("[_-]", m[2])]
    headers = by_header(spark, files, ",")
    rows = reduce(DataFrame.unionByName, [_dialect(spark, headers, *names) for names in DIALECTS]).filter("close_price is not null")
    name = F.regexp_extract(F.url_decode("file_path"), layout, 2)
    return rows.select(
        F.regexp_replace(F.upper(name) if upper else name, r"\.US$", "").alias("ticker"),
        F.regexp_extract(F.url_decode("file_path"), layout, 1).alias("exchange"),
        D.parse_day(F.regexp_replace("day", "-", "")).alias("date"),
        "close_price",
    )


def read_exchanges(spark: SparkSession, base: str, entity: DataFrame) -> DataFrame:
    """Prices of all exchange folders, mapped to companies."""
    return map_exchanges(read_price_files(spark, f"{base}/{{{','.join(EXCHANGE_GLOBS)}}}", upper=True), entity)


def map_exchanges(prices: DataFrame, entity: DataFrame) -> DataFrame:
    """Upper-case tickers mapped to companies, unmapped dropped; `entity` has one row per ticker."""
    named = prices.withColumn("exchange", normalize_name(F.col("exchange")))
    listed = entity.groupBy(F.upper("ticker").alias("ticker")).agg(F.max("cik").alias("cik"))
    return named.join(listed, "ticker")


def read_price_batches(spark: SparkSession, path: str, name: str = "batch_") -> DataFrame:
    """(cik, ticker, date, close_price) of batch files that have the four columns; dates in UTC.

    Batch files carry `batch_` in their path. Timestamps carry their own offset; the session
    runs in UTC.
    """
    wanted = ["cik", "ticker", "Date", "Close"]
    files = [f for f in price_files(spark, path) if name in f]
    rows = read_named(spark, by_header(spark, files, ","), ",", _text(*wanted), wanted)
    out = rows.select(
        F.col("cik").try_cast("long").alias("cik"), "ticker", F.col("Date").try_cast("timestamp").cast("date").alias("date"), F.col("Close").try_cast("double").alias("close_price")
    )
    return out.filter("cik is not null and date is not null and close_price is not null")


def padded(prices: DataFrame) -> DataFrame:
    """Company numbers as ten-digit text, for output."""
    return prices.withColumn("cik", pad_cik(F.col("cik")))
