"""Entity maps from JSON: company numbers, tickers, names, exchanges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.functions.text import pad_cik

_ENTRY = "map<string, struct<cik_str: bigint, ticker: string, title: string>>"
_POSITIONAL = "struct<fields: array<string>, data: array<array<string>>>"


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file, as text, with its file: documents count in the order of their names."""
    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))


def _document(docs: DataFrame) -> Column:
    return F.col("file") if "file" in docs.columns else F.lit("")


def entity_rows(docs: DataFrame, col: str = "value") -> DataFrame:
    """(document, position, cik, ticker, title) of ticker documents."""
    m = F.from_json(col, _ENTRY)
    rows = docs.select(_document(docs).alias("document"), F.explode(F.map_entries(m)).alias("e"))
    return rows.select("document", F.col("e.key").try_cast("int").alias("position"), F.col("e.value.cik_str").alias("cik"), F.col("e.value.ticker").alias("ticker"), F.col("e.value.title").alias("title"))


def cik_to_ticker(entities: DataFrame) -> DataFrame:
    """One ticker per company: the last listed."""
    return entities.groupBy("cik").agg(F.max_by("ticker", F.struct("document", "position")).alias("ticker")).withColumn("cik_padded", pad_cik(F.col("cik")))


def ticker_to_cik(entities: DataFrame) -> DataFrame:
    """One company per ticker: the last listed."""
    return entities.groupBy("ticker").agg(F.max_by("cik", F.struct("document", "position")).alias("cik"))


def exchange_rows(docs: DataFrame, col: str = "value") -> DataFrame:
    """(ticker, name, exchange) of positional records; the last record of a ticker wins."""
    rows = docs.select(_document(docs).alias("document"), F.posexplode(F.from_json(col, _POSITIONAL)["data"]).alias("position", "r"))
    rows = rows.select("document", "position", *[F.try_element_at("r", F.lit(i)).alias(n) for i, n in ((2, "name"), (3, "ticker"), (4, "exchange"))])
    last = rows.groupBy("ticker").agg(F.max_by(F.struct("name", "exchange"), F.struct("document", "position")).alias("_r"))
    return last.select("ticker", "_r.name", "_r.exchange")
