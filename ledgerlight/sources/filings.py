"""Tab-separated filing bundles: headers, facts, quarters, catch-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.functions.text import dataset_key
from ledgerlight.operators.clean import drop_refiled, flag_custom_tags
from ledgerlight.operators.ordered import keep_first
from ledgerlight.schema import NUM, SUB
from ledgerlight.sources.headers import by_header, files_of, read_named

QUARTER_GLOB = "[0-9][0-9][0-9][0-9][qQ][1-4]"
QUARTER_DIR = r"[/=](\d{4}[qQ][1-4])/"


def read_tsv(spark: SparkSession, path: str, shape: T.StructType) -> DataFrame:
    """Typed columns of `shape` by the header of each file, and `file_path`; blanks are NULL."""
    return read_named(spark, by_header(spark, files_of(spark, path), "\t"), "\t", shape)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Filing headers."""
    return read_tsv(spark, path, SUB).drop("file_path")


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Numeric facts."""
    return read_tsv(spark, path, NUM).drop("file_path")


def _with_quarter(df: DataFrame) -> DataFrame:
    return df.withColumn("data_qtr", F.lower(F.regexp_extract("file_path", QUARTER_DIR, 1))).drop("file_path")


def read_quarters(spark: SparkSession, base: str, quarters: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(headers, facts) of all quarter folders, or of the named ones only, with `data_qtr`.

    The folder pattern is part of the path, so other folders are not even listed.
    """
    part = QUARTER_GLOB if quarters is None else "{" + ",".join(quarters) + "}"
    return read_quarter_files(spark, f"{base}/{part}/sub.txt", f"{base}/{part}/num.txt")


def read_quarter_files(spark: SparkSession, sub_glob: str, num_glob: str) -> tuple[DataFrame, DataFrame]:
    """(headers, facts) of two path patterns whose folders name the quarter."""
    return _with_quarter(read_tsv(spark, sub_glob, SUB)), _with_quarter(read_tsv(spark, num_glob, NUM))


def load_quarters(spark: SparkSession, base: str, quarters: list[str] | None = None) -> DataFrame:
    """Facts of all quarter folders, joined with their headers."""
    return join_quarters(*read_quarters(spark, base, quarters))


def join_quarters(sub: DataFrame, num: DataFrame) -> DataFrame:
    """Facts joined with their headers and flagged for custom tags, all quarters at once.

    Submissions of a key filed more than once are dropped per quarter, as in a quarterly load.
    """
    kept = drop_refiled(sub, ("cik", "form", "period", "data_qtr"))
    return flag_custom_tags(num.join(kept, ["adsh", "data_qtr"]))


def load_catchup(spark: SparkSession, base: str, sub_glob: str = "*/sub.txt", num_glob: str = "*/num.txt") -> DataFrame:
    """Per-filing bundles `<base>/<filing>/{sub,num}.txt`, joined; numbers that do not parse are NULL."""
    text_sub = T.StructType([T.StructField(f.name, T.StringType()) for f in SUB.fields])
    text_num = T.StructType([T.StructField(f.name, T.StringType()) for f in NUM.fields])
    sub = read_tsv(spark, f"{base}/{sub_glob}", text_sub).drop("file_path")
    num = read_tsv(spark, f"{base}/{num_glob}", text_num).drop("file_path")
    sub = sub.withColumns({"cik": F.col("cik").try_cast("long"), "period": F.col("period").try_cast("int")})
    num = num.withColumns({"ddate": F.col("ddate").try_cast("int"), "qtrs": F.col("qtrs").try_cast("int"), "value": F.col("value").try_cast("double")})
    return num.join(sub, "adsh")


def upsert_index(index: DataFrame, new: DataFrame, time: str = "caught_up_at") -> DataFrame:
    """Index rows with the new ones added; the newest row of a filing stays."""
    both = index.unionByName(new, allowMissingColumns=True)
    return keep_first(both.withColumn("_t", F.col(time).cast("timestamp").cast("double")), ["adsh"], [-F.col("_t")]).drop("_t")


def write_bundles(sub: DataFrame, num: DataFrame, base: str, batch: str) -> None:
    """Append headers and facts of a catch-up batch, partitioned by batch.

    One partition per batch instead of a folder per filing keeps file counts bounded.
    """
    for name, df in (("sub", sub), ("num", num)):
        df.withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("batch").parquet(f"{base}/{name}")


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text with a header."""
    df.write.mode("errorifexists").csv(path, sep="\t", header=True)


def quarter_labels(spans: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Quarter labels from the first quarter of the start year to the quarter of the end date."""
    steps = F.sequence(F.trunc(start, "year"), F.trunc(end, "quarter"), F.expr("interval 3 months"))
    q = spans.select(F.explode(steps).alias("_d"))
    return q.select(F.concat(F.year("_d").cast("string"), F.lit("q"), F.quarter("_d").cast("string")).alias("label")).distinct()


def datasets_by_recency(names: DataFrame, col: str = "name") -> DataFrame:
    """Dataset names newest first, with their sort key."""
    return names.withColumn("recency", dataset_key(F.col(col))).orderBy(F.desc("recency"), F.asc(col))
