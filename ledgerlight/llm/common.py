"""Helpers shared by the operators: tables, stored intermediate results, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.session import table_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors.

    The table stays until `discard` or `drop_stored`, because the returned frame reads it lazily.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    _STORED.append(path)
    return out


_STORED: list[str] = []


def discard(*frames: DataFrame) -> None:
    """Delete the tables of these frames of `stored`, when their last reader is done."""
    for df in frames:
        _delete(df.sparkSession, [df.stored_at])


def drop_stored(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> int:
    """Delete the tables `stored` has written in this process, all or those after the first `since`,
    but for that of `keep`; frames reading them end with it."""
    return _delete(spark, [p for p in _STORED[since:] if keep is None or p != keep.stored_at])


def stored_tables() -> int:
    return len(_STORED)


def _delete(spark: SparkSession, paths: list[str]) -> int:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    for p in paths:
        if p in _STORED:
            _STORED.remove(p)
        path = jvm.org.apache.hadoop.fs.Path(p)
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def text_of(col: str) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the frame does not have, made from the given ones."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
