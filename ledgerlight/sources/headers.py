"""Delimited files read by column name, each by its own header line."""

from __future__ import annotations

import csv
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Files by their column names.
Headers = Mapping[tuple[str, ...], Sequence[str]]


def files_of(spark: SparkSession, path: str | list[str], **options: str) -> list[str]:
    """Files behind a path or pattern, as Spark lists them."""
    found = spark.read.options(**options).text(path).inputFiles()
    return sorted(unquote(f) for f in found)


def first_lines(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """line, files: the different first lines, each with the files that begin with it.

    The first block of every file is read in tasks, which keep one line for each file.
    """
    lines = spark.read.text(list(files)).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    heads = lines.filter("at = 0").groupBy("file").agg(F.first("value").alias("line"))  # one task has a file's first block, in order
    return heads.groupBy("line").agg(F.collect_list("file").alias("files"))


def by_header(spark: SparkSession, files: Iterable[str], sep: str) -> dict[tuple[str, ...], list[str]]:
    """Files grouped by their column names; empty files drop out.

    No file is opened here: the driver gets a row for each different header, with names of files
    it has listed before. Names may be quoted and then hold the separator.
    """
    out: dict[tuple[str, ...], list[str]] = {}
    if files := list(files):
        for r in first_lines(spark, files).collect():
            line = r["line"].lstrip("\ufeff")
            if line.strip():
                out.setdefault(tuple(next(csv.reader([line], delimiter=sep))), []).extend(unquote(f) for f in r["files"])
    return {names: sorted(group) for names, group in out.items()}


def read_named(spark: SparkSession, headers: Headers, sep: str, shape: T.StructType, needed: Iterable[str] = ()) -> DataFrame:
    """The columns of `shape` from all files, each read by its own header, and `file_path`.

    Absent columns are NULL, others are not parsed; files without the `needed` columns are left
    out. One scan per different header.
    """
    needed = set(needed)
    parts = []
    for names, group in sorted(headers.items()):
        if not needed <= set(names):
            continue
        known = {f.name: f.dataType for f in shape.fields}
        full = T.StructType([T.StructField(n, known.get(n, T.StringType())) for n in names])
        df = spark.read.csv(list(group), sep=sep, header=True, schema=full, mode="PERMISSIVE")
        cells = [f"`{n}`" if n in names else f"cast(null as {t.simpleString()}) as `{n}`" for n, t in known.items()]
        parts.append(df.selectExpr(*cells, "_metadata.file_path as file_path"))
    if not parts:
        return spark.createDataFrame([], T.StructType([*shape.fields, T.StructField("file_path", T.StringType())]))
    return reduce(DataFrame.unionByName, parts)
