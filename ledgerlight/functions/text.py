"""Identifiers, tag names and dataset names as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlight import config as C


def pad_cik(cik: Column) -> Column:
    """Ten digits, zero-padded."""
    return F.lpad(cik.cast("string"), 10, "0")


def normalize_name(name: Column) -> Column:
    """Folder or exchange name: lower case, underscores."""
    return F.lower(F.replace(name, F.lit(" "), F.lit("_")))


def split_camel(text: Column) -> Column:
    """Words of a CamelCase name."""
    spaced = F.trim(F.regexp_replace(text, r"(?<!^)(?=[A-Z])", " "))
    return F.split(spaced, r"\s+")


def extract_words(text: Column) -> Column:
    """Lower-case words of a name or phrase; stop words are cut out inside words as well."""
    words = F.split(F.trim(text), r"\s+")
    words = F.when(F.size(words) == 1, split_camel(text)).otherwise(words)
    words = F.flatten(F.transform(words, lambda w: F.split(w, "-")))

    def clean(word: Column) -> Column:
        out = F.regexp_replace(F.lower(word), r"[^\w]", "")
        for stop in C.STOP_WORDS:
            out = F.replace(out, F.lit(stop), F.lit(""))
        return out

    return F.filter(F.transform(words, clean), lambda w: F.length(w) > 0)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length, on lower-cased texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(F.lower(a), F.lower(b)) / longest)


def word_similarity(words: Column, other: Column, similarity: Callable = edit_similarity) -> Column:
    """Mean best match of each word (0.6) plus the share of words matched at 0.7 or better (0.4)."""
    best = F.transform(words, lambda w: F.array_max(F.transform(other, lambda o: similarity(w, o))))
    n = F.size(words)
    mean = F.aggregate(best, F.lit(0.0), lambda acc, s: acc + s) / n
    good = F.size(F.filter(best, lambda s: s >= 0.7)) / n
    score = F.least(mean * 0.6 + good * 0.4, F.lit(1.0))
    return F.when((n > 0) & (F.size(other) > 0), score).otherwise(F.lit(0.0))


def dataset_key(name: Column) -> Column:
    """Sortable key of a dataset name: quarter '2024q2', year '2024', anything else last.

    An all-digit name counts as a year, whatever its length, before it could count as a month.
    """
    quarter = r"^(\d+)q(\d+)$"
    return (
        F.when(name.rlike(quarter), F.struct(
            F.regexp_extract(name, quarter, 1).cast("int").alias("year"),
            F.regexp_extract(name, quarter, 2).cast("int").alias("part"),
            F.lit(0).alias("kind")))
        .when(name.rlike(r"^\d+$"), F.struct(
            name.try_cast("int").alias("year"), F.lit(0).alias("part"), F.lit(1).alias("kind")))
        .otherwise(F.struct(F.lit(0).alias("year"), F.lit(0).alias("part"), F.lit(3).alias("kind")))
    )


FEATURE_NAME = r"^(.+?)(?:_(\d+)qtrs)?_(current|augment|change_q\d+)$"


def feature_tag(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, FEATURE_NAME, 1), F.lit(""))


def feature_qtrs(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, FEATURE_NAME, 2), F.lit("")).cast("int")


def feature_change(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, FEATURE_NAME, 3), F.lit(""))
