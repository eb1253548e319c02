"""From joined facts to the stored feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight import config as C
from ledgerlight.operators import facts as A
from ledgerlight.operators import features as R
from ledgerlight.operators.clean import flag_custom_tags
from ledgerlight.sources.sinks import missing_quarters, read_features, write_features


def choose_tags(facts: DataFrame, k: int = C.TOP_TAGS) -> list[str]:
    """The k most popular tags."""
    return [r["tag"] for r in A.top_tags(A.tag_stats(facts), k).orderBy("rank").collect()]


def build_features(facts: DataFrame, tags: Sequence[str], n_history: int = C.HISTORY_QUARTERS, by: str = "data_qtr") -> DataFrame:
    """Wide features of every quarter and form in one plan.

    The quarter is part of every key, so one build of all quarters has the rows of building
    quarter by quarter. Item names are the chosen tags at all quarter counts, known without a
    look at the facts; without history columns only the newest values are aggregated.
    """
    rows = A.segment_summary(facts.withColumn("data_qtr", F.col(by)), by=["data_qtr"])
    values = A.history_comparisons(rows, ["data_qtr"]) if n_history else A.newest_values(rows, ["data_qtr"])
    names = [f"{t}_{q}qtrs" for t in tags for q in range(C.MAX_QTRS + 1)]
    return A.pivot_features(values, tags, n_history, names, ["data_qtr"])


def build_tall_features(facts: DataFrame, tags: Sequence[str] | None = None, by: str = "data_qtr") -> DataFrame:
    """The same values kept tall: (cik, period, form, tag, qtrs, value, data_qtr)."""
    rows = A.segment_summary(facts.withColumn("data_qtr", F.col(by)), by=["data_qtr"])
    return A.tall_features(A.newest_values(rows, ["data_qtr"]), tags, ["data_qtr"])


def store_new_quarters(facts: DataFrame, path: str, tags: Sequence[str], n_history: int = C.HISTORY_QUARTERS) -> DataFrame:
    """Build and store the quarters not stored yet; returns the whole table."""
    spark = facts.sparkSession
    wanted = sorted(r["data_qtr"] for r in facts.select("data_qtr").distinct().collect())
    todo = missing_quarters(spark, path, wanted)
    if todo:
        write_features(build_features(facts.filter(F.col("data_qtr").isin(*todo)), tags, n_history), path)
    return read_features(spark, path)


def simplify(features: DataFrame, mapped: DataFrame, min_pct: float = C.MIN_COMPLETENESS) -> tuple[DataFrame, DataFrame]:
    """(completeness ranking, simplified table)."""
    ranking = A.completeness(features)
    return ranking, A.completeness_filter(features, ranking, mapped, min_pct)


def catchup_features(joined: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Features of incremental filings: latest values only, quarter 'catchup'."""
    now = A.latest_values(joined)
    empty = F.array()
    history = now.withColumns({"quarter_intervals": empty.cast("array<int>"), "percentage_diffs": empty.cast("array<double>")})
    return A.pivot_features(history, tags, 0).withColumn("data_qtr", F.lit("catchup"))


def filing_ratios(bulk: DataFrame, form: str, tags: Sequence[str], ratios: Sequence[C.Ratio] = C.RATIOS, cik: str = "cik") -> DataFrame:
    """Ratios of the most recent period of each company, from facts in the bulk shape.

    The period is the fact date, blank segments mean company level, only USD counts.
    """
    shaped = flag_custom_tags(bulk.withColumn("adsh", F.col("adsh").cast("string"))).select(
        F.col(cik).alias("cik"), "tag", "ddate", "qtrs", F.nullif(F.trim(F.col("segments")), F.lit("")).alias("segments"), "value", "uom", "custom_tag",
        F.col("ddate").alias("period"), F.lit(form).alias("form"),
    )
    names = sorted(f"{t}_{q}qtrs" for t in tags for q in (0, 1))
    wide = A.pivot_features(A.history_comparisons(A.segment_summary(shaped, [form])), tags, 0, names)
    return _company_ratios(wide, ratios)


def _company_ratios(wide: DataFrame, ratios: Sequence[C.Ratio]) -> DataFrame:
    """Definition ratios of each company's newest period.

    A tag is read at quarter 1 when the company reports it so in any period, else at quarter
    0; both the choice and the newest row come out of one aggregate per company.
    """
    tags = sorted({t for r in ratios for t in r.tags if f"{t}_1qtrs_current" in wide.columns})
    cells = [f"{t}_{q}qtrs_current" for t in tags for q in (0, 1)]
    newest = F.max_by(F.struct("period", "form", *[f"`{c}`" for c in cells]), "period").alias("_r")
    ever = [F.count(f"`{t}_1qtrs_current`").alias(f"_n_{t}") for t in tags]
    one = wide.groupBy("cik").agg(newest, *ever)
    value = [F.when(F.col(f"_n_{t}") > 0, F.col("_r")[f"{t}_1qtrs_current"]).otherwise(F.col("_r")[f"{t}_0qtrs_current"]).alias(f"{t}_1qtrs_current") for t in tags]
    out = R.defined_ratios(one.select("cik", "_r.period", "_r.form", *value), ratios)
    return out.select("cik", "period", "form", *[c for c in out.columns if c.endswith("_augment")])
