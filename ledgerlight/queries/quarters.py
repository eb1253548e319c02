"""Statistics kept for each data quarter (A01, A15, A18, A19, A29, X13, X14 from stored quarters).

Each query stores all quarters but the newest, then the newest on its own, and answers from what is
stored; the SQL is that of the query over all rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight import fixtures as X
from ledgerlight.functions import dates as D
from ledgerlight.operators import features, quarterly
from ledgerlight.queries import scalars  # noqa: F401  registers the SQL of x13 and x14
from ledgerlight.queries.aggregates import _A15, _ratios
from ledgerlight.queries.registry import ORACLES, query, rounded
from ledgerlight.session import durable, table_path
from ledgerlight.sources.sinks import write_features


def _quarters(df):
    """Names of the data quarters, in their order: one for each three months."""
    return sorted(r["data_qtr"] for r in df.select("data_qtr").distinct().collect())


def _stored_ratios(spark, sf):
    """(ratios of all quarters, path of their stored values)."""
    wide = durable(_ratios(spark, sf))
    tall = features.unpivot_ratios(wide, ["data_qtr"]).withColumnRenamed("ratio", "feature")
    path, quarters = table_path(spark, "ratios"), _quarters(wide)
    quarterly.add_values(tall, path, quarters[:-1])
    quarterly.add_values(tall, path, quarters[-1:])
    return wide, path


def _stored_sets(spark, df, keys):
    """Company sets by quarter, read back."""
    df, path = durable(df), table_path(spark, "companies")
    newest = F.col("data_qtr") == _quarters(df)[-1]
    for part in (df.filter(~newest), df.filter(newest)):
        write_features(quarterly.company_sets(part, keys), path)
    return spark.read.parquet(path)


def _same(key):
    """The SQL of the query over all rows."""
    return {"sql": ORACLES[key]}


@query("a19_stored", **_same("a19"))
def a19_stored(spark, sf):
    return rounded(quarterly.stored_outlier_report(spark, _stored_ratios(spark, sf)[1]), 4)


@query("a29_stored", **_same("a29"))
def a29_stored(spark, sf):
    path = _stored_ratios(spark, sf)[1]
    med = quarterly.stored_quantiles(spark, path, {"median_value": 0.5}).drop("n")
    return rounded(quarterly.stored_moments(spark, path).join(med, "feature").withColumnRenamed("feature", "ratio"), 4)


@query("x13_stored", **_same("x13"))
def x13_stored(spark, sf):
    wide, path = _stored_ratios(spark, sf)
    return features.expected_range_flag(wide, quarterly.stored_bounds(spark, path)).select("cik", "period", "flag_outlier")


@query("x14_stored", **_same("x14"))
def x14_stored(spark, sf):
    wide, path = _stored_ratios(spark, sf)
    return features.extreme_flag(wide, quarterly.stored_bounds(spark, path)).select("cik", "period", "flag_outlier")


@query("a01_stored", **_same("a01"))
def a01_stored(spark, sf):
    return quarterly.tag_stats(_stored_sets(spark, X.facts(spark, sf).select("data_qtr", "tag", "cik", "adsh"), ["tag"]))


@query("a15_stored", **_same("a15"))
def a15_stored(spark, sf):
    f = X.metric_facts(spark, sf, by_customer=True).select("data_qtr", "form", "tag", "cik", "adsh")
    return rounded(quarterly.tag_population(_stored_sets(spark, f, ["form", "tag"]), _A15))


@query("a18_stored", **_same("a18"))
def a18_stored(spark, sf):
    s = X.sub_fine(spark, sf).select(D.quarter_label(F.col("filed")).alias("data_qtr"), "form", "cik", "adsh")
    return quarterly.form_overlap(_stored_sets(spark, s, ["form"]))
