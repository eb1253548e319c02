"""Streams (T01-T03) drained over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight import fixtures as X
from ledgerlight.queries.registry import query, rounded
from ledgerlight.session import table_path
from ledgerlight.streaming import catchup


def _as_stream(spark, df, name):
    """Write a derived table to the shared folder and stream it back, one file at a time."""
    path = table_path(spark, name)
    df.write.parquet(path)
    return catchup.read_stream(spark, path, "*.parquet", df.schema, 4)


@query("t01", "sub_fine", "select adsh, cik, form, period from sub_fine where not (period < 20000101 or sic = 'BUILDING')")
def t01(spark, sf):
    s = X.sub_fine(spark, sf)
    head = s.select("adsh", "cik", "form", "period", F.to_timestamp("filed").alias("filed_at"))
    known = table_path(spark, "known")
    s.filter("period < 20000101 or sic = 'BUILDING'").select("adsh").write.parquet(known)
    # the newest files come first, and everything comes twice
    path = table_path(spark, "headers")
    head.unionByName(head).repartitionByRange(8, F.desc("filed_at")).write.parquet(path)
    stream = catchup.read_stream(spark, path, "*.parquet", head.schema, 4)
    return catchup.store_new_filings(stream, known, table_path(spark, "new-filings")).select("adsh", "cik", "form", "period")


_LATEST = "select cik, period, form, tag, qtrs, max(ddate) as crt_ddate, round(max((ddate, value))[2], 6) as crt_value from facts group by all"


@query("t02", "facts", _LATEST)
def t02(spark, sf):
    f = X.facts(spark, sf).select("cik", "period", "form", "tag", "qtrs", "ddate", "value")
    stream = catchup.latest_facts(_as_stream(spark, f, "facts"))
    return rounded(catchup.drain(stream, "latest-facts", "update", ["cik", "period", "form", "tag", "qtrs"]))


@query("t02_upsert", "facts", _LATEST)
def t02_upsert(spark, sf):
    """The same as a keyed table of which a batch rewrites the parts it touches."""
    keys = ["cik", "period", "form", "tag", "qtrs"]
    f = X.facts(spark, sf).select(*keys, "ddate", "value")
    table = catchup.upsert_latest(_as_stream(spark, f, "facts"), table_path(spark, "upserted"), keys, ["ddate"], 8)
    return rounded(table.withColumnsRenamed({"ddate": "crt_ddate", "value": "crt_value"}))


@query("t03", sql="""with m as (select max(ts) as last from events), w as (select user_id, date_trunc('day', ts) as period_start, arg_max(value, (ts, event_id)) as last_value, count(*) as rows from events group by all)
  select user_id, cast(period_start as date) as day, last_value, rows from w, m where period_start + interval 1 day <= last - interval 1 hour""")
def t03(spark, sf):
    schema = X.table(spark, sf, "events").schema
    stream = catchup.read_stream(spark, sf, "events.parquet", schema)
    out = catchup.drain(catchup.period_last(stream, "user_id", "ts", "value", tiebreak="event_id"), "period-last")
    return out.select("user_id", F.col("period_start").cast("date").alias("day"), "last_value", "rows")
