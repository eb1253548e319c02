"""Sources and sinks (S01-S17): text and JSON are derived from the tables, then read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ledgerlight import config as C
from ledgerlight import fixtures as X
from ledgerlight.functions import dates as D
from ledgerlight.operators import explore, selection
from ledgerlight.plans.features import store_new_quarters
from ledgerlight.queries.registry import query, rounded
from ledgerlight.queries.selection import STRATEGY_SQL
from ledgerlight.session import durable, table_path
from ledgerlight.sources import companyfacts, entities, filings, prices, sinks


def _sub_text(spark, sf):
    s = X.sub_fine(spark, sf)
    period = F.when(F.col("adsh") % 11 == 0, None).otherwise(F.col("period"))
    return s.select(
        F.col("adsh").cast("string").alias("adsh"), "cik", "name", "sic", F.lit(None).cast("string").alias("countryba"), F.lit("1231").alias("fye"),
        F.year("filed").cast("string").alias("fy"), F.lit("FY").alias("fp"), "form", period.alias("period"), D.to_int(F.col("filed")).alias("filed"),
    )


def _num_text(spark, sf):
    li = X.table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").cast("string").alias("adsh"), F.concat(F.lit("Tag"), F.col("l_partkey").cast("string")).alias("tag"), F.lit("us-gaap").alias("version"),
        D.to_int(F.col("l_shipdate").cast("date")).alias("ddate"), (F.col("l_linenumber") % 5).alias("qtrs"), F.lit("USD").alias("uom"),
        F.nullif(F.col("l_suppkey") % 4, F.lit(0)).cast("string").alias("segments"), F.lit(None).cast("string").alias("coreg"),
        F.when(F.col("l_quantity") > 1, F.col("l_extendedprice")).alias("value"), F.lit(None).cast("string").alias("footnote"),
    )


_SUB_SQL = """subs as (select cast(adsh as varchar) as adsh, cik, name, sic, form, case when adsh % 11 = 0 then null else period end as period,
  cast(strftime(filed, '%Y%m%d') as int) as filed, year(filed) || 'q' || quarter(filed) as data_qtr, year(filed) as y from sub_fine)"""
_NUM_SQL = """nums as (select cast(l_orderkey as varchar) as adsh, 'Tag' || l_partkey as tag, 'us-gaap' as version, cast(strftime(l_shipdate, '%Y%m%d') as int) as ddate,
  l_linenumber % 5 as qtrs, 'USD' as uom, cast(nullif(l_suppkey % 4, 0) as varchar) as segments, case when l_quantity > 1 then l_extendedprice end as value from lineitem)"""


def _written(spark, df, name, drop):
    """Files in two column orders; the second lacks the column `drop`, which is NULL there."""
    path = table_path(spark, name)
    second = F.pmod(F.xxhash64("adsh"), F.lit(2)) == 1
    filings.write_tsv(df.filter(~second), f"{path}/a")
    filings.write_tsv(df.filter(second).select(*[c for c in reversed(df.columns) if c != drop]), f"{path}/b")
    return f"{path}/*"


@query("s01", "sub_fine", f", {_SUB_SQL} select adsh, cik, name, sic, form, period, filed, cast(y as varchar) as fy from subs")
def s01(spark, sf):
    got = filings.read_headers(spark, _written(spark, _sub_text(spark, sf), "sub", "countryba"))
    return got.select("adsh", "cik", "name", "sic", "form", "period", "filed", "fy")


@query("s02", "", f"with {_NUM_SQL} select adsh, tag, version, ddate, qtrs, uom, segments, round(value, 6) as value from nums")
def s02(spark, sf):
    got = filings.read_facts(spark, _written(spark, _num_text(spark, sf), "num", "footnote"))
    return rounded(got.select("adsh", "tag", "version", "ddate", "qtrs", "uom", "segments", "value"))


def _quarter_folders(spark, sf):
    """Header and fact folders per quarter, tab-separated."""
    base = table_path(spark, "quarters")
    sub = _sub_text(spark, sf).withColumn("q", D.quarter_label(D.parse_day(F.col("filed"))))
    num = _num_text(spark, sf).join(sub.select("adsh", "q"), "adsh")
    for name, df in (("sub", sub), ("num", num)):
        # the years from 1996 on have another column order
        late = F.col("q") >= "1996q1"
        df.filter(~late).write.partitionBy("q").csv(f"{base}/{name}", sep="\t", header=True)
        df.filter(late).select(*reversed(df.columns)).write.mode("append").partitionBy("q").csv(f"{base}/{name}", sep="\t", header=True)
    return f"{base}/sub/q=*", f"{base}/num/q=*"


@query("s03", "sub_fine", f""", {_SUB_SQL}, {_NUM_SQL}, once as (select * from subs qualify count(*) over (partition by cik, form, period, data_qtr) = 1)
  select data_qtr, form, count(*) as n, count(value) as filled, round(sum(value), 2) as total from nums join once using (adsh) group by all""")
def s03(spark, sf):
    joined = filings.join_quarters(*filings.read_quarter_files(spark, *_quarter_folders(spark, sf)))
    g = joined.groupBy("data_qtr", "form").agg(F.count("*").alias("n"), F.count("value").alias("filled"), F.sum("value").alias("total"))
    return rounded(g, 2)


def _price_folder(spark, sf):
    """One price file per ticker: two header dialects, some preferred shares."""
    p = X.prices(spark, sf)
    odd = F.col("cik") % 2 == 1
    folder = F.when(F.col("cik") % 3 == 0, "nasdaq stocks").otherwise("nyse stocks")
    mark = F.when(F.col("cik") % 10 == 9, F.lit("_A")).otherwise(F.lit(""))
    file = F.concat(F.lower("ticker"), mark, F.lit(".us"))
    day = F.when(odd, F.date_format("date", "yyyy-MM-dd")).otherwise(F.date_format("date", "yyyyMMdd"))
    price = F.col("close_price").cast("string")
    row = F.when(odd, F.concat_ws(",", day, F.lit("1.0"), price)).otherwise(F.concat_ws(",", "ticker", F.lit("D"), day, price, F.lit("0")))
    head = F.when(odd, "Date,Open,Close").otherwise("<TICKER>,<PER>,<DATE>,<CLOSE>,<VOL>")
    at = [folder.alias("exchange"), file.alias("file")]
    rows = p.select(*at, F.lit(1).alias("n"), row.alias("value")).unionByName(p.select(*at, F.lit(0).alias("n"), head.alias("value")).distinct())
    path = table_path(spark, "prices")
    rows.repartition("file").sortWithinPartitions("exchange", "file", "n").select("exchange", "file", "value").write.partitionBy("exchange", "file").text(path)
    return path


@query("s04", "prices", """select lower(ticker) || '.us' as ticker, case when cik % 3 = 0 then 'nasdaq stocks' else 'nyse stocks' end as exchange, date, round(close_price, 6) as close_price
  from prices where cik % 10 <> 9""")
def s04(spark, sf):
    return rounded(prices.read_price_files(spark, _price_folder(spark, sf), layout=prices.BY_PARTITION))


@query("s05", "prices", """select ticker, cik, case when cik % 3 = 0 then 'nasdaq_stocks' else 'nyse_stocks' end as exchange, date, round(close_price, 6) as close_price
  from prices where cik % 10 <> 9 and cik < 20""")
def s05(spark, sf):
    n = X.table(spark, sf, "nation").filter("n_nationkey < 20")
    entity = n.select(F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("ticker"), F.col("n_nationkey").cast("long").alias("cik"))
    return rounded(prices.map_exchanges(prices.read_price_files(spark, _price_folder(spark, sf), True, prices.BY_PARTITION), entity))


def _ticker_docs(spark, sf):
    """Ticker documents of up to 100 customers each; two listings share a company."""
    c = X.table(spark, sf, "customer")
    entry = F.struct(F.floor((F.col("c_custkey") + 1) / 2).cast("long").alias("cik_str"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker"), F.col("c_name").alias("title"))
    pair = F.struct(F.col("c_custkey").cast("string").alias("key"), entry.alias("value"))
    docs = c.groupBy(F.floor(F.col("c_custkey") / 100).alias("doc")).agg(F.to_json(F.map_from_entries(F.collect_list(pair))).alias("value"))
    return docs.select("value")


@query("s06", sql="""with e as (select c_custkey as position, (c_custkey + 1) // 2 as cik, 'C' || c_custkey as ticker from customer)
  select cik, arg_max(ticker, position) as ticker, lpad(cast(cik as varchar), 10, '0') as cik_padded from e group by cik""")
def s06(spark, sf):
    return entities.cik_to_ticker(entities.entity_rows(_ticker_docs(spark, sf)))


@query("s06_reverse", sql="select 'C' || c_custkey as ticker, (c_custkey + 1) // 2 as cik from customer")
def s06_reverse(spark, sf):
    return entities.ticker_to_cik(entities.entity_rows(_ticker_docs(spark, sf)))


@query("s07", sql="select 'C' || c_custkey as ticker, c_name as name, c_mktsegment as exchange from customer")
def s07(spark, sf):
    c = X.table(spark, sf, "customer")
    rec = F.array(F.col("c_custkey").cast("string"), "c_name", F.concat(F.lit("C"), F.col("c_custkey").cast("string")), "c_mktsegment")
    docs = c.groupBy(F.floor(F.col("c_custkey") / 100).alias("doc")).agg(F.to_json(F.struct(F.collect_list(rec).alias("data"))).alias("value"))
    return entities.exchange_rows(docs.select("value"))


def _fact_docs(spark, sf):
    """One company-facts document per order: a few facts each, two filings, four taxonomies."""
    # one shuffle brings a company together, for all four levels of its document
    li = X.table(spark, sf, "lineitem").repartition("l_orderkey")
    day = F.col("l_shipdate").cast("date")
    taxonomy = F.element_at(F.array(*[F.lit(t) for t in ("us-gaap", "ifrs-full", "dei", "srt")]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    end = F.when(F.col("l_partkey") % 50 == 0, "n/a").otherwise(day.cast("string"))
    start = F.when(F.col("l_linenumber") > 1, F.date_sub(day, F.col("l_linenumber") * 40).cast("string"))
    frame = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("CY"), F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"), F.when(F.col("l_returnflag") == "A", "I").otherwise("D")))
    accn = F.when(F.col("l_partkey") % 40 != 1, F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), (F.col("l_linenumber") % 2).cast("string")))
    fact = F.struct(
        F.col("l_extendedprice").alias("val"), F.when(F.col("l_returnflag") == "R", "10-K").otherwise("10-Q").alias("form"),
        F.date_add(day, 30).cast("string").alias("filed"), start.alias("start"), end.alias("end"), frame.alias("frame"), accn.alias("accn"),
    )
    tag = F.concat(F.lit("Tag"), (F.col("l_partkey") % 5).cast("string"))
    unit = F.when(F.col("l_linestatus") == "F", "USD").otherwise("shares")
    g = li.groupBy(F.col("l_orderkey").alias("cik"), taxonomy.alias("tx"), tag.alias("tag"), unit.alias("unit")).agg(F.collect_list(fact).alias("v"))
    for key in ("unit", "tag", "tx"):
        ids = [c for c in ("cik", "tx", "tag", "unit") if c in g.columns and c != key]
        m = F.map_from_entries(F.collect_list(F.struct(F.col(key), F.col("v"))))
        g = g.groupBy(*ids).agg((F.struct(m.alias("units")) if key == "unit" else m).alias("v"))
    return g.select("cik", F.to_json(F.struct(F.col("v").alias("facts"))).alias("json"))


_FLAT = """flat as (select l_orderkey as cik, ['us-gaap', 'ifrs-full', 'dei', 'srt'][l_suppkey % 4 + 1] as taxonomy, 'Tag' || (l_partkey % 5) as tag,
  case when l_linestatus = 'F' then 'USD' else 'shares' end as unit, l_extendedprice as value, case when l_returnflag = 'R' then '10-K' else '10-Q' end as form,
  cast(l_shipdate as date) + 30 as filing_date, case when l_linenumber > 1 then cast(l_shipdate as date) - l_linenumber * 40 end as period_start,
  case when l_partkey % 50 <> 0 then cast(l_shipdate as date) end as period_end,
  case when l_linenumber = 1 then 'CY' || year(l_shipdate) || 'Q' || quarter(l_shipdate) || case when l_returnflag = 'A' then 'I' else 'D' end end as frame,
  case when l_partkey % 40 <> 1 then l_orderkey || '-' || (l_linenumber % 2) end as accn from lineitem),
  known as (select * from flat where taxonomy <> 'srt')"""


def _flat(spark, sf):
    return companyfacts.flatten_facts(_fact_docs(spark, sf))


@query("s08", "", f"with {_FLAT} select cik, taxonomy, tag, unit, round(value, 6) as value, form, filing_date, period_start, period_end, frame, accn from known")
def s08(spark, sf):
    return rounded(_flat(spark, sf).drop("report_date"))


@query("s08_filing", "", f"with {_FLAT} select cik, taxonomy, tag, unit, round(value, 6) as value, form, period_end from known where accn = '33-1'")
def s08_filing(spark, sf):
    got = companyfacts.facts_of_filing(_flat(spark, sf), "33-1")
    return rounded(got.select("cik", "taxonomy", "tag", "unit", "value", "form", "period_end"))


_PICKED = """r as (select * from known where form = '10-Q'), b as (select cik, period_end from r where period_end is not null
    qualify row_number() over (partition by cik order by {rank}, period_end) = 1),
  hit as (select r.* from r join b using (cik, period_end)),
  a as (select distinct cik, accn from hit where accn is not null), nf as (select distinct cik, filing_date from hit where cik not in (select cik from a))
  select cik, taxonomy, tag, unit, round(value, 6) as value, filing_date, period_end, accn from r
  where (cik, accn) in (select (cik, accn) from a) or (cik, filing_date) in (select (cik, filing_date) from nf)"""


def _pick(spark, sf, target):
    got = companyfacts.pick_filing(_flat(spark, sf), "10-Q", target)
    return rounded(got.select("cik", "taxonomy", "tag", "unit", "value", "filing_date", "period_end", "accn"))


@query("s09", "", f"with {_FLAT}, {_PICKED.format(rank='period_end desc')}")
def s09(spark, sf):
    return _pick(spark, sf, None)


@query("s09_target", "", f"""with {_FLAT}, {_PICKED.format(rank="abs(period_end - date '1998-03-31')")}""")
def s09_target(spark, sf):
    return _pick(spark, sf, "1998-03-31")


def _submission_docs(spark, sf):
    """One submissions document per customer block of orders: parallel arrays."""
    s = X.sub_fine(spark, sf)
    c = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("cik"), "c_nationkey")
    filed = F.when(F.col("adsh") % 13 == 0, None).when(F.col("adsh") % 17 == 0, "pending").otherwise(F.col("filed").cast("string"))
    row = F.struct(F.col("adsh").cast("string").alias("a"), F.col("form").alias("f"), filed.alias("d"), F.last_day("filed").cast("string").alias("r"))
    g = s.groupBy("cik", "name").agg(F.sort_array(F.collect_list(row)).alias("x")).join(c, "cik")

    def col(k):
        return F.transform("x", lambda e: e[k])

    recent = F.struct(col("a").alias("accessionNumber"), col("f").alias("form"), col("d").alias("filingDate"), col("r").alias("reportDate"))
    sic = F.when(F.col("c_nationkey") % 5 == 0, "n/a").otherwise((F.col("c_nationkey") * 100).cast("string"))
    tickers = F.when(F.col("cik") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("C"), F.col("cik").cast("string")), F.lit("ALT")))
    doc = F.struct(F.col("name"), tickers.alias("tickers"), sic.alias("sic"), F.struct(recent.alias("recent")).alias("filings"))
    return g.select("cik", F.to_json(doc, {"ignoreNullFields": "false"}).alias("json"))


@query("s10", "sub_fine", """select cik, cast(adsh as varchar) as adsh, form, case when adsh % 13 <> 0 then cast(filed as varchar) end as filed, cast(last_day(filed) as varchar) as period from sub_fine
  where form in ('10-K', '10-Q') and (adsh % 13 = 0 or (adsh % 17 <> 0 and filed <= date '1999-06-30'))""")
def s10(spark, sf):
    got = companyfacts.flatten_submissions(_submission_docs(spark, sf), as_of="1999-06-30")
    return got.select("cik", "adsh", "form", "filed", "period")


@query("s11", sql="""select c_custkey as cik, c_name as name, case when c_custkey % 4 = 0 then '' else 'C' || c_custkey end as ticker, case when c_nationkey % 5 <> 0 then c_nationkey * 100 end as sic
  from customer where c_custkey in (select o_custkey from orders)""")
def s11(spark, sf):
    return companyfacts.company_info(_submission_docs(spark, sf))


def _bundles(spark, sf):
    """Catch-up bundles in folders of filings; some numbers are not numbers."""
    base = table_path(spark, "bundles")
    block = F.concat(F.lit("b"), (F.col("adsh").cast("long") % 8).cast("string"))
    sub = _sub_text(spark, sf).withColumn("period", F.when(F.col("adsh").cast("long") % 11 == 0, "unknown").otherwise(F.col("period").cast("string")))
    num = _num_text(spark, sf).withColumn("value", F.when(F.col("qtrs") == 4, "n/a").otherwise(F.col("value").cast("string")))
    for name, df in (("sub", sub), ("num", num)):
        # the even bundles have another column order and lack a column
        df, even = df.withColumn("b", block), F.col("adsh").cast("long") % 2 == 0
        df.filter(~even).write.partitionBy("b").csv(f"{base}/{name}", sep="\t", header=True)
        fewer = [c for c in reversed(df.columns) if c not in ("countryba", "footnote")]
        df.filter(even).select(*fewer).write.mode("append").partitionBy("b").csv(f"{base}/{name}", sep="\t", header=True)
    return base


@query("s12", "sub_fine", f""", {_SUB_SQL}, {_NUM_SQL} select form, cik, count(*) as n, count(period) as with_period, count(case when qtrs <> 4 then value end) as with_value,
  round(sum(case when qtrs <> 4 then value end), 2) as total from nums join subs using (adsh) group by all""")
def s12(spark, sf):
    base = _bundles(spark, sf)
    got = filings.load_catchup(spark, base, "sub/*", "num/*")
    g = got.groupBy("form", "cik").agg(F.count("*").alias("n"), F.count("period").alias("with_period"), F.count("value").alias("with_value"), F.sum("value").alias("total"))
    return rounded(g, 2)


@query("s13", "prices", "select cik, ticker, date, round(close_price, 6) as close_price from prices where cik % 4 <> 3")
def s13(spark, sf):
    p = X.prices(spark, sf)
    file = F.concat(F.lit("batch_"), (F.col("cik") % 4).cast("string"))
    stamp = F.concat(F.col("date").cast("string"), F.lit(" 05:00:00+02:00"))
    rows = p.select(file.alias("file"), F.lit(1).alias("n"), F.concat_ws(",", stamp, F.lit("1.5"), F.col("close_price").cast("string"), F.col("cik").cast("string"), "ticker").alias("value"))
    head = F.when(F.col("cik") % 4 == 3, "Date,Open,Price,cik,ticker").otherwise("Date,Open,Close,cik,ticker")
    heads = p.select(file.alias("file"), F.lit(0).alias("n"), head.alias("value")).distinct()
    path = table_path(spark, "batches")
    rows.unionByName(heads).repartition("file").sortWithinPartitions("file", "n").select("file", "value").write.partitionBy("file").text(path)
    return rounded(prices.read_price_batches(spark, path))


@query("s14", "features_tall", """select case when data_qtr < '1996q1' then 'Unknown' else form end as form, data_qtr, case when data_qtr = '1998q2' then tag || '!' else tag end as tag,
  count(*) as n, round(sum(value), 2) as total from features_tall group by all""")
def s14(spark, sf):
    t = durable(X.features_tall(spark, sf))  # built once, read by all three writes
    path = table_path(spark, "features")
    sinks.write_features(t.filter("data_qtr >= '1996q1'"), path)
    # one quarter is rebuilt, the early ones come from before forms were kept
    sinks.write_features(t.filter("data_qtr = '1998q2'").withColumn("tag", F.concat("tag", F.lit("!"))), path)
    sinks.write_features(t.filter("data_qtr < '1996q1'").drop("form"), path)
    got = sinks.read_features(spark, path)
    return rounded(got.groupBy("form", "data_qtr", "tag").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 2)


# filings of one (cik, period, form) are filed in two quarters, and each quarter keeps its row
@query("s14_reuse", "facts", """, k as (select distinct cik, period, form, filed_qtr from facts
    where custom_tag = 0 and form in ('10-K', '10-Q') and value is not null and uom = 'USD')
  select filed_qtr as data_qtr, form, count(*) as n from k group by all""")
def s14_reuse(spark, sf):
    f = X.facts(spark, sf).withColumn("data_qtr", F.col("filed_qtr"))
    path = table_path(spark, "features")
    store_new_quarters(f.filter("data_qtr < '1998q1'"), path, ["LARGE"])
    return store_new_quarters(f, path, ["LARGE"]).groupBy("data_qtr", "form").agg(F.count("*").alias("n"))


@query("s15", "scores", f", {STRATEGY_SQL} select strategy_name, year_month, cik, ticker, round(y_pred_proba, 6) as y_pred_proba from picks")
def s15(spark, sf):
    """All strategies written, each read back by its own partition."""
    path = table_path(spark, "records")
    sinks.write_invest_records(selection.pick_all(X.scores(spark, sf)), path)
    parts = [sinks.read_invest_records(spark, path, s.name) for s in C.STRATEGIES]
    got = reduce(lambda a, b: a.unionByName(b), parts)
    return rounded(got.select("strategy_name", "year_month", "cik", "ticker", "y_pred_proba"))


@query("s16", "sub_fine", """select cast(adsh as varchar) as adsh, cik, form, case when period >= 20000101 then 'second' else 'first' end as run from sub_fine""")
def s16(spark, sf):
    s = X.sub_fine(spark, sf).select(F.col("adsh").cast("string").alias("adsh"), "cik", "form", "period")
    old = s.select("adsh", "cik", "form", F.lit("first").alias("run"), F.lit("2026-01-01 00:00:00").alias("caught_up_at"))
    new = s.filter("period >= 20000101").select("adsh", "cik", "form", F.lit("second").alias("run"), F.lit("2026-02-01 00:00:00").alias("caught_up_at"))
    return filings.upsert_index(old, new).select("adsh", "cik", "form", "run")


@query("s16_bundles", "sub_fine", """select 'run' || (period // 10000) as batch, form, count(*) as headers, sum(k)::bigint as facts
  from sub_fine join (select l_orderkey, count(*) as k from lineitem group by 1) on l_orderkey = adsh group by all""")
def s16_bundles(spark, sf):
    base = table_path(spark, "bundles")
    s, li = X.sub_fine(spark, sf), X.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("adsh"), "l_extendedprice")
    years = [r["y"] for r in s.select(F.floor(F.col("period") / 10000).alias("y")).distinct().orderBy("y").collect()]
    for year in years:
        part = s.filter(F.floor(F.col("period") / 10000) == year)
        filings.write_bundles(part, li.join(part.select("adsh"), "adsh", "left_semi"), base, f"run{year}")
    num = spark.read.parquet(f"{base}/num").groupBy("batch", "adsh").agg(F.count("*").alias("k"))
    sub = spark.read.parquet(f"{base}/sub")
    return sub.join(num, ["batch", "adsh"]).groupBy("batch", "form").agg(F.count("*").alias("headers"), F.sum("k").alias("facts"))


@query("s17", sql="""with d as (select min(o_orderdate) as a, max(o_orderdate) as b from orders)
  select year(q) || 'q' || quarter(q) as label from (select unnest(range(date_trunc('year', a), b + interval 1 second, interval 3 months)) as q from d)""")
def s17(spark, sf):
    o = X.table(spark, sf, "orders")
    span = o.agg(F.min("o_orderdate").cast("date").alias("start"), F.max("o_orderdate").cast("date").alias("end"))
    return filings.quarter_labels(span)


@query("a30", "", f"""with {_FLAT} select taxonomy, count(*) as facts, count(distinct form) as forms, count(distinct coalesce(accn, 'NO_ACCN')) as accessions, count(distinct period_end) as periods
  from flat where tag = 'Tag3' group by taxonomy""")
def a30(spark, sf):
    flat = companyfacts.flatten_facts(_fact_docs(spark, sf), taxonomies=None)
    return explore.tag_existence(flat, "Tag3")


@query("a30_similar", "", f"with {_FLAT} select distinct taxonomy, tag from flat where contains(lower(tag), 'ag')")
def a30_similar(spark, sf):
    return explore.similar_tags(companyfacts.flatten_facts(_fact_docs(spark, sf), taxonomies=None), "AG")


_QTRS = """case when frame like '%I' then 0 when period_end - period_start is not null then
  case when period_end - period_start <= 1 then 0 else least(greatest(cast(round_even((period_end - period_start) / 91.25, 0) as int), 0), 4) end
  when frame like '%D' then cast(regexp_extract(frame, 'Q(\\d+)', 1) as int) else 0 end"""


@query("x05", "", f"with {_FLAT} select frame, period_start, period_end, {_QTRS} as qtrs, count(*) as n from known group by all")
def x05(spark, sf):
    q = D.frame_to_qtrs(F.col("frame"), F.col("period_start"), F.col("period_end"))
    return _flat(spark, sf).groupBy("frame", "period_start", "period_end", q.alias("qtrs")).agg(F.count("*").alias("n"))


@query("x06", "", f"""with {_FLAT} select cik, coalesce(accn, '') as adsh, tag, taxonomy as version, cast(strftime(period_end, '%Y%m%d') as int) as ddate, {_QTRS} as qtrs, unit as uom,
  cast(null as varchar) as segments, cast(null as varchar) as coreg, round(value, 6) as value, cast(null as varchar) as footnote from known""")
def x06(spark, sf):
    return rounded(companyfacts.to_bulk(_flat(spark, sf), ["cik"]))


@query("x07", "sub_fine", """select cast(adsh as varchar) as adsh, s.cik, s.name, case when c_nationkey % 5 <> 0 then cast(c_nationkey * 100 as varchar) end as sic, form,
  strftime(last_day(filed), '%Y%m%d') as period, case when adsh % 13 = 0 then '' when adsh % 17 = 0 then 'pending' else strftime(filed, '%Y%m%d') end as filed
  from sub_fine s join customer on c_custkey = cik where form in ('10-K', '10-Q')""")
def x07(spark, sf):
    docs = _submission_docs(spark, sf)
    got = companyfacts.header_rows(companyfacts.flatten_submissions(docs), companyfacts.company_info(docs))
    return got.select("adsh", "cik", "name", "sic", "form", "period", "filed")
