"""Adapters: the driver's tables in the shapes the operators take, in Spark and as SQL text.

The SQL twins are plain CTE bodies; `with_ctes` joins the ones a query needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight import config as C
from ledgerlight.functions import dates as D
from ledgerlight.session import spread, tasks_for


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(c: str) -> Column:
    return F.col(c).cast("date")


def _form(other: str) -> Column:
    return F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "10-Q").otherwise(other)


def sub_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filing headers: duplicates per (cik, form, period) exist."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    day = _day("o_orderdate")
    return j.select(
        F.col("o_orderkey").alias("adsh"),
        F.col("o_custkey").alias("cik"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("sic"),
        _form("8-K").alias("form"),
        D.to_int(F.last_day(day)).alias("period"),
        F.date_add(day, F.pmod("o_orderkey", F.lit(90)).cast("int")).alias("filed"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse facts: several rows per fact key."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    c, n, p = (table(spark, sf_dir, t) for t in ("customer", "nation", "part"))
    j = (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .join(c, F.col("o_custkey") == c.c_custkey)
        .join(n, F.col("c_nationkey") == n.n_nationkey)
        .join(p, F.col("l_partkey") == p.p_partkey)
    )
    usd = (F.col("l_linestatus") == "F") | (F.col("l_returnflag") == "N")
    return j.select(
        F.col("l_orderkey").alias("adsh"),
        F.col("n_regionkey").cast("long").alias("cik"),
        F.concat(F.lit("Company "), F.col("n_regionkey").cast("string")).alias("name"),
        F.col("p_type").alias("tag"),
        F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("version"),
        D.quarter_end_int(_day("l_shipdate")).alias("ddate"),
        (F.col("l_linenumber") % 3).alias("qtrs"),
        F.nullif(F.col("l_suppkey") % 4, F.lit(0)).cast("string").alias("segments"),
        F.col("l_extendedprice").alias("value"),
        D.quarter_end_int(_day("o_orderdate")).alias("period"),
        _form("10-Q").alias("form"),
        F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("custom_tag"),
        F.when(usd, "USD").otherwise("shares").alias("uom"),
        F.year(_day("o_orderdate")).cast("string").alias("fy"),
        F.concat(F.lit("Q"), F.quarter(_day("o_orderdate")).cast("string")).alias("fp"),
        D.quarter_label(_day("o_orderdate")).alias("data_qtr"),
        D.quarter_label(F.date_add(_day("o_orderdate"), F.pmod("o_orderkey", F.lit(90)).cast("int"))).alias("filed_qtr"),
    )


def _qe(col: str) -> str:
    return f"cast(strftime(last_day(cast(date_trunc('quarter', {col}) + interval 2 month as date)), '%Y%m%d') as int)"


CTES = {
    "sub_fine": """sub_fine as (select o_orderkey as adsh, o_custkey as cik, c_name as name, c_mktsegment as sic,
  case o_orderstatus when 'F' then '10-K' when 'O' then '10-Q' else '8-K' end as form,
  cast(strftime(last_day(o_orderdate), '%Y%m%d') as int) as period,
  cast(cast(o_orderdate as date) + cast(o_orderkey % 90 as int) as date) as filed
  from orders join customer on o_custkey = c_custkey)""",
    "facts": f"""facts as (select l_orderkey as adsh, cast(n_regionkey as bigint) as cik, 'Company ' || n_regionkey as name, p_type as tag,
  'v' || l_linenumber as version, {_qe('l_shipdate')} as ddate, l_linenumber % 3 as qtrs,
  cast(nullif(l_suppkey % 4, 0) as varchar) as segments, l_extendedprice as value, {_qe('o_orderdate')} as period,
  case o_orderstatus when 'F' then '10-K' else '10-Q' end as form, case when l_returnflag = 'A' then 1 else 0 end as custom_tag,
  case when l_linestatus = 'F' or l_returnflag = 'N' then 'USD' else 'shares' end as uom,
  cast(year(o_orderdate) as varchar) as fy, 'Q' || quarter(o_orderdate) as fp,
  year(o_orderdate) || 'q' || quarter(o_orderdate) as data_qtr,
  (cast(o_orderdate as date) + cast(o_orderkey % 90 as int)) as filed_day, year(filed_day) || 'q' || quarter(filed_day) as filed_qtr
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey join part on l_partkey = p_partkey)""",
    "std": """std as (select distinct cik, tag, ddate, qtrs, period, form, segments, value from facts
  where custom_tag = 0 and form in ('10-K', '10-Q') and value is not null and uom = 'USD')""",
    "summary": """summary as (select cik, tag, ddate, qtrs, period, form, segments, value, 1 as summary_flag,
  case when n = 1 then 'single_record' when has_null then 'segments_null_summary' else 'max_value' end as summary_reason
  from (select std.*, count(*) over w as n, bool_or(segments is null) over w as has_null,
    row_number() over (partition by cik, tag, ddate, qtrs, period, form order by (segments is null) desc, value desc, segments) as rn
    from std window w as (partition by cik, tag, ddate, qtrs, period, form)) where rn = 1)""",
}


# the same per quarter of filing
CTES["std_q"] = CTES["std"].replace("std as", "std_q as").replace("distinct cik", "distinct filed_qtr, cik")
CTES["summary_q"] = (
    CTES["summary"].replace("summary as", "summary_q as").replace("from std ", "from std_q ").replace("std.*", "std_q.*")
    .replace("(select cik, tag", "(select filed_qtr, cik, tag").replace("partition by cik", "partition by filed_qtr, cik")
)


def customer_tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """Tasks for the facts of single customers, by the rows that the files' footers name (see `session.tasks_for`)."""
    return tasks_for(spark, table(spark, sf_dir, "lineitem").count())


def metric_facts(spark: SparkSession, sf_dir: str, by_customer: bool = False) -> DataFrame:
    """Facts under the tracked metric names, with negative and zero values.

    Companies are nation and segment, or (`by_customer`) single customers with sparse facts.
    """
    cik = F.col("o_custkey") if by_customer else F.col("c_nationkey") * 100 + F.ascii("c_mktsegment")
    li, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    if by_customer and (tasks := customer_tasks(spark, sf_dir)):
        known = spread(o, tasks, "o_custkey").join(c, F.col("o_custkey") == c.c_custkey)
        j = spread(li, tasks, "l_orderkey").join(known, F.col("l_orderkey") == F.col("o_orderkey"))
    else:
        j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey)
    names = F.array(*[F.lit(m) for m in C.KEY_METRICS])
    value = F.when(F.col("l_quantity") <= 2, 0.0).when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    return j.select(
        F.col("l_orderkey").alias("adsh"),
        cik.cast("long").alias("cik"),
        F.element_at(names, (F.col("l_partkey") % len(C.KEY_METRICS) + 1).cast("int")).alias("tag"),
        (F.col("l_linenumber") % 2).alias("qtrs"),
        value.alias("value"),
        D.quarter_end_int(_day("o_orderdate")).alias("period"),
        F.when(F.quarter(_day("o_orderdate")) == 4, "10-K").otherwise("10-Q").alias("form"),
        D.quarter_label(_day("o_orderdate")).alias("data_qtr"),
        D.quarter_end_int(_day("l_shipdate")).alias("ddate"),
        F.lit("USD").alias("uom"),
        F.col("c_mktsegment").alias("sic"),
    )


_TAG_LIST = "[" + ", ".join(f"'{m}'" for m in C.KEY_METRICS) + "]"
CTES["metric_facts"] = f"""metric_facts as (select l_orderkey as adsh, cast(c_nationkey * 100 + ascii(c_mktsegment) as bigint) as cik,
  ({_TAG_LIST})[l_partkey % {len(C.KEY_METRICS)} + 1] as tag, l_linenumber % 2 as qtrs,
  case when l_quantity <= 2 then 0.0 when l_returnflag = 'R' then -l_extendedprice else l_extendedprice end as value,
  {_qe('o_orderdate')} as period, case when quarter(o_orderdate) = 4 then '10-K' else '10-Q' end as form,
  year(o_orderdate) || 'q' || quarter(o_orderdate) as data_qtr, {_qe('l_shipdate')} as ddate, 'USD' as uom, c_mktsegment as sic
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey)"""

CTES["customer_facts"] = CTES["metric_facts"].replace("metric_facts as", "customer_facts as").replace("cast(c_nationkey * 100 + ascii(c_mktsegment) as bigint)", "o_custkey")

CELLS = [(m, q) for m in C.KEY_METRICS for q in (0, 1)]
WIDE_COLUMNS = [f"{m}_{q}qtrs_current" for m, q in CELLS]


def features_tall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cik, period, form, data_qtr, tag, qtrs, value), the largest value of a cell."""
    return metric_facts(spark, sf_dir).groupBy("cik", "period", "form", "data_qtr", "tag", "qtrs").agg(F.max("value").alias("value"))


def features_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (cik, period) with a column per metric and quarter count."""
    g = metric_facts(spark, sf_dir).groupBy("cik", "period", "form", "data_qtr")
    return g.agg(*[F.max(F.when((F.col("tag") == m) & (F.col("qtrs") == q), F.col("value"))).alias(f"{m}_{q}qtrs_current") for m, q in CELLS])


CTES["features_tall"] = """features_tall as (select cik, period, form, data_qtr, tag, qtrs, max(value) as value from metric_facts group by all)"""
CTES["features_wide"] = (
    "features_wide as (select cik, period, form, data_qtr, "
    + ", ".join(f"max(case when tag = '{m}' and qtrs = {q} then value end) as \"{m}_{q}qtrs_current\"" for m, q in CELLS)
    + " from metric_facts group by cik, period, form, data_qtr)"
)


def _ratio_sql(r: C.Ratio) -> str:
    num = " + ".join(f'({s} * "{t}_{r.num_qtrs}qtrs_current")' for s, t in r.numerator)
    den = f'"{r.denominator}_{r.den_qtrs}qtrs_current"'
    return f'case when {den} <> 0 then ({num}) / {den} end as "{r.column}"'


CTES["ratios_wide"] = "ratios_wide as (select *, " + ", ".join(_ratio_sql(r) for r in C.RATIOS) + " from features_wide)"
CTES["ratios_tall"] = (
    "ratios_tall as (unpivot (select cik, period, " + ", ".join(f'"{r.column}"' for r in C.RATIOS) + " from ratios_wide) on "
    + ", ".join(f'"{r.column}"' for r in C.RATIOS) + " into name ratio value value)"
)


def prices(spark: SparkSession, sf_dir: str, multi: bool = False, company: bool = False) -> DataFrame:
    """Daily prices with gaps; `multi` gives companies several tickers, `company` the ids of `metric_facts`."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    cik = F.col("c_nationkey") * 100 + F.ascii("c_mktsegment") if company else F.col("c_nationkey")
    ticker = F.col("c_mktsegment") if multi else F.concat(F.lit("T"), cik.cast("string"))
    return o.join(c, o.o_custkey == c.c_custkey).select(
        cik.cast("long").alias("cik"),
        ticker.alias("ticker"),
        _day("o_orderdate").alias("date"),
        (F.col("o_totalprice") / 400).alias("close_price"),
        F.col("o_orderkey").alias("tiebreak"),
    )


for _suffix, _cik, _ticker in (
    ("", "c_nationkey", "'T' || c_nationkey"),
    ("_multi", "c_nationkey", "c_mktsegment"),
    ("_company", "c_nationkey * 100 + ascii(c_mktsegment)", "'T' || (c_nationkey * 100 + ascii(c_mktsegment))"),
):
    _p, _m, _t = f"prices{_suffix}", f"month_end{_suffix}", f"trends{_suffix}"
    CTES[_p] = f"""{_p} as (select cast({_cik} as bigint) as cik, {_ticker} as ticker, cast(o_orderdate as date) as date,
  o_totalprice / 400 as close_price, o_orderkey as tiebreak from orders join customer on o_custkey = c_custkey)"""
    CTES[_m] = f"""{_m} as (select cik, ticker, date as month_end_date, close_price, year(date) * 12 + month(date) - 1 as year_month
  from (select *, row_number() over (partition by cik, ticker, year(date), month(date) order by date desc, tiebreak) as rn from {_p}) where rn = 1)"""
    CTES[_t] = f"""{_t} as (select a.cik, a.ticker, a.month_end_date, a.year_month, h.horizon,
  cast(b.close_price > a.close_price as int) as trend_up_or_down, cast(b.close_price > a.close_price * 1.05 as int) as trend_5per_up,
  b.close_price / a.close_price as price_return, a.close_price, b.close_price as future_close_price
  from {_m} a cross join (values (12), (6), (3), (1)) h(horizon) join {_m} b
  on a.cik = b.cik and a.ticker = b.ticker and b.year_month = a.year_month + h.horizon)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly prediction scores of companies (suppliers): (year_month, cik, ticker, period, y_pred_proba, price_return, label)."""
    li = table(spark, sf_dir, "lineitem")
    day = _day("l_shipdate")
    g = li.groupBy(D.month_index(day).alias("year_month"), F.col("l_suppkey").alias("cik"))
    return g.agg(
        F.max(F.col("l_extendedprice") / 105000).alias("y_pred_proba"),
        F.max(F.col("l_quantity") / 25).alias("price_return"),
        F.max(D.to_int(F.last_day(day))).alias("period"),
        F.max(F.when(F.col("l_quantity") > 25, 1).otherwise(0)).alias("label"),
    ).withColumn("ticker", F.concat(F.lit("S"), F.col("cik").cast("string")))


CTES["scores"] = """scores as (select year(l_shipdate) * 12 + month(l_shipdate) - 1 as year_month, l_suppkey as cik,
  max(l_extendedprice / 105000) as y_pred_proba, max(l_quantity / 25) as price_return,
  max(cast(strftime(last_day(l_shipdate), '%Y%m%d') as int)) as period, max(case when l_quantity > 25 then 1 else 0 end) as label,
  'S' || l_suppkey as ticker from lineitem group by 1, 2)"""


def score_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month-end prices of the scored tickers; some months are missing."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"), D.month_index(_day("l_shipdate")).alias("year_month")).agg(
        F.max(F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice") / 100)).alias("close_price")
    ).filter("close_price is not null")


CTES["score_prices"] = """score_prices as (select 'S' || l_suppkey as ticker, year(l_shipdate) * 12 + month(l_shipdate) - 1 as year_month,
  max(case when l_returnflag <> 'R' then l_extendedprice / 100 end) as close_price from lineitem group by 1, 2 having close_price is not null)"""


def row_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-level scores with binary labels for evaluation."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_extendedprice") / 105000).alias("score"),
        F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("label"),
        (F.col("l_quantity") / 25).alias("price_return"),
        "l_discount", "l_tax",
    )


CTES["row_scores"] = """row_scores as (select l_extendedprice / 105000 as score, case when l_quantity > 25 then 1 else 0 end as label,
  l_quantity / 25 as price_return, l_discount, l_tax from lineitem)"""


def tag_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cik, tag): CamelCase tags from part names, used by the companies that order them."""
    li, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    c = table(spark, sf_dir, "customer")
    name = F.replace(F.initcap(F.concat_ws(" ", "p_name", F.lower("p_type"))), F.lit(" "), F.lit(""))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(p, li.l_partkey == p.p_partkey)
    return j.select(F.col("c_nationkey").cast("long").alias("cik"), name.alias("tag"))


CTES["tag_names"] = """tag_names as (select cast(c_nationkey as bigint) as cik,
  array_to_string(list_transform(string_split(p_name || ' ' || lower(p_type), ' '), lambda w: upper(w[1]) || lower(w[2:])), '') as tag
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join part on l_partkey = p_partkey)"""

_NEEDS = {
    "std": ["facts"], "summary": ["facts", "std"],
    "features_tall": ["metric_facts"], "features_wide": ["metric_facts"],
    "ratios_wide": ["metric_facts", "features_wide"], "ratios_tall": ["metric_facts", "features_wide", "ratios_wide"],
    "month_end": ["prices"], "month_end_multi": ["prices_multi"],
    "trends": ["prices", "month_end"], "trends_multi": ["prices_multi", "month_end_multi"],
    "month_end_company": ["prices_company"], "trends_company": ["prices_company", "month_end_company"],
}


def with_ctes(names: str, body: str) -> str:
    """`with …` for the named CTEs and what they need, then the query."""
    out: list[str] = []
    for name in names.split():
        for n in [*_NEEDS.get(name, []), name]:
            if n not in out:
                out.append(n)
    sep = ", " if body.lstrip().startswith(",") else " "
    return "with " + ",\n".join(CTES[n] for n in out) + (sep + body.lstrip()[1:] if sep == ", " else "\n" + body)
