"""Filters and cleaning (F01-F23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight import fixtures as X
from ledgerlight.functions import dates as D
from ledgerlight.operators import clean, facts, features, prices
from ledgerlight.queries.registry import query, rounded


@query("f01", "sub_fine", """select adsh, cik, name, sic, form, period, filed from sub_fine
  qualify count(*) over (partition by cik, form, period) = 1""")
def f01(spark, sf):
    return clean.drop_refiled(X.sub_fine(spark, sf))


def _versioned(spark, sf):
    f = X.facts(spark, sf)
    own = F.when(F.col("custom_tag") == 1, F.col("adsh").cast("string")).otherwise(F.col("version"))
    return f.select("tag", F.col("adsh").cast("string").alias("adsh"), own.alias("version"))


@query("f02", "facts", """select tag, cast(own = adsh as int) as custom_tag, count(*) as n from (
  select tag, cast(adsh as varchar) as adsh, case when custom_tag = 1 then cast(adsh as varchar) else version end as own from facts)
  group by all""")
def f02(spark, sf):
    return clean.flag_custom_tags(_versioned(spark, sf)).groupBy("tag", "custom_tag").agg(F.count("*").alias("n"))


@query("f03", "facts std", "select cik, tag, ddate, qtrs, period, form, segments, value from std where form = '10-Q'")
def f03(spark, sf):
    return clean.standard_facts(X.facts(spark, sf), ["10-Q"])


def _typos(spark, sf):
    li = X.table(spark, sf, "lineitem")
    late = F.when(F.col("l_partkey") % 97 == 0, 900 * 10000).otherwise(0)
    return li.select("l_orderkey", (D.to_int(F.col("l_shipdate").cast("date")) + late).alias("ddate"))


_TYPO_SQL = """typos as (select l_orderkey, cast(strftime(l_shipdate, '%Y%m%d') as int) + case when l_partkey % 97 = 0 then 9000000 else 0 end as ddate
  from lineitem)"""


@query("f04", sql=f"""with {_TYPO_SQL} select ddate, count(*) as n from (select case when ddate // 10000 > 2500
  then '20' || substr(cast(ddate as varchar), 3) else cast(ddate as varchar) end as ddate from typos) group by all""")
def f04(spark, sf):
    return clean.repair_dates(_typos(spark, sf), "ddate").groupBy("ddate").agg(F.count("*").alias("n"))


@query("f05", sql="""with raw as (select l_orderkey, case when l_partkey % 97 = 0 then '1011' || strftime(l_shipdate, '%m%d')
    when l_partkey % 89 = 0 then strftime(l_shipdate, '%Y') || '1399' else strftime(l_shipdate, '%Y%m%d') end as t from lineitem)
  select d as ddate, count(*) as n from (select cast(try_strptime(t, '%Y%m%d') as date) as d from raw)
  where d between date '1677-09-22' and date '2262-04-11' group by all""")
def f05(spark, sf):
    li = X.table(spark, sf, "lineitem")
    day, key = F.col("l_shipdate"), F.col("l_partkey")
    text = (
        F.when(key % 97 == 0, F.concat(F.lit("1011"), F.date_format(day, "MMdd")))
        .when(key % 89 == 0, F.concat(F.date_format(day, "yyyy"), F.lit("1399")))
        .otherwise(F.date_format(day, "yyyyMMdd"))
    )
    return clean.parse_dates(li.select(text.alias("ddate")), "ddate").groupBy("ddate").agg(F.count("*").alias("n"))


@query("f06", "prices", """select cik, ticker, date, round(close_price, 6) as close_price, tiebreak from prices
  where date between date '1997-01-01' and date '1999-12-31'""")
def f06(spark, sf):
    return rounded(clean.date_range(X.prices(spark, sf), "date", "1997-01-01", "1999-12-31"))


@query("f07", "prices", """select cik, ticker, date, round(close_price, 6) as close_price, tiebreak from prices
  where close_price between 1 and 1000""")
def f07(spark, sf):
    return rounded(clean.price_range(X.prices(spark, sf)))


_GAPS = """days as (select distinct ticker, date from prices),
  gaps as (select *, lag(date) over w as prev, date - lag(date) over w as gap from days window w as (partition by ticker order by date)),
  tops as (select *, max(gap) over (partition by ticker) as top from gaps)"""


@query("f08", "prices", f""", {_GAPS} select cik, ticker, count(*) as n from prices
  where ticker not in (select ticker from tops where top > 30) group by all""")
def f08(spark, sf):
    return clean.continuous_tickers(X.prices(spark, sf), 30).groupBy("cik", "ticker").agg(F.count("*").alias("n"))


@query("f08_info", "prices", f""", {_GAPS} select ticker, top as max_gap_days, prev as gap_start_date, date as gap_end_date
  from tops where gap = top and top > 10""")
def f08_info(spark, sf):
    return clean.broken_tickers(X.prices(spark, sf), 10)


_STEPS = """months as (select cik, ticker, year_month, count(*) as n, lag(year_month) over (partition by cik, ticker order by year_month) as prev
    from {src} group by cik, ticker, year_month),
  bad as (select distinct cik, ticker from months where n > 1 or coalesce(year_month - prev, 1) <> 1)"""


@query("f09", "prices month_end", f""", {_STEPS.format(src='month_end')} select cik, ticker, month_end_date, year_month,
  round(close_price, 6) as close_price from month_end where (cik, ticker) not in (select (cik, ticker) from bad)""")
def f09(spark, sf):
    monthly = prices.month_end_prices(X.prices(spark, sf), tiebreak="tiebreak")
    return rounded(clean.complete_series(monthly))


@query("f09_missing", "prices_multi month_end_multi", f""", {_STEPS.format(src='month_end_multi')},
  holes as (select cik, ticker, m, (m // 12) as y, (m % 12) + 1 as mo from (select cik, ticker, unnest(range(prev + 1, year_month)) as m from months))
  select b.cik, b.ticker, coalesce(string_agg(lpad(cast(y as varchar), 4, '0') || '-' || lpad(cast(mo as varchar), 2, '0'), ',' order by m), '') as missing_months
  from bad b left join holes h on b.cik = h.cik and b.ticker = h.ticker group by b.cik, b.ticker""")
def f09_missing(spark, sf):
    return clean.missing_months(prices.month_end_prices(X.prices(spark, sf, multi=True), tiebreak="tiebreak"))


def _mixed_trends(spark, sf):
    """One ticker for even companies, several for odd ones."""
    p = X.prices(spark, sf, multi=True)
    one = F.when(F.col("cik") % 2 == 0, F.concat(F.lit("T"), F.col("cik").cast("string"))).otherwise(F.col("ticker"))
    return p.select("cik", one.alias("ticker"), "date")


@query("f10", "features_wide prices_multi", """, tr as (select cik, case when cik % 2 = 0 then 'T' || cik else ticker end as ticker from prices_multi),
  feats as (select cik // 100 as cik, period from features_wide),
  ok as (select cik from tr group by cik having count(distinct ticker) = 1),
  deep as (select cik from feats where cik in (select cik from ok) group by cik having count(distinct period) >= 4)
  select 'features' as side, cik, count(*) as n from feats where cik in (select cik from deep) group by all
  union all select 'trends', cik, count(*) from tr where cik in (select cik from deep) group by all""")
def f10(spark, sf):
    feats = X.features_wide(spark, sf).select(F.floor(F.col("cik") / 100).cast("long").alias("cik"), "period")
    a, b = clean.eligible_companies(feats, _mixed_trends(spark, sf))
    parts = [d.groupBy("cik").agg(F.count("*").alias("n")).select(F.lit(s).alias("side"), "cik", "n") for s, d in (("features", a), ("trends", b))]
    return parts[0].unionByName(parts[1])


_F11_COLS = ", ".join(f'"{c}"' for c in X.WIDE_COLUMNS)


@query("f11", "features_wide", f""", c as (select count(*) as n, {", ".join(f'count("{c}") as "{c}"' for c in X.WIDE_COLUMNS)} from features_wide),
  good as (select feature from (unpivot c on {_F11_COLS} into name feature value k) where k * 100.0 / n > 15),
  kept as (select * from features_wide where cik in (select cast(n_nationkey * 100 + 65 as bigint) from nation)),
  one as (select * from kept qualify row_number() over (partition by cik, period order by data_qtr desc, form) = 1)
  select cik, period, data_qtr, feature, round(value, 6) as value from (unpivot (select cik, period, data_qtr, {_F11_COLS} from one) on {_F11_COLS} into name feature value value)
  where feature in (select feature from good)""")
def f11(spark, sf):
    wide = X.features_wide(spark, sf)
    mapped = X.table(spark, sf, "nation").select((F.col("n_nationkey") * 100 + 65).cast("long").alias("cik"))
    kept = facts.completeness_filter(wide, facts.completeness(wide), mapped)
    cols = [F.col(c) for c in kept.columns if c not in ("cik", "period", "data_qtr")]
    return rounded(kept.unpivot(["cik", "period", "data_qtr"], cols, "feature", "value").filter("value is not null"))


_F12_REF = ["cik", "period", "Assets_0qtrs_current", "Goodwill_0qtrs_current", "Revenues_1qtrs_current"]


@query("f12", "features_wide", """select cik, period, "Assets_0qtrs_current", cast(null as double) as "Goodwill_0qtrs_current", "Revenues_1qtrs_current" from features_wide""")
def f12(spark, sf):
    return clean.standardize_columns(X.features_wide(spark, sf), _F12_REF)


@query("f13", "features_wide", f"""select cik, period, cast(null as double) as "Goodwill_0qtrs_current", form, data_qtr, {_F11_COLS} from features_wide""")
def f13(spark, sf):
    return clean.standardize_columns(X.features_wide(spark, sf), _F12_REF, keep_extra=True)


@query("f14", "features_wide", f""", c as (select count(*) as n, {", ".join(f'count("{c}") as "{c}"' for c in X.WIDE_COLUMNS)} from features_wide)
  select feature, k as filled from (unpivot c on {_F11_COLS} into name feature value k) where k / n >= 0.2""")
def f14(spark, sf):
    wide = X.features_wide(spark, sf)
    names = clean.feature_columns(wide, "completeness")
    return wide.agg(*[F.count(c).alias(c) for c in names]).unpivot([], [F.col(c) for c in names], "feature", "filled")


@query("f15", "features_wide", """select cik, period, form, data_qtr, "Assets_0qtrs_current", "Revenues_1qtrs_current" from features_wide""")
def f15(spark, sf):
    ranking = spark.createDataFrame([(1, "Revenues_1qtrs_current"), (2, "Assets_0qtrs_current"), (3, "InventoryNet_0qtrs_current")], "rank int, feature string")
    return clean.keep_important(X.features_wide(spark, sf), ranking, 2)


@query("f16", "features_wide", """select cik, period, "Assets_0qtrs_current", "Revenues_1qtrs_current" from features_wide where period >= 20000101""")
def f16(spark, sf):
    wide = X.features_wide(spark, sf).select("cik", "period", "Assets_0qtrs_current", "Revenues_1qtrs_current", F.lit(7.0).alias("Flat_0qtrs_current"))
    train, test = clean.period_split(wide, 20000101)
    cols = [c for c in wide.columns if c.endswith("_current")]
    return clean.drop_constant(train, test, cols)[1]


_F17 = ["GrossMargin_1qtrs_augment", "CurrentRatio_0qtrs_augment", "ROE_1qtrs_augment"]


@query("f17", "ratios_wide", ", tr as (select * from ratios_wide where period < 20000101) select cik, period, "
       + ", ".join(f'round(coalesce("{c}", (select quantile_cont("{c}", 0.5) from tr), 0.0), 6) + 0.0 as "{c}"' for c in _F17) + " from ratios_wide where period >= 20000101")
def f17(spark, sf):
    wide = features.ratio_features(X.features_wide(spark, sf)).select("cik", "period", *_F17)
    train, test = clean.period_split(wide, 20000101)
    return rounded(clean.impute_median(train, test, _F17)[1])


@query("f18", "features_wide", """select data_qtr, cast(substr(data_qtr, 1, 4) as int) * 12 + cast(substr(data_qtr, 6, 1) as int) * 3 - 1 <= 1999 * 12 + 4 as train, count(*) as n
  from features_wide group by all""")
def f18(spark, sf):
    train, hold = clean.quarter_split(X.features_wide(spark, sf), 1999 * 12 + 4)
    both = train.select("data_qtr", F.lit(True).alias("train")).unionByName(hold.select("data_qtr", F.lit(False).alias("train")))
    return both.groupBy("data_qtr", "train").agg(F.count("*").alias("n"))


@query("f19", "features_wide", "select period, period < 19980630 as before, count(*) as n from features_wide group by all")
def f19(spark, sf):
    a, b = clean.period_split(X.features_wide(spark, sf), 19980630)
    both = a.select("period", F.lit(True).alias("before")).unionByName(b.select("period", F.lit(False).alias("before")))
    return both.groupBy("period", "before").agg(F.count("*").alias("n"))


@query("f20", "tag_names", "select tag, count(*) as n from tag_names where contains(lower(tag), 'ring') group by all")
def f20(spark, sf):
    return clean.tag_contains(X.tag_names(spark, sf), "RING").groupBy("tag").agg(F.count("*").alias("n"))


@query("f21", "features_tall", "select cik, period, form, data_qtr, tag, qtrs, round(value, 6) as value from features_tall where cik = 2166 and period = 20001231 and tag = 'Assets' and qtrs in (0, 1)")
def f21(spark, sf):
    return rounded(clean.lookup(X.features_tall(spark, sf), 2166, 20001231, "Assets"))


@query("f22", "sub_fine", """select l_orderkey as adsh, l_linenumber, l_partkey, round(l_extendedprice, 6) as value from lineitem
  where l_orderkey in (select adsh from sub_fine where cik = 22 and period = 19950630)""")
def f22(spark, sf):
    num = X.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("adsh"), "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("value"))
    return rounded(clean.trace_filing(X.sub_fine(spark, sf), num, 22, 19950630))


@query("f23", "facts", """select cik, tag, count(*) as n, round(sum(value), 2) as total from facts
  where form = '10-Q' and cik in (select n_regionkey from nation where n_nationkey in (1, 2, 3)) group by all""")
def f23(spark, sf):
    ciks = X.table(spark, sf, "nation").filter(F.col("n_nationkey").isin(1, 2, 3)).select(F.col("n_regionkey").cast("long").alias("cik"))
    got = clean.company_facts(X.facts(spark, sf), ciks)
    return rounded(got.groupBy("cik", "tag").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 2)


