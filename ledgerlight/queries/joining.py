"""Joins (J01-J24) and set operations (U01-U06)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerlight import fixtures as X
from ledgerlight.functions import dates as D
from ledgerlight.operators import explore, facts, features, joins, match, prices, reconcile, selection, sets
from ledgerlight.queries.registry import query, rounded
from ledgerlight.session import durable, table_path
from ledgerlight.sources import sinks


def _num(spark, sf):
    li = X.table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("adsh"), "l_linenumber", F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("value"))


@query("j01", "sub_fine", """select adsh, l_linenumber, l_partkey as part, round(l_extendedprice, 6) as value, cik, name, sic, form, period
  from lineitem join sub_fine on l_orderkey = adsh""")
def j01(spark, sf):
    return rounded(facts.join_headers(_num(spark, sf), X.sub_fine(spark, sf)))


def _monthly(spark, sf, multi=False):
    return prices.month_end_prices(X.prices(spark, sf, multi), tiebreak="tiebreak")


def _trends(spark, sf, multi=False, horizons=(3,)):
    return prices.price_trends(_monthly(spark, sf, multi), horizons)


def _nation_features(spark, sf):
    """Features keyed by nation, one row per (cik, period)."""
    tall = X.metric_facts(spark, sf)
    return tall.groupBy(F.floor(F.col("cik") / 100).cast("long").alias("cik"), "period").agg(
        F.max(F.when(F.col("tag") == "Assets", F.col("value"))).alias("assets"), F.count("*").alias("n_facts")
    )


_NF = """nf as (select cik // 100 as cik, period, max(case when tag = 'Assets' then value end) as assets, count(*) as n_facts
  from metric_facts group by 1, 2), nfd as (select *, strptime(cast(period as varchar), '%Y%m%d')::date as pd,
  (period // 10000) * 12 + (period // 100) % 100 - 1 as year_month from nf)"""


@query("j02", "metric_facts trends_multi", f""", {_NF} select nfd.cik, nfd.period, n_facts, round(assets, 6) as assets, nfd.year_month, ticker,
  trend_up_or_down, round(price_return, 6) as price_return from nfd join trends_multi t on nfd.cik = t.cik and nfd.year_month = t.year_month and horizon = 3""")
def j02(spark, sf):
    from ledgerlight.plans.dataset import join_labels

    out = join_labels(_nation_features(spark, sf), _trends(spark, sf, multi=True))
    return rounded(out.select("cik", "period", "n_facts", "assets", "year_month", "ticker", "trend_up_or_down", "price_return"))


@query("j03", "metric_facts trends", f""", {_NF} select t.cik, t.ticker, t.month_end_date, t.trend_up_or_down, nfd.pd as period, n_facts, round(assets, 6) as assets
  from trends t asof join nfd on t.cik = nfd.cik and t.month_end_date >= nfd.pd where t.horizon = 3""")
def j03(spark, sf):
    feats = _nation_features(spark, sf).withColumn("period", D.parse_day(F.col("period")))
    got = joins.asof_join(_trends(spark, sf), feats, ["cik"], "month_end_date", "period", ["n_facts", "assets"])
    return rounded(got.select("cik", "ticker", "month_end_date", "trend_up_or_down", "period", "n_facts", "assets"))


@query("j04", "sub_fine prices", """, idx as (select cik % 25 as cik, filed, max(period) as period from sub_fine where form in ('10-K', '10-Q') group by all)
  select p.cik, p.ticker, p.date, p.tiebreak, idx.filed, idx.period from prices p asof join idx on p.cik = idx.cik and p.date >= idx.filed""")
def j04(spark, sf):
    idx = X.sub_fine(spark, sf).filter(F.col("form").isin("10-K", "10-Q")).withColumn("cik", F.col("cik") % 25)
    got = joins.asof_join(X.prices(spark, sf), idx, ["cik"], "date", "filed", ["period"])
    return got.select("cik", "ticker", "date", "tiebreak", "filed", "period")


def _catchup_side(spark, sf):
    """Catch-up reports: the fine headers, their periods moved by a few days."""
    s = X.sub_fine(spark, sf).filter(F.col("form") != "8-K")
    moved = D.to_int(F.date_add(D.parse_day(F.col("period")), (F.col("adsh") % 40).cast("int")))
    return s.filter(F.year("filed") >= 2000).select("cik", "form", moved.alias("period"))


_PAIRS = """cu as (select distinct cik, form, cast(strftime(cast(strptime(cast(period as varchar), '%Y%m%d') as date) + cast(adsh % 40 as int), '%Y%m%d') as int) as period_catchup
    from sub_fine where form <> '8-K' and year(filed) >= 2000),
  ba as (select distinct cik, form, period as period_batch from sub_fine where year(filed) < 2001),
  near as (select cu.*, period_batch, abs(strptime(cast(period_batch as varchar), '%Y%m%d')::date - strptime(cast(period_catchup as varchar), '%Y%m%d')::date) as delta
    from cu join ba using (cik, form)),
  pairs as (select cik, form, period_catchup, period_batch, delta as period_delta_days from near where delta <= 90
    qualify row_number() over (partition by cik, form, period_catchup order by delta, period_batch) = 1)"""


def _pairs(spark, sf):
    batch = X.sub_fine(spark, sf).filter(F.year("filed") < 2001)
    return reconcile.overlapping_reports(batch, _catchup_side(spark, sf))


@query("j05", "sub_fine", f", {_PAIRS} select * from pairs")
def j05(spark, sf):
    return _pairs(spark, sf)


@query("j05_best", "sub_fine", f", {_PAIRS} select * from pairs qualify row_number() over (partition by cik, form order by period_delta_days, period_catchup desc) = 1")
def j05_best(spark, sf):
    return reconcile.best_pairs(_pairs(spark, sf))


@query("j06", "month_end", """select a.cik, a.ticker, a.year_month, a.month_end_date, round(a.close_price, 6) as close_price, round(b.close_price, 6) as close_price_future
  from month_end a left join month_end b on a.cik = b.cik and a.ticker = b.ticker and b.year_month = a.year_month + 6""")
def j06(spark, sf):
    m = _monthly(spark, sf)
    return rounded(joins.shift_join(m, m, ["cik", "ticker"], "year_month", 6, ["close_price"], "_future"))


_J7 = ["Assets_0qtrs_current", "Revenues_1qtrs_current"]


@query("j07", "features_wide", """, f as (select *, (period // 10000) * 12 + (period // 100) % 100 - 1 as m from features_wide)
  select a.cik, a.m as month, round(a."Assets_0qtrs_current", 6) as "Assets_0qtrs_current", round(a."Revenues_1qtrs_current", 6) as "Revenues_1qtrs_current",
  round(b."Assets_0qtrs_current", 6) as "Assets_0qtrs_current_past", round(b."Revenues_1qtrs_current", 6) as "Revenues_1qtrs_current_past"
  from f a left join f b on a.cik = b.cik and b.m = a.m - 12""")
def j07(spark, sf):
    f = X.features_wide(spark, sf).withColumn("month", D.month_index(D.parse_day(F.col("period")))).select("cik", "month", *_J7)
    return rounded(joins.shift_join(f, f, ["cik"], "month", -12, _J7, "_past"))


@query("j08", "customer_facts", """, st as (select cik, count(*) as annual from customer_facts where tag = 'Revenues' and form = '10-K' group by cik)
  select cik, count(*) as n, coalesce(any_value(annual), 0) as annual from customer_facts left join st using (cik) group by cik""")
def j08(spark, sf):
    f = X.metric_facts(spark, sf, by_customer=True)
    st = f.filter("tag = 'Revenues' and form = '10-K'").groupBy("cik").agg(F.count("*").alias("annual"))
    n = f.groupBy("cik").agg(F.count("*").alias("n"))
    return joins.map_dimension(n, st, "cik", ["annual"], "left").fillna(0, ["annual"]).select("cik", "n", "annual")


_RANKED = """stats as (select tag, count(*) as occurrences, count(distinct cik) as distinct_companies from tag_names group by tag),
  ranked as (select *, row_number() over (order by distinct_companies desc, tag) - 1 as rank from stats)"""


def _names(spark, sf):
    return X.tag_names(spark, sf).withColumn("adsh", F.lit(1)).withColumn("custom_tag", F.lit(0))


@query("j09", "tag_names", f", {_RANKED} select tag, count(*) as count, any_value(rank) as rank from tag_names join ranked using (tag) where contains(lower(tag), 'gear') group by tag")
def j09(spark, sf):
    t = _names(spark, sf)
    return explore.popular_matches(t, explore.rank_tags(facts.tag_stats(t)), "gear")


_SIC = "sic as (select cik // 100 as cik0, cik, any_value(sic) as sic from metric_facts where sic <> 'BUILDING' group by all)"


@query("j10", "metric_facts", f", {_SIC} select f.cik, sic.sic, count(*) as n from metric_facts f left join sic on f.cik = sic.cik group by all")
def j10(spark, sf):
    f = X.metric_facts(spark, sf)
    sic = f.filter("sic <> 'BUILDING'").select("cik", "sic").distinct()
    return joins.map_dimension(f.drop("sic"), sic, "cik", ["sic"], "left").groupBy("cik", "sic").agg(F.count("*").alias("n"))


_PICKS = "picks as (select * from scores qualify row_number() over (partition by year_month order by y_pred_proba desc, cik, ticker) <= 5)"


def _score_trends(spark, sf, horizon=6):
    m = X.score_prices(spark, sf).select(F.substring("ticker", 2, 20).cast("long").alias("cik"), "ticker", "year_month", "close_price")
    m = m.withColumn("month_end_date", D.month_end(F.col("year_month")))
    return prices.price_trends(m, [horizon])


_STR = """st as (select cast(substr(a.ticker, 2) as bigint) as cik, a.ticker, a.year_month, b.close_price / a.close_price as price_return
  from score_prices a join score_prices b on a.ticker = b.ticker and b.year_month = a.year_month + 6)"""


@query("j11", "scores score_prices", f""", {_PICKS}, {_STR} select p.year_month, p.cik, p.ticker, round(p.y_pred_proba, 6) as y_pred_proba, round(p.price_return, 6) as price_return,
  round(st.price_return, 6) as price_return_long_term from picks p join st on p.cik = st.cik and p.year_month = st.year_month and p.ticker = st.ticker""")
def j11(spark, sf):
    from ledgerlight.config import Strategy

    picks = selection.pick(X.scores(spark, sf), Strategy("top_5", limit=5))
    out = selection.long_term_returns(picks, _score_trends(spark, sf))
    return rounded(out.select("year_month", "cik", "ticker", "y_pred_proba", "price_return", "price_return_long_term"))


_BENCH = """inside as (select * from scores where year_month > 23964 and year_month <= 23988),
  j as (select i.cik, i.year_month, st.price_return as far from inside i left join st on i.cik = st.cik and i.year_month = st.year_month)
  select (select round(avg(price_return), 6) from inside) as short_term_return, round(avg(far), 6) as long_term_return,
  (select count(*) from inside) as num_records, count(far) as num_with_long_term from j"""


@query("j12", "scores score_prices", f", {_STR}, {_BENCH}")
def j12(spark, sf):
    return rounded(selection.benchmark(X.scores(spark, sf), _score_trends(spark, sf), 23964, 23988))


@query("j13", "sub_fine", """select form, count(*) as n from sub_fine where cik in (select c_custkey from customer where c_acctbal > 0) group by form""")
def j13(spark, sf):
    rich = X.table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("cik"))
    return joins.semi_join(X.sub_fine(spark, sf), rich, ["cik"]).groupBy("form").agg(F.count("*").alias("n"))


def _known(spark, sf):
    s = X.sub_fine(spark, sf)
    return s.filter("period < 20000101").select("adsh").unionByName(s.filter("sic = 'BUILDING'").select("adsh"))


@query("j14", "sub_fine", "select adsh, cik, name, sic, form, period, filed from sub_fine where not (period < 20000101 or sic = 'BUILDING')")
def j14(spark, sf):
    return reconcile.unknown_filings(X.sub_fine(spark, sf), _known(spark, sf))


@query("j15", "prices_multi", """select distinct cik, ticker from prices_multi where (cik, ticker) not in (select (cik, ticker) from prices_multi where close_price > 1240)""")
def j15(spark, sf):
    p = X.prices(spark, sf, multi=True)
    return joins.anti_join(p.select("cik", "ticker").distinct(), p.filter("close_price > 1240"), ["cik", "ticker"])


def _two_builds(spark, sf):
    """Two builds of the tall features: the second lacks early quarters and has some changed values."""
    a = durable(X.features_tall(spark, sf)).withColumn("feature", F.concat("tag", F.lit("_"), F.col("qtrs").cast("string"))).select("cik", "period", "feature", "value")
    changed = F.when(F.col("cik") % 5 == 0, F.col("value") * 1.5).otherwise(F.col("value"))
    b = a.filter("period > 19951231 and feature not in ('Assets_1')").withColumn("value", changed)
    return a.filter("period < 20010101"), b


_BUILDS = """t as (select cik, period, tag || '_' || qtrs as feature, value from features_tall),
  a as (select * from t where period < 20010101),
  b as (select cik, period, feature, case when cik % 5 = 0 then value * 1.5 else value end as value from t where period > 19951231 and feature <> 'Assets_1'),
  ka as (select distinct cik, period from a), kb as (select distinct cik, period from b),
  kboth as (select cik, period from ka intersect select cik, period from kb)"""


@query("j16", "features_tall", f""", {_BUILDS}, n as (select (select count(*) from kboth) as in_both, (select count(*) from ka) as na, (select count(*) from kb) as nb)
  select in_both, na - in_both as only_left, nb - in_both as only_right, round(in_both * 100.0 / na, 6) as pct_of_left, round(in_both * 100.0 / nb, 6) as pct_of_right from n""")
def j16(spark, sf):
    a, b = _two_builds(spark, sf)
    return rounded(joins.key_diff(a, b, ["cik", "period"]))


_J17 = f""", {_BUILDS},
  f as (select distinct feature from t), grid as (select cik, period, feature from kboth cross join f),
  p as (select grid.feature, a.value as v1, b.value as v2 from grid left join a using (cik, period, feature) left join b using (cik, period, feature)),
  d as (select *, abs(v1 - v2) as d from p)
  select feature, round(avg(d), 4) as mean_abs_diff, round(max(d), 4) as max_abs_diff, round(avg(d / (abs(v1) + 1e-10) * 100), 4) as mean_rel_diff_pct,
  round(max(d / (abs(v1) + 1e-10) * 100), 4) as max_rel_diff_pct, count(*) filter ((v1 is null) <> (v2 is null)) + count(*) filter (d > 1e-10) as mismatches,
  count(d) as matching_pairs, round((count(*) filter ((v1 is null) <> (v2 is null)) + count(*) filter (d > 1e-10)) * 100.0 / (select count(*) from kboth), 4) as mismatch_pct
  from d group by feature"""


@query("j17", "features_tall", _J17)
def j17(spark, sf):
    a, b = _two_builds(spark, sf)
    return rounded(reconcile.value_diff(a, b, ["cik", "period"]), 4)


@query("j17_stored", "features_tall", _J17)
def j17_stored(spark, sf):
    """The same builds kept as tables bucketed by report, compared without a shuffle of their rows."""
    a, b = (sinks.write_tall(d, f"build_{name}_{uuid.uuid4().hex}", table_path(spark, f"build-{name}"), 8) for name, d in zip("ab", _two_builds(spark, sf)))
    return rounded(reconcile.value_diff(a, b, ["cik", "period"]), 4)


@query("j18", "features_tall", f""", {_BUILDS}, x as (select * from a where feature = 'Revenues_1'), y as (select * from b where feature = 'Revenues_1')
  select cik, period, round(x.value, 4) as v1, round(y.value, 4) as v2, round(abs(x.value - y.value), 4) as abs_diff
  from kboth left join x using (cik, period) left join y using (cik, period) where x.value is distinct from y.value""")
def j18(spark, sf):
    a, b = _two_builds(spark, sf)
    return rounded(reconcile.feature_diff(a, b, ["cik", "period"], "Revenues_1"), 4)


def _two_pipelines(spark, sf):
    """Batch and catch-up features of the same reports, the catch-up a few days later with drifted values."""
    t = X.features_tall(spark, sf).withColumn("feature", F.concat("tag", F.lit("_"), F.col("qtrs").cast("string"))).select("cik", "form", "period", "feature", "value")
    later = D.to_int(F.date_add(D.parse_day(F.col("period")), (F.col("cik") % 7).cast("int")))
    drift = F.when(F.length("feature") % 3 == 0, F.col("value") + 0.4).when(F.length("feature") % 5 == 0, F.col("value") * 1.01).otherwise(F.col("value"))
    c = t.filter("period > 20000101 and feature <> 'Revenues_0'").withColumn("period", later).withColumn("value", drift)
    return t, c


_J19 = """, t as (select cik, form, period, tag || '_' || qtrs as feature, value from features_tall),
  c as (select cik, form, cast(strftime(strptime(cast(period as varchar), '%Y%m%d')::date + cast(cik % 7 as int), '%Y%m%d') as int) as period, feature,
    case when length(feature) % 3 = 0 then value + 0.4 when length(feature) % 5 = 0 then value * 1.01 else value end as value
    from t where period > 20000101 and feature <> 'Revenues_0'),
  near as (select x.cik, x.form, x.period as period_catchup, y.period as period_batch,
    abs(strptime(cast(x.period as varchar), '%Y%m%d')::date - strptime(cast(y.period as varchar), '%Y%m%d')::date) as dd
    from (select distinct cik, form, period from c) x join (select distinct cik, form, period from t) y using (cik, form)),
  pairs as (select * from near where dd <= 90 qualify row_number() over (partition by cik, form, period_catchup order by dd, period_batch) = 1),
  shared as (select distinct feature from c),
  cell as (select p.*, s.feature, t.value as v1, c.value as v2 from pairs p cross join shared s
    left join t on t.cik = p.cik and t.form = p.form and t.period = p.period_batch and t.feature = s.feature
    left join c on c.cik = p.cik and c.form = p.form and c.period = p.period_catchup and c.feature = s.feature),
  f as (select *, v1 is not null and v2 is not null as present, coalesce(abs(v1 - v2) <= 1.0 + 1e-5 * abs(v2), false) as close from cell)"""


@query("j19", "features_tall", _J19 + """
  select cik, form, period_catchup, period_batch, dd as period_delta_days, count(*) as n_shared_features, count(*) filter (present) as n_both_present,
  count(*) filter (close) as n_value_close, count(*) filter (present and not close) as n_disagree,
  round(count(*) filter (close) / nullif(count(*) filter (present), 0), 6) as match_rate_present,
  count(*) filter (v1 is null and v2 is null) as n_both_nan, count(*) filter ((v1 is null) <> (v2 is null)) as n_one_nan,
  coalesce(array_to_string(list_sort(list(feature) filter (present and not close)), ','), '') as disagreements
  from f group by cik, form, period_catchup, period_batch, dd""")
def j19(spark, sf):
    return rounded(reconcile.compare_pairs(*_matched(spark, sf)))


def _matched(spark, sf):
    t, c = (durable(d) for d in _two_pipelines(spark, sf))
    names = {side: {r["feature"] for r in d.select("feature").distinct().collect()} for side, d in (("t", t), ("c", c))}
    shared = sets.column_diff(names["t"], names["c"])["shared"]
    pairs = reconcile.overlapping_reports(t.select("cik", "form", "period"), c.select("cik", "form", "period"))
    return t, c, pairs, shared


@query("j19_cells", "features_tall", _J19 + """
  select cik, form, period_catchup, period_batch, dd as period_delta_days, feature, round(v1, 6) as v1, round(v2, 6) as v2 from f where present and not close""")
def j19_cells(spark, sf):
    return rounded(reconcile.disagreements(*_matched(spark, sf)))


@query("j20", "facts", """, i as (select cik, tag, segments, ddate, version, min(case when form = '10-K' then value end) as v1, min(case when form = '10-Q' then value end) as v2
    from facts group by all)
  select cik, tag, count(*) as matching_keys, count(*) filter (abs(v1 - v2) < 0.01) as identical, count(*) filter (abs(v1 - v2) >= 0.01) as different
  from i where v1 is not null and v2 is not null group by all""")
def j20(spark, sf):
    return explore.form_value_match(X.facts(spark, sf))


def _api_side(spark, sf):
    f = X.facts(spark, sf).filter("tag <> 'PROMO' or cik = 2")
    v = F.when(F.col("qtrs") == 1, F.col("value") + 1).otherwise(F.col("value"))
    return f.select("cik", "tag", "ddate", "qtrs", v.alias("value"))


_API = "api as (select cik, tag, ddate, qtrs, case when qtrs = 1 then value + 1 else value end as value from facts where tag <> 'PROMO' or cik = 2)"


@query("j21", "facts", f""", {_API} select count(*) as matched, count(*) filter (b.value is distinct from a.value) as mismatching
  from facts b join api a using (cik, tag, ddate, qtrs) where b.segments is null""")
def j21(spark, sf):
    return reconcile.source_match(X.facts(spark, sf), _api_side(spark, sf))


@query("j21_unmatched", "facts", f""", {_API}, r as (select * from facts where (cik, tag) not in (select (cik, tag) from api))
  select count(*) as rows, count(*) filter (custom_tag <> 0) as custom, count(*) filter (custom_tag = 0) as standard,
  count(*) filter (custom_tag = 0 and segments is null) as company_level, count(*) filter (custom_tag = 0 and segments is null and value is not null) as unexplained from r""")
def j21_unmatched(spark, sf):
    return reconcile.unmatched_breakdown(X.facts(spark, sf), _api_side(spark, sf))


METRICS = ["BlueGear", "SmallRing", "RedWidgetPromo", "HotBoltSmallEconomy"]
_ML = ", ".join(f"('{m}')" for m in METRICS)


@query("j22", "tag_names", f"select metric, tag from (select distinct tag from tag_names) cross join (values {_ML}) v(metric)")
def j22(spark, sf):
    return match.candidates(X.tag_names(spark, sf), METRICS).select("metric", "tag")


def _entity(spark, sf):
    s = X.table(spark, sf, "supplier")
    return s.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("cik"), F.replace("s_name", F.lit("#"), F.lit("-")).alias("ticker"))


@query("j23", "scores", """select year_month, cik, period, round(y_pred_proba, 6) as y_pred_proba, round(price_return, 6) as price_return, label, replace(s_name, '#', '-') as ticker
  from scores join supplier on s_suppkey = cik and s_acctbal > 0""")
def j23(spark, sf):
    return rounded(selection.mark_tickers(X.scores(spark, sf), _entity(spark, sf)))


@query("j24", "scores", "select distinct cik, replace(s_name, '#', '-') as ticker from scores join supplier on s_suppkey = cik and s_acctbal > 0")
def j24(spark, sf):
    return joins.map_dimension(X.scores(spark, sf).select("cik").distinct(), _entity(spark, sf), "cik", ["ticker"])


@query("u01", "facts", "select data_qtr, form, count(*) as n from facts group by all")
def u01(spark, sf):
    f = X.facts(spark, sf)
    parts = [f.filter(F.year(D.parse_day(F.col("period"))) < 1998).drop("coreg"), f.filter(F.year(D.parse_day(F.col("period"))) >= 1998)]
    return sets.union_all(parts).groupBy("data_qtr", "form").agg(F.count("*").alias("n"))


def _form_tables(spark, sf):
    w = X.features_wide(spark, sf).select("cik", F.floor(F.col("period") / 10000).cast("int").alias("year"), "form", *_J7)
    one = w.groupBy("cik", "year", "form").agg(*[F.max(c).alias(c) for c in _J7])
    k = one.filter("form = '10-K'").select("cik", "year", _J7[0])
    q = one.filter("form = '10-Q'").select("cik", "year", *_J7)
    return k, q


@query("u02", "features_wide", """, one as (select cik, period // 10000 as year, form, max("Assets_0qtrs_current") as a, max("Revenues_1qtrs_current") as r from features_wide group by all),
  k as (select * from one where form = '10-K'), q as (select * from one where form = '10-Q')
  select coalesce(k.cik, q.cik) as cik, coalesce(k.year, q.year) as year, round(coalesce(k.a, q.a), 6) as "Assets_0qtrs_current", round(q.r, 6) as "Revenues_1qtrs_current"
  from k full join q on k.cik = q.cik and k.year = q.year""")
def u02(spark, sf):
    k, q = _form_tables(spark, sf)
    return rounded(sets.combine_first(k, q, ["cik", "year"]))


@query("u02_disjoint", "features_wide", """, one as (select cik, period // 10000 as year, form, max("Assets_0qtrs_current") as a, max("Revenues_1qtrs_current") as r from features_wide group by all)
  select cik, year, form, round(a, 6) as "Assets_0qtrs_current", round(case when form = '10-Q' then r end, 6) as "Revenues_1qtrs_current" from one""")
def u02_disjoint(spark, sf):
    k, q = _form_tables(spark, sf)
    return rounded(sets.merge_forms([k.withColumn("form", F.lit("10-K")), q.withColumn("form", F.lit("10-Q"))], ["cik", "year", "form"]))


@query("u03", "features_wide", """, a as (select cik, period, "Assets_0qtrs_current" as v from features_wide where period >= 19980101),
  b as (select cik, period, -1.0 as v from features_wide where period < 19990101)
  select cik, period, round(coalesce(a.v, case when a.cik is null then b.v end), 6) as v from a full join b using (cik, period)""")
def u03(spark, sf):
    w = X.features_wide(spark, sf)
    a = w.filter("period >= 19980101").select("cik", "period", F.col(_J7[0]).alias("v"))
    b = w.filter("period < 19990101").select("cik", "period", F.lit(-1.0).alias("v"))
    return rounded(features.first_wins(a, b, ["cik", "period"]))


@query("u04", "customer_facts", """, a as (select distinct cik, tag from customer_facts where form = '10-K'),
  b as (select distinct cik, tag from customer_facts where form = '10-Q')
  select coalesce(a.cik, b.cik) as cik, coalesce(a.tag, b.tag) as tag, case when b.cik is null then 'left' when a.cik is null then 'right' else 'both' end as side
  from a full join b using (cik, tag)""")
def u04(spark, sf):
    f = X.metric_facts(spark, sf, by_customer=True)
    return sets.set_compare(f.filter("form = '10-K'"), f.filter("form = '10-Q'"), ["cik", "tag"], X.customer_tasks(spark, sf))


@query("u05", "features_tall", """, a as (select distinct tag || '_' || qtrs as feature from features_tall where form = '10-K' and tag < 'L'),
  b as (select distinct tag || '_' || qtrs as feature from features_tall where form = '10-Q' and tag > 'C')
  select coalesce(a.feature, b.feature) as feature, case when b.feature is null then 'left' when a.feature is null then 'right' else 'both' end as side from a full join b using (feature)""")
def u05(spark, sf):
    t = X.features_tall(spark, sf).withColumn("feature", F.concat("tag", F.lit("_"), F.col("qtrs").cast("string")))
    return sets.set_compare(t.filter("form = '10-K' and tag < 'L'"), t.filter("form = '10-Q' and tag > 'C'"), ["feature"])


@query("u06", "facts", "select distinct cik, period, form from facts")
def u06(spark, sf):
    return sets.distinct_keys(X.facts(spark, sf))
