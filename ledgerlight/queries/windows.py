"""Ordered analytics (W01-W16) and sorts (K10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight import config as C
from ledgerlight import fixtures as X
from ledgerlight.operators import clean, evaluate, features, portfolio, prices, selection
from ledgerlight.plans import labels
from ledgerlight.queries.registry import query, rounded


def _monthly(spark, sf, multi=False):
    return prices.month_end_prices(X.prices(spark, sf, multi), tiebreak="tiebreak")


@query("w01", "month_end", "select cik, ticker, month_end_date, round(close_price, 6) as close_price, year_month from month_end")
def w01(spark, sf):
    return rounded(_monthly(spark, sf))


@query("w02", "prices", """, d as (select distinct ticker, date from prices) select ticker, date, lag(date) over w as gap_start_date, date - lag(date) over w as gap_days
  from d window w as (partition by ticker order by date)""")
def w02(spark, sf):
    return clean.ticker_gaps(X.prices(spark, sf))


@query("w03", "trends", """select cik, ticker, month_end_date, year_month, horizon, trend_up_or_down, trend_5per_up, round(price_return, 6) as price_return,
  round(close_price, 6) as close_price, round(future_close_price, 6) as future_close_price from trends""")
def w03(spark, sf):
    return rounded(prices.price_trends(_monthly(spark, sf)))


@query("w03_labels", "prices", """, p as (select * from prices where date between date '1996-01-01' and date '2000-12-31'),
  me as (select cik, ticker, date as month_end_date, close_price, year(date) * 12 + month(date) - 1 as ym
    from p qualify row_number() over (partition by cik, ticker, year(date), month(date) order by date desc, tiebreak) = 1),
  st as (select *, ym - lag(ym) over (partition by cik, ticker order by ym) as step from me),
  ok as (select * from me where (cik, ticker) not in (select (cik, ticker) from st where step > 1) and close_price between 1 and 1000)
  select a.cik, a.ticker, a.month_end_date, h as horizon, cast(b.close_price > a.close_price as int) as trend_up_or_down, cast(b.close_price > a.close_price * 1.05 as int) as trend_5per_up,
  round(b.close_price / a.close_price, 6) as price_return from ok a cross join (values (12), (6), (3), (1)) v(h) join ok b on a.cik = b.cik and a.ticker = b.ticker and b.ym = a.ym + h""")
def w03_labels(spark, sf):
    out = labels.build_trends(X.prices(spark, sf), start="1996-01-01", end="2000-12-31", tiebreak="tiebreak")
    return rounded(out.select("cik", "ticker", "month_end_date", "horizon", "trend_up_or_down", "trend_5per_up", "price_return"))


_G = ["Assets_0qtrs_current", "CurrentRatio_0qtrs_augment"]


@query("w04", "ratios_wide", """, f as (select cik, period, (period // 10000) * 12 + (period // 100) % 100 - 1 as m, "Assets_0qtrs_current" as a, "CurrentRatio_0qtrs_augment" as c from ratios_wide)
  select f.cik, f.period, """ + ", ".join(
    f"round(case when h{q}.{x} <> 0 then (f.{x} - h{q}.{x}) / h{q}.{x} end, 6) as \"{n}_change_q{q}\"" for q in (1, 2, 4) for x, n in (("a", "Assets_0qtrs"), ("c", "CurrentRatio_0qtrs"))
) + " from f " + " ".join(f"left join f h{q} on h{q}.cik = f.cik and h{q}.m = f.m - {3 * q}" for q in (1, 2, 4)))
def w04(spark, sf):
    wide = features.ratio_features(X.features_wide(spark, sf)).select("cik", "period", *_G)
    out = features.gradients(wide)
    return rounded(out.drop(*_G))


@query("w04_tall", "features_tall", """, f as (select cik, tag || '_' || qtrs as feature, period, (period // 10000) * 12 + (period // 100) % 100 - 1 as m, value from features_tall)
  select f.cik, f.feature, f.period, q, round(f.value, 6) as current, round(h.value, 6) as past, round(case when h.value <> 0 then (f.value - h.value) / h.value end, 6) as gradient
  from f cross join (values (1), (2), (4)) v(q) join f h on h.cik = f.cik and h.feature = f.feature and h.m = f.m - 3 * q""")
def w04_tall(spark, sf):
    t = X.features_tall(spark, sf).withColumn("feature", F.concat("tag", F.lit("_"), F.col("qtrs").cast("string")))
    return rounded(features.tall_gradients(t))


def _aligned(spark, sf):
    """Monthly rows of nations with two features that have holes."""
    m = _monthly(spark, sf)
    t = prices.price_trends(m, [3])
    a = F.when(F.dayofmonth("month_end_date") > 20, F.col("close_price"))
    b = F.when(F.month("month_end_date") % 3 == 0, F.col("future_close_price"))
    return t.select("cik", "month_end_date", "price_return", "trend_up_or_down", a.alias("fa"), b.alias("fb"))


_ALIGNED = """al as (select cik, month_end_date, price_return, trend_up_or_down, case when day(month_end_date) > 20 then close_price end as fa,
  case when month(month_end_date) % 3 = 0 then future_close_price end as fb from trends where horizon = 3)"""
_WIN = "window w as (partition by cik order by month_end_date)"


@query("w05", "trends", f""", {_ALIGNED}, l as (select cik, month_end_date, lag(fa, 1) over w as fa_lag_1, lag(fb, 1) over w as fb_lag_1, lag(fa, 2) over w as fa_lag_2, lag(fb, 2) over w as fb_lag_2
  from al {_WIN}) select cik, month_end_date, round(fa_lag_1, 6) as fa_lag_1, round(fb_lag_1, 6) as fb_lag_1, round(fa_lag_2, 6) as fa_lag_2, round(fb_lag_2, 6) as fb_lag_2
  from l where fa_lag_1 is not null or fb_lag_1 is not null""")
def w05(spark, sf):
    out = prices.lag_features(_aligned(spark, sf), ["fa", "fb"], [1, 2])
    return rounded(out.select("cik", "month_end_date", "fa_lag_1", "fb_lag_1", "fa_lag_2", "fb_lag_2"))


_FILLED = f"""fl as (select cik, month_end_date, price_return, trend_up_or_down,
  coalesce(last_value(fa ignore nulls) over (w rows unbounded preceding), first_value(fa ignore nulls) over (w rows between current row and unbounded following), 0) as fa,
  coalesce(last_value(fb ignore nulls) over (w rows unbounded preceding), first_value(fb ignore nulls) over (w rows between current row and unbounded following), 0) as fb
  from al {_WIN})"""


@query("w06", "trends", f", {_ALIGNED}, {_FILLED} select cik, month_end_date, round(fa, 6) as fa, round(fb, 6) as fb from fl")
def w06(spark, sf):
    return rounded(prices.fill_gaps(_aligned(spark, sf), ["fa", "fb"]).select("cik", "month_end_date", "fa", "fb"))


@query("w07", "trends", f""", {_ALIGNED}, {_FILLED}, r as (select *, row_number() over (partition by cik order by month_end_date desc) as age from fl)
  select cik, count(*) as length, round(sum(fa), 6) as fa_sum, round(sum(fb), 6) as fb_sum, round(arg_max(price_return, month_end_date), 6) as last_target,
  arg_max(trend_up_or_down, month_end_date) as last_label from r where age <= 20 group by cik having count(*) >= 4""")
def w07(spark, sf):
    s = prices.sequences(_aligned(spark, sf), ["fa", "fb"], "price_return", "trend_up_or_down")

    def total(i):
        return F.round(F.aggregate(F.transform("features", lambda x: x[i]), F.lit(0.0), lambda a, x: a + x), 6)

    return s.select("cik", "length", total(0).alias("fa_sum"), total(1).alias("fb_sum"), F.round(F.element_at("targets", -1), 6).alias("last_target"), "last_label")


@query("w08", "trends", f""", {_ALIGNED} select cik, month_end_date, round(avg(price_return) over (partition by cik order by month_end_date rows between 3 preceding and current row), 6) as moving_average,
  round(avg(price_return) over (partition by cik order by month_end_date rows between 4 preceding and 1 preceding), 6) as past_average from al""")
def w08(spark, sf):
    out = prices.moving_average(_aligned(spark, sf), "price_return")
    past = prices.moving_average(out.withColumnRenamed("moving_average", "now"), "price_return", leaky=False)
    return rounded(past.select("cik", "month_end_date", F.col("now").alias("moving_average"), F.col("moving_average").alias("past_average")))


@query("w09", sql="""select user_id as ticker, year(ts) * 12 + month(ts) - 1 as year_month, arg_max(value, (cast(ts as date), -event_id)) as close_price, max(cast(ts as date)) as month_end_date
  from events group by all""")
def w09(spark, sf):
    e = X.table(spark, sf, "events").select(F.col("user_id").alias("ticker"), F.col("ts").cast("date").alias("date"), F.col("value").alias("close_price"), "event_id")
    return prices.month_end_prices(e, ["ticker"], "event_id")


@query("w10", "month_end", """, c as (select t.ticker, m.m as year_month from (select distinct ticker from month_end) t cross join (select unnest(range((select min(year_month) from month_end), (select max(year_month) from month_end) + 1)) as m) m),
  j as (select c.*, e.close_price from c left join month_end e on c.ticker = e.ticker and c.year_month = e.year_month)
  select ticker, year_month, round(last_value(close_price ignore nulls) over (partition by ticker order by year_month rows unbounded preceding), 6) as close_price from j""")
def w10(spark, sf):
    m = _monthly(spark, sf).select("ticker", "year_month", "close_price")
    ends = m.agg(F.min("year_month").alias("a"), F.max("year_month").alias("b")).first()
    cal = m.select("ticker").distinct().withColumn("year_month", F.explode(F.sequence(F.lit(ends["a"]), F.lit(ends["b"]))))
    return rounded(portfolio.carry_forward(cal.join(m, ["ticker", "year_month"], "left"), "close_price", ["ticker"], "year_month"))


HOLD = """best as (select year_month, ticker from scores qualify row_number() over (partition by year_month order by y_pred_proba desc, cik, ticker) <= {k}),
  buys as (select b.year_month, b.ticker, close_price as price, count(*) over (partition by b.year_month) as n from best b join score_prices p on b.ticker = p.ticker and b.year_month = p.year_month where close_price > 0),
  sh as (select ticker, year_month, sum(10000.0 / n / price) as shares from buys group by all),
  months as (select distinct year_month from scores), inv as (select m.year_month, coalesce((select count(distinct b.year_month) from buys b where b.year_month <= m.year_month), 0) * cast(10000 as double) as total_invested from months m),
  own as (select m.year_month, sh.ticker, sum(shares) as owned from months m join sh on sh.year_month <= m.year_month group by all),
  val as (select own.year_month, sum(owned * close_price) as v, count(*) as n from own join score_prices p on own.ticker = p.ticker and own.year_month = p.year_month group by all),
  hold as (select inv.year_month, coalesce(v, 0) as portfolio_value, total_invested, coalesce(n, 0) as num_stocks,
    case when total_invested > 0 then (coalesce(v, 0) / total_invested - 1) * 100 else 0 end as cumulative_return from inv left join val on inv.year_month = val.year_month)"""


@query("w11", "scores score_prices", f", {HOLD.format(k=10)} select year_month, round(portfolio_value, 4) as portfolio_value, total_invested, num_stocks, round(cumulative_return, 4) as cumulative_return from hold")
def w11(spark, sf):
    return rounded(portfolio.buy_and_hold(X.scores(spark, sf), X.score_prices(spark, sf)), 4)


DCA = """cal as (select t.ticker, m.m as year_month from (select distinct ticker from month_end where year_month between 23952 and 24011) t cross join (select unnest(range(23952, 24012)) as m) m),
  pr as (select cal.*, close_price as price from cal left join month_end e on cal.ticker = e.ticker and cal.year_month = e.year_month),
  run as (select *, coalesce(sum(case when price > 0 then 10000.0 / price end) over w, 0) as shares, coalesce(sum(case when price > 0 then cast(10000 as double) end) over w, 0) as total_invested
    from pr window w as (partition by ticker order by year_month)),
  dca as (select ticker, year_month, total_invested, coalesce(last_value(case when price is not null then shares * price end ignore nulls) over (partition by ticker order by year_month), 0) as portfolio_value from run)"""


@query("w12", "month_end", f", {DCA} select *  replace (round(portfolio_value, 4) as portfolio_value), round(case when total_invested > 0 then (portfolio_value / total_invested - 1) * 100 else 0 end, 4) as cumulative_return from dca")
def w12(spark, sf):
    return rounded(portfolio.dollar_cost_average(_monthly(spark, sf), 23952, 24011), 4)


@query("w13", "month_end", """select ticker, year_month, round(close_price * 100.0 / first_value(close_price) over (partition by ticker order by month_end_date), 6) as normalized from month_end""")
def w13(spark, sf):
    out = prices.normalized_series(_monthly(spark, sf), date="month_end_date")
    return rounded(out.select("ticker", "year_month", "normalized"))


_SPLIT = """vc as (select period, count(*) as n from features_wide group by period), cs as (select period, sum(n) over (order by period {o}) as cum from vc),
  tr as (select period from cs where cum <= floor((select count(*) from features_wide) * 0.7))
  select cik, period, period in (select period from tr) as train from features_wide"""


def _split(spark, sf, order):
    wide = X.features_wide(spark, sf).select("cik", "period")
    a, b = clean.split_by_columns(wide, 0.7, {"period": order})
    return a.withColumn("train", F.lit(True)).unionByName(b.withColumn("train", F.lit(False)))


@query("w14", "features_wide", f", {_SPLIT.format(o='')}")
def w14(spark, sf):
    return _split(spark, sf, "bottom")


@query("w14_top", "features_wide", f", {_SPLIT.format(o='desc')}")
def w14_top(spark, sf):
    return _split(spark, sf, "top")


@query("w14_random", "features_wide", """, vc as (select period, count(*) as n, ('0x' || md5(cast(period as varchar) || '|42')[1:8])::bigint as h from features_wide group by period),
  cs as (select period, sum(n) over (order by h, period) as cum from vc), tr as (select period from cs where cum <= floor((select count(*) from features_wide) * 0.7))
  select period in (select period from tr) as train, count(*) as n, count(distinct period) as periods from features_wide group by 1""")
def w14_random(spark, sf):
    return _split(spark, sf, "random").groupBy("train").agg(F.count("*").alias("n"), F.count_distinct("period").alias("periods"))


@query("w15", "scores", "select year_month, cik, ticker, round(y_pred_proba, 6) as y_pred_proba, row_number() over (partition by year_month order by y_pred_proba desc, cik, ticker) as rank from scores")
def w15(spark, sf):
    return rounded(selection.rank_scores(X.scores(spark, sf)).select("year_month", "cik", "ticker", "y_pred_proba", "rank"))


@query("w16", "ratios_wide", """, y as (select *, case when "Assets_0qtrs_current" > 0 then 1.0 when "Assets_0qtrs_current" is not null then 0.0 end as y from ratios_wide),
  t as (unpivot (select y, "GrossMargin_1qtrs_augment", "ROE_1qtrs_augment", "CurrentRatio_0qtrs_augment" from y where y is not null) on "GrossMargin_1qtrs_augment", "ROE_1qtrs_augment", "CurrentRatio_0qtrs_augment" into name feature value v),
  m as (select feature, quantile_cont(v, 0.5) as med from t group by feature),
  g as (select y, f.feature, coalesce(t.v, m.med, 0) as v from (select y, row_number() over () as i, "GrossMargin_1qtrs_augment", "ROE_1qtrs_augment", "CurrentRatio_0qtrs_augment" from y where y is not null) s
    cross join (select feature from m) f join m on m.feature = f.feature
    cross join lateral (select case f.feature when 'GrossMargin_1qtrs_augment' then "GrossMargin_1qtrs_augment" when 'ROE_1qtrs_augment' then "ROE_1qtrs_augment" else "CurrentRatio_0qtrs_augment" end as v) t),
  c as (select feature, abs(corr(v, y)) as r from g group by feature)
  select feature, round(r, 6) as correlation, row_number() over (order by r desc, feature) as rank from c""")
def w16(spark, sf):
    w = features.ratio_features(X.features_wide(spark, sf))
    a = F.col("Assets_0qtrs_current")
    w = w.withColumn("y", F.when(a > 0, 1.0).when(a.isNotNull(), 0.0)).filter("y is not null")
    return rounded(evaluate.feature_correlation(w, ["GrossMargin_1qtrs_augment", "ROE_1qtrs_augment", "CurrentRatio_0qtrs_augment"], "y"))


@query("k10", "sub_fine", "select cik, period, form as form_type, max(filed) as file_date from sub_fine where form in ('10-K', '10-Q') group by all")
def k10(spark, sf):
    from ledgerlight.operators.explore import filing_dates

    return filing_dates(X.sub_fine(spark, sf), C.FORMS).orderBy("cik", "file_date")


