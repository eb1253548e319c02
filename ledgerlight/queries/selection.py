"""Top-k and strategies (K01-K09) and strategy results (M19-M21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight import config as C
from ledgerlight import fixtures as X
from ledgerlight.operators import facts, match, reconcile, selection
from ledgerlight.plans.backtest import compare_with_benchmark
from ledgerlight.queries.aggregates import METRICS, match_sql
from ledgerlight.queries.joining import _BENCH, _STR, _score_trends
from ledgerlight.queries.registry import query, rounded
from ledgerlight.queries.windows import DCA, HOLD, _monthly


@query("k01", "tag_names", "select tag, row_number() over (order by count(distinct cik) desc, tag) as rank from tag_names group by tag qualify rank <= 20")
def k01(spark, sf):
    t = X.tag_names(spark, sf).withColumn("adsh", F.lit(1))
    return facts.top_tags(facts.tag_stats(t), 20)


_COLS = "year_month, cik, ticker, round(y_pred_proba, 6) as y_pred_proba, round(price_return, 6) as price_return"
_RANK = "row_number() over (partition by year_month order by y_pred_proba desc, cik, ticker)"


def _pick(spark, sf, strategy):
    out = selection.pick(X.scores(spark, sf), strategy)
    return rounded(out.select("year_month", "cik", "ticker", "y_pred_proba", "price_return", "rank"))


@query("k02", "scores", f"select {_COLS}, {_RANK} as rank from scores qualify rank <= 5")
def k02(spark, sf):
    return _pick(spark, sf, C.STRATEGIES[0])


@query("k03", "scores", f"select {_COLS}, {_RANK} as rank from scores where scores.y_pred_proba >= 0.8")
def k03(spark, sf):
    return _pick(spark, sf, C.STRATEGIES[2])


@query("k04", "scores", f"select {_COLS}, {_RANK} as rank from scores where scores.y_pred_proba between 0.75 and 0.85")
def k04(spark, sf):
    return _pick(spark, sf, C.STRATEGIES[4])


@query("k05", "scores", f"select {_COLS}, {_RANK} as rank from scores where scores.y_pred_proba between 0.75 and 0.85 qualify rank <= 10")
def k05(spark, sf):
    return _pick(spark, sf, C.STRATEGIES[5])


STRATEGY_SQL = "strat(strategy_name, lo, hi, lim) as (values " + ", ".join(
    f"('{s.name}', {s.low if s.low is not None else -1e9}, {s.high if s.high is not None else 1e9}, {s.limit if s.limit is not None else 10**9})" for s in C.STRATEGIES
) + """), picks as (select strategy_name, scores.*, row_number() over (partition by strategy_name, year_month order by y_pred_proba desc, cik, ticker) as rank
  from scores join strat on y_pred_proba between lo and hi qualify rank <= max(lim) over (partition by strategy_name))"""


@query("k06", "scores", f", {STRATEGY_SQL} select strategy_name, {_COLS}, rank from picks")
def k06(spark, sf):
    out = selection.pick_all(X.scores(spark, sf))
    return rounded(out.select("strategy_name", "year_month", "cik", "ticker", "y_pred_proba", "price_return", F.col("rank")))


@query("k07", "sub_fine", """select adsh, cik, name, sic, form, period, filed from sub_fine where not (period < 19980101)
  qualify row_number() over (partition by cik order by filed desc, adsh desc) <= 2""")
def k07(spark, sf):
    s = X.sub_fine(spark, sf)
    return reconcile.unknown_filings(s, s.filter("period < 19980101"), 2)


@query("k08", "tag_names", f", {match_sql('', 0.4)} select metric, tag, round(score, 6) as score, match_rank from matches")
def k08(spark, sf):
    return rounded(match.tag_matches(X.tag_names(spark, sf), METRICS, 0.4))


@query("k09", "scores", f"select distinct ticker from (select ticker from scores qualify {_RANK} <= 3)")
def k09(spark, sf):
    return selection.ever_top(X.scores(spark, sf), 3)


@query("m19", "scores score_prices", f""", {STRATEGY_SQL}, {_STR}, s as (select strategy_name, count(*) as picks, avg(price_return) as mean_return, avg(y_pred_proba) as mean_score, stddev_samp(y_pred_proba) as std_score,
    min(y_pred_proba) as min_score, max(y_pred_proba) as max_score, quantile_cont(y_pred_proba, 0.25) as q1_score, quantile_cont(y_pred_proba, 0.5) as median_score,
    quantile_cont(y_pred_proba, 0.75) as q3_score from picks group by 1),
  l as (select strategy_name, count(*) as with_long_term, avg(st.price_return) as mean_long_return from picks p join st on p.cik = st.cik and p.year_month = st.year_month group by 1)
  select s.strategy_name, picks, round(mean_return, 6) as mean_return, round(mean_score, 6) as mean_score, round(std_score, 6) as std_score, round(min_score, 6) as min_score, round(max_score, 6) as max_score,
  round(q1_score, 6) as q1_score, round(median_score, 6) as median_score, round(q3_score, 6) as q3_score, coalesce(with_long_term, 0) as with_long_term, round(mean_long_return, 6) as mean_long_return from s left join l using (strategy_name)""")
def m19(spark, sf):
    return rounded(selection.finalize(selection.pick_all(X.scores(spark, sf)), _score_trends(spark, sf)))


@query("m20", "scores score_prices", f", {_STR}, {_BENCH.replace('23964', '23976').replace('23988', '24000')}")
def m20(spark, sf):
    return rounded(selection.benchmark(X.scores(spark, sf), _score_trends(spark, sf), 23976, 24000))


@query("m21", "scores score_prices month_end", f""", {HOLD.format(k=5)}, {DCA}, b as (select year_month, portfolio_value as benchmark_value,
    case when total_invested > 0 then (portfolio_value / total_invested - 1) * 100 else 0 end as benchmark_return from dca where ticker = 'T1')
  select hold.year_month, round(portfolio_value, 4) as portfolio_value, total_invested, num_stocks, round(cumulative_return, 4) as cumulative_return,
  round(benchmark_value, 4) as benchmark_value, round(benchmark_return, 4) as benchmark_return, round(cumulative_return - benchmark_return, 4) as excess_return
  from hold left join b on hold.year_month = b.year_month""")
def m21(spark, sf):
    index = _monthly(spark, sf).filter("ticker = 'T1'")
    return rounded(compare_with_benchmark(X.scores(spark, sf), X.score_prices(spark, sf), index, 5, start=23952, end=24011), 4)


