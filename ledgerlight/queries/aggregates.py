"""Aggregations (A01-A30)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight import config as C
from ledgerlight import fixtures as X
from ledgerlight.functions import dates as D
from ledgerlight.operators import clean, explore, facts, features, match, reconcile, selection
from ledgerlight.plans.features import build_features, build_tall_features, catchup_features
from ledgerlight.queries.registry import query, rounded

_KEY = "cik, tag, ddate, qtrs, period, form"


@query("a01", "facts", "select tag, count(adsh) as occurrences, count(distinct cik) as distinct_companies from facts group by tag")
def a01(spark, sf):
    return facts.tag_stats(X.facts(spark, sf))


@query("a02", "facts std", f"""select {_KEY}, count(distinct segments) as distinct_segments_non_null, bool_or(segments is null) as has_segment_null,
  count(*) = 1 as only_1_segment, bool_or(segments is null) or count(*) = 1 as has_summary_record from std group by all""")
def a02(spark, sf):
    return facts.segment_profile(clean.standard_facts(X.facts(spark, sf)))


@query("a03", "summary", f"select {_KEY}, segments, round(value, 6) as value, summary_flag, summary_reason from summary")
def a03(spark, sf):
    return rounded(facts.segment_summary(X.facts(spark, sf)))


_HIST = """pts as (select cik, period, form, tag, qtrs, strptime(cast(ddate as varchar), '%Y%m%d')::date as d, value from summary),
  crt as (select *, max(d) over w as crt_ddate, arg_max(value, d) over w as crt_value from pts window w as (partition by cik, period, form, tag, qtrs)),
  snap as (select *, crt_ddate - d as days from crt),
  q as (select *, case when days <= 0 then days else (select b from (values (0), (91), (182), (273), (365), (730)) v(b) order by abs(b - days), b limit 1) end as rd from snap),
  pts2 as (select *, case rd when 0 then 0 when 91 then 1 when 182 then 2 when 273 then 3 when 365 then 4 when 730 then 8 end as qi,
    case when crt_value <> 0 then (crt_value - value) / crt_value end as pd from q)"""


@query("a04", "summary", f""", {_HIST} select cik, period, form, tag, qtrs, crt_ddate, round(any_value(crt_value), 6) as crt_value, count(*) - 1 as num_historical_points,
  coalesce(string_agg(case when d < crt_ddate then cast(d as varchar) end, ',' order by d), '') as other_ddates,
  coalesce(string_agg(case when d < crt_ddate then cast(qi as varchar) end, ',' order by d), '') as quarter_intervals,
  round(coalesce(sum(case when d < crt_ddate then value end), 0), 4) as other_value_sum,
  round(coalesce(sum(case when d < crt_ddate then pd end), 0), 4) as pct_diff_sum from pts2 group by cik, period, form, tag, qtrs, crt_ddate""")
def a04(spark, sf):
    h = facts.history_comparisons(facts.segment_summary(X.facts(spark, sf)))

    def total(c):
        return F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))), 4)

    return h.select(
        "cik", "period", "form", "tag", "qtrs", "crt_ddate", F.round("crt_value", 6).alias("crt_value"),
        F.col("num_historical_points").cast("long").alias("num_historical_points"),
        F.array_join(F.transform("other_ddates", lambda d: d.cast("string")), ",").alias("other_ddates"),
        F.array_join(F.transform("quarter_intervals", lambda d: d.cast("string")), ",").alias("quarter_intervals"),
        total("other_values").alias("other_value_sum"), total("percentage_diffs").alias("pct_diff_sum"),
    )


@query("a05", "facts", """select cik, period, form, tag, qtrs, max(ddate) as crt_ddate, round(max((ddate, value))[2], 6) as crt_value from facts
  where form in ('10-K', '10-Q') and uom = 'USD' and value is not null and qtrs <= 4 and version <> cast(adsh as varchar) group by all""")
def a05(spark, sf):
    f = X.facts(spark, sf).withColumn("adsh", F.col("adsh").cast("string"))
    return rounded(facts.latest_values(f))


@query("a05_features", "facts", """, l as (select cik, period, form, tag, qtrs, max((ddate, value))[2] as v from facts
    where form in ('10-K', '10-Q') and uom = 'USD' and value is not null and qtrs <= 4 and version <> cast(adsh as varchar) group by all)
  select cik, period, form, 'catchup' as data_qtr, """ + ", ".join(f"round(max(case when tag = '{t}' and qtrs = {q} then v end), 6) as \"{t}_{q}qtrs_current\"" for t in ("LARGE", "PROMO") for q in (0, 1, 2)) + " from l group by all")
def a05_features(spark, sf):
    f = X.facts(spark, sf).withColumn("adsh", F.col("adsh").cast("string"))
    return rounded(catchup_features(f, ["LARGE", "PROMO"]))


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL"]
_ITEMS = [f"{t}_{q}qtrs" for t in _TYPES for q in (0, 1, 2)]


@query("a06", "facts std_q summary_q", ", crt as (select cik, period, form, filed_qtr, tag, qtrs, arg_max(value, ddate) as v from summary_q group by all) select cik, period, form, filed_qtr as data_qtr, "
       + ", ".join(f"round(max(case when tag = '{t}' and qtrs = {q} then v end), 6) as \"{t}_{q}qtrs_current\"" for t in _TYPES for q in range(C.MAX_QTRS + 1)) + " from crt group by all")
def a06(spark, sf):
    return rounded(build_features(X.facts(spark, sf), _TYPES, 0, "filed_qtr"))


@query("a06_tall", "facts std_q summary_q", """, crt as (select cik, period, form, filed_qtr, tag, qtrs, arg_max(value, ddate) as v from summary_q group by all)
  select cik, period, form, filed_qtr as data_qtr, tag, qtrs, round(v, 6) as value from crt""")
def a06_tall(spark, sf):
    return rounded(build_tall_features(X.facts(spark, sf), by="filed_qtr"))


@query("a07", "summary", f""", {_HIST}, cells as (select cik, period, form, tag || '_' || qtrs || 'qtrs' as item, qi, arg_min(pd, d) as pd from pts2
    where d < crt_ddate and qi between 1 and 2 and pd is not null and tag in ({", ".join(f"'{t}'" for t in _TYPES)}) group by all),
  base as (select distinct cik, period, form from pts)
  select base.cik, base.period, base.form, """
       + ", ".join(f"round(max(case when item = '{i}' and qi = {n} then pd end), 6) as \"{i}_change_q{n}\"" for i in _ITEMS for n in (1, 2))
       + " from base left join cells using (cik, period, form) group by all")
def a07(spark, sf):
    f = X.facts(spark, sf)
    h = facts.history_comparisons(facts.segment_summary(f))
    wide = facts.pivot_features(h, _TYPES, 2, facts.item_names(f, _TYPES))
    return rounded(wide.select("cik", "period", "form", *[c for c in wide.columns if "_change_" in c]))


_W = ", ".join(f'"{c}"' for c in X.WIDE_COLUMNS)
_COUNTS = f"""c as (select count(*) as n, {", ".join(f'count("{c}") as "{c}"' for c in X.WIDE_COLUMNS)} from features_wide),
  comp as (select row_number() over (order by k desc, feature) as rank, feature, k as non_null_count, round(k * 100.0 / n, 6) as non_null_percentage
  from (unpivot c on {_W} into name feature value k))"""


@query("a08", "features_wide", f", {_COUNTS} select * from comp")
def a08(spark, sf):
    return rounded(facts.completeness(X.features_wide(spark, sf)))




@query("a09", "features_tall", """, p as (select data_qtr, tag || '_' || qtrs as feature, count(value) as n from features_tall group by all),
  c as (select tag || '_' || qtrs as feature, count(value) as combined from features_tall where not (tag = 'Assets' and data_qtr = '1998q2') group by all)
  select feature, sum(n)::bigint as sum_of_parts, any_value(combined) as combined, (sum(n) - any_value(combined))::bigint as diff
  from p left join c using (feature) group by feature having sum(n) <> any_value(combined)""")
def a09(spark, sf):
    t = X.features_tall(spark, sf).withColumn("feature", F.concat("tag", F.lit("_"), F.col("qtrs").cast("string")))
    return reconcile.completeness_reconciliation(t, t.filter("not (tag = 'Assets' and data_qtr = '1998q2')"))


def _refiled(spark, sf):
    s = X.sub_fine(spark, sf)
    return s.select("cik", "period", D.quarter_label(F.col("filed")).alias("data_qtr"))


_REF = """refiled as (select cik, period, year(filed) || 'q' || quarter(filed) as data_qtr from sub_fine),
  dups as (select cik, period, count(distinct data_qtr) as quarters from refiled group by all having count(distinct data_qtr) > 1)"""


@query("a10", "sub_fine", f", {_REF} select * from dups")
def a10(spark, sf):
    return reconcile.duplicate_keys(_refiled(spark, sf))


@query("a10_histogram", "sub_fine", f", {_REF} select quarters, count(*) as keys, quarters = (select count(distinct data_qtr) from refiled) as in_all_quarters from dups group by quarters")
def a10_histogram(spark, sf):
    r = _refiled(spark, sf)
    return reconcile.duplicate_histogram(reconcile.duplicate_keys(r), r)


_PARSED = f"""{_COUNTS}, parsed as (select *, regexp_extract(feature, '^(.+?)(?:_(\\d+)qtrs)?_(current|augment|change_q\\d+)$', 1) as tag,
  cast(regexp_extract(feature, '^(.+?)(?:_(\\d+)qtrs)?_(current|augment|change_q\\d+)$', 2) as int) as qtrs,
  regexp_extract(feature, '^(.+?)(?:_(\\d+)qtrs)?_(current|augment|change_q\\d+)$', 3) as change_type from comp)"""


@query("a11", "features_wide", f""", {_PARSED} select tag, qtrs, change_type, count(*) as features, round(avg(non_null_percentage), 4) as mean_pct,
  round(sum(non_null_percentage), 4) as sum_pct, sum(non_null_count)::bigint as total_count from parsed group by grouping sets ((tag), (qtrs), (change_type))""")
def a11(spark, sf):
    return rounded(explore.feature_name_stats(facts.completeness(X.features_wide(spark, sf))), 4)


@query("a11_revenue", "features_wide", f""", {_COUNTS} select count(*) as features, round(avg(non_null_percentage), 4) as mean_pct, round(min(non_null_percentage), 4) as min_pct,
  round(max(non_null_percentage), 4) as max_pct from comp where contains(lower(feature), 'revenue')""")
def a11_revenue(spark, sf):
    return rounded(explore.matching_feature_stats(facts.completeness(X.features_wide(spark, sf))), 4)


_A12 = """select cik, name, count(distinct adsh) as num_forms, count(tag) as total_tags, count(distinct tag) as unique_tags, sum(custom_tag)::bigint as custom_tags,
  count(case when custom_tag = 0 then tag end) as total_standard_tags, count(distinct case when custom_tag = 0 then tag end) as unique_standard_tags
  from facts where form = '10-Q' group by cik, name"""


@query("a12", "facts", _A12)
def a12(spark, sf):
    return explore.company_form_stats(X.facts(spark, sf), "10-Q")


_A12_COLS = ["num_forms", "total_tags", "unique_tags", "custom_tags", "total_standard_tags", "unique_standard_tags"]


@query("a12_means", "facts", f", s as ({_A12}) select count(*) as companies, " + ", ".join(f"round(avg({c}), 6) as mean_{c}" for c in _A12_COLS) + " from s")
def a12_means(spark, sf):
    return rounded(explore.company_form_means(explore.company_form_stats(X.facts(spark, sf), "10-Q")))


_A13 = """d as (select distinct cik, name, tag, segments, qtrs, strptime(cast(ddate as varchar), '%Y%m%d')::date as d from facts
    where custom_tag = 0 and form = '10-Q' and value is not null),
  m as (select *, max(d) over (partition by cik, name, tag, segments, qtrs) - d as days from d),
  n as (select *, (select case when abs(b - days) <= 15 and days > 0 then b else days end
      from (values (91), (182), (273), (365), (456), (547), (638), (730)) v(b) order by abs(b - days), b limit 1) as rd from m),
  h as (select cik, name, tag, segments, qtrs, count(*) as distinct_ddate, max(d) as max_ddate, max(rd) as hist_horizon,
    coalesce(string_agg(case when days > 0 then cast(rd as varchar) end, ',' order by d), '') as time_intervals from n group by all)"""


@query("a13", "facts", f", {_A13} select * from h")
def a13(spark, sf):
    h = explore.date_history(X.facts(spark, sf), "10-Q")
    text = F.array_join(F.transform("time_intervals", lambda i: i.cast("string")), ",")
    return h.select("cik", "name", "tag", "segments", "qtrs", "distinct_ddate", "max_ddate", "hist_horizon", text.alias("time_intervals"))


@query("a13_stats", "facts", f""", {_A13}, many as (select * from h where distinct_ddate > 1),
  md as (select tag, distinct_ddate, row_number() over (partition by tag order by count(*) desc, distinct_ddate) as r from many group by tag, distinct_ddate)
  select many.tag, count(distinct cik) as distinct_cik, round(avg(many.distinct_ddate), 6) as mean_distinct_ddates, any_value(md.distinct_ddate) as mode_distinct_ddates,
  max(hist_horizon) as hist_horizon_max, quantile_cont(hist_horizon, 0.75) as hist_horizon_75pct, quantile_cont(hist_horizon, 0.5) as hist_horizon_median
  from many join md on many.tag = md.tag and md.r = 1 group by many.tag""")
def a13_stats(spark, sf):
    return rounded(explore.date_history_stats(explore.date_history(X.facts(spark, sf), "10-Q")))


_PROFILE = f"""prof as (select {_KEY}, count(distinct segments) as segs, bool_or(segments is null) as has_null, count(*) = 1 as one,
  bool_or(segments is null) or count(*) = 1 as has_summary from std group by all)"""


def _profile(spark, sf):
    return facts.segment_profile(clean.standard_facts(X.facts(spark, sf)))


@query("a14", "std", f""", {_PROFILE}, ranked as (select tag, row_number() over (order by count(distinct cik) desc, tag) - 1 as rank from facts group by tag)
  select tag, round(avg(cast(has_summary as int)), 6) as summary_share, any_value(rank) as rank from prof join ranked using (tag)
  group by tag having avg(cast(has_summary as int)) < 0.95 and any_value(rank) < 500""")
def a14(spark, sf):
    stats = facts.tag_stats(X.facts(spark, sf))
    return rounded(explore.tags_lacking_summary(_profile(spark, sf), explore.rank_tags(stats), 0.95))


@query("a14_totals", "std", f""", {_PROFILE} select count(*) as groups, count(*) filter (has_null) as with_null, count(*) filter (one) as single,
  count(*) filter (has_summary) as with_summary, count(*) filter (segs > 1 and not has_summary) as problematic from prof""")
def a14_totals(spark, sf):
    return explore.profile_totals(_profile(spark, sf))


_A15 = ["Assets", "Revenues", "InventoryNet", "Goodwill"]


@query("a15", "customer_facts", ", q as (select * from customer_facts where form = '10-Q'), t(tag) as (values " + ", ".join(f"('{t}')" for t in _A15) + """)
  select t.tag, count(distinct q.cik) as companies, round(count(distinct q.cik) * 100.0 / (select count(distinct cik) from q), 6) as pct
  from t left join q on q.tag = t.tag group by t.tag""")
def a15(spark, sf):
    return rounded(explore.tag_population(X.metric_facts(spark, sf, by_customer=True), _A15))


@query("a16", "customer_facts", """, per as (select cik, max(cast(tag = 'Revenues' as int)) as a, max(cast(contains(lower(tag), 'revenuefromcontract') as int)) as b
    from customer_facts where tag = 'Revenues' or contains(lower(tag), 'revenuefromcontract') group by cik)
  select count(*) filter (a = 1) as using_first, count(*) filter (b = 1) as using_second, count(*) filter (a = 1 and b = 1) as using_both from per""")
def a16(spark, sf):
    return explore.tag_pair_companies(X.metric_facts(spark, sf, by_customer=True), "Revenues", "RevenueFromContract")


@query("a16_usage", "facts", """, u as (select cik, fy, fp, tag, version, count(*) as count from facts where tag = 'PROMO' or contains(lower(tag), 'econ') group by all)
  select * from u where cik in (select cik from u group by cik having bool_or(tag = 'PROMO') and bool_or(contains(lower(tag), 'econ')))""")
def a16_usage(spark, sf):
    return explore.tag_pair_usage(X.facts(spark, sf), "PROMO", "Econ")


@query("a17", "facts", """, ranked as (select tag, row_number() over (order by count(distinct cik) desc, tag) as rank from facts group by tag)
  select tag, count(*) as count, any_value(rank) as rank from facts join ranked using (tag) where custom_tag = 0 and contains(lower(tag), 'm') group by tag""")
def a17(spark, sf):
    f = X.facts(spark, sf)
    return explore.popular_matches(f, explore.rank_tags(facts.tag_stats(f), 1), "M")


@query("a18", "sub_fine", """, per as (select cik, max(cast(form = '10-K' as int)) as a, max(cast(form = '10-Q' as int)) as b from sub_fine group by cik)
  select count(*) filter (a = 1) as with_first, count(*) filter (b = 1) as with_second, count(*) filter (a = 1 and b = 1) as with_both from per""")
def a18(spark, sf):
    return explore.form_overlap(X.sub_fine(spark, sf))


def _ratios(spark, sf):
    return features.ratio_features(X.features_wide(spark, sf))


_BOUNDS = """qs as (select ratio, count(value) as n, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as med, quantile_cont(value, 0.75) as q3, avg(value) as mean
    from ratios_tall group by ratio),
  b as (select *, case when q3 > q1 then q1 - 3 * (q3 - q1) end as lo, case when q3 > q1 then q3 + 3 * (q3 - q1) end as hi from qs)"""


def _range_values():
    rows = []
    for r in C.RATIOS:
        vals = ["null" if v is None else repr(float(v)) for v in C.EXPECTED_RANGES[r.name]]
        rows.append(f"('{r.column}', " + ", ".join(f"cast({v} as double)" for v in vals) + ")")
    return "lim(ratio, tmin, tmax, ub, lb) as (values " + ", ".join(rows) + ")"


@query("a19", "ratios_tall", f""", {_BOUNDS}, {_range_values()}, x as (select t.*, b.lo, b.hi, b.med, b.mean, lim.tmin, lim.tmax, lim.ub, lim.lb
    from ratios_tall t join b using (ratio) join lim using (ratio))
  select ratio, count(*) as non_null, round(any_value(mean), 4) as mean_value, round(any_value(med), 4) as median_value,
  count(*) filter (value < tmin) as below_typical_min, count(*) filter (value > tmax) as above_typical_max, count(*) filter (value > ub) as exceeds_upper_bound,
  count(*) filter (value < lb) as below_lower_bound, count(*) filter (value < lo or value > hi) as extreme_iqr,
  round(min(value) filter (value < lo or value > hi), 4) as min_outlier, round(max(value) filter (value < lo or value > hi), 4) as max_outlier,
  coalesce(abs(any_value(mean) / nullif(any_value(med), 0)) > 10 or abs(any_value(mean) / nullif(any_value(med), 0)) < 0.1, false) as mean_median_flag
  from x group by ratio""")
def a19(spark, sf):
    return rounded(features.outlier_report(_ratios(spark, sf)), 4)


@query("a20", "ratios_tall", f""", {_BOUNDS}, f as (select cik, period, count(*) as k from ratios_tall join b using (ratio) where value < lo or value > hi group by all)
  select (select count(*) from ratios_wide) as total_rows, (select coalesce(sum(k), 0)::bigint from f) as outliers_without_overlap, (select count(*) from f) as outlier_rows,
  (select coalesce(sum(k), 0)::bigint - count(*) from f) as overlap""")
def a20(spark, sf):
    return features.outlier_overlap(_ratios(spark, sf))


@query("a21", "ratios_wide", """, sic as (select cik, any_value(sic) as sic from metric_facts group by cik)
  select sic, period, count(distinct w.cik) as companies, round(avg("Assets_0qtrs_current"), 6) as "Assets_0qtrs_current", round(avg("CurrentRatio_0qtrs_augment"), 6) as "CurrentRatio_0qtrs_augment"
  from ratios_wide w join sic using (cik) group by sic, period""")
def a21(spark, sf):
    sic = X.metric_facts(spark, sf).select("cik", "sic").distinct()
    return rounded(features.industry_benchmark(_ratios(spark, sf), sic, ["Assets_0qtrs_current", "CurrentRatio_0qtrs_augment"]))


@query("a22", "sub_fine", """, s as (select cik, adsh, filed, case when adsh % 7 = 0 then '' else sic || (adsh % 3) end as sic from sub_fine)
  select cik, arg_max(sic, (filed, adsh)) as sic from s where trim(sic) <> '' group by cik""")
def a22(spark, sf):
    code = F.when(F.col("adsh") % 7 == 0, "").otherwise(F.concat("sic", (F.col("adsh") % 3).cast("string")))
    return explore.latest_sic(X.sub_fine(spark, sf).withColumn("sic", code))


@query("a23", "sub_fine", "select cik, period, form as form_type, max(filed) as file_date from sub_fine where form in ('10-K', '10-Q') group by all")
def a23(spark, sf):
    return explore.filing_dates(X.sub_fine(spark, sf), C.FORMS)


@query("a24", "prices_multi", "select cik, ticker, max(date) as date from prices_multi group by all")
def a24(spark, sf):
    return explore.dedupe_events(X.prices(spark, sf, multi=True))


@query("a25", "sub_fine", """, s as (select *, period < 20000101 as in_bulk, sic = 'BUILDING' as in_cu, exists(select 1 from lineitem where l_orderkey = adsh and l_quantity > 10) as has from sub_fine),
  c as (select cik, count(*) filter (not in_bulk and not in_cu) as fresh from s group by cik),
  l as (select case when fresh = 0 then case when in_bulk then 'already_in_batch' else 'already_in_catchup' end
      when in_bulk or in_cu then null when has then 'downloaded' else 'no_xbrl_facts' end as action from s join c using (cik))
  select action, count(*) as n from l where action is not null group by action""")
def a25(spark, sf):
    s = X.sub_fine(spark, sf)
    have = X.table(spark, sf, "lineitem").filter("l_quantity > 10").select(F.col("l_orderkey").alias("adsh"))
    out = reconcile.catchup_actions(s, s.filter("period < 20000101"), s.filter("sic = 'BUILDING'"), have)
    return out.groupBy("action").agg(F.count("*").alias("n"))


METRICS = ["BlueGear", "SmallRing", "RedWidgetPromo", "HotBoltSmallEconomy"]


def _company_matches(spark, sf):
    return match.tag_matches(X.tag_names(spark, sf), METRICS, 0.6, keys=["cik"])


MATCH_SQL = """words as (select distinct {keys} tag, list_transform(regexp_split_to_array(regexp_replace(tag, '([a-z])([A-Z])', '\\1 \\2', 'g'), ' '),
    lambda w: {stops}) as tw from tag_names),
  ms(metric, mw) as (values {metrics}),
  cand as (select *, list_filter(tw, lambda w: len(w) > 0) as tw2 from words cross join ms),
  sc as (select {keys} metric, tag, mw, tw2 as tw, 0.6 * len(list_intersect(mw, tw2)) / len(list_distinct(mw))
    + 0.4 * (1.0 - levenshtein(lower(metric), lower(tag)) / greatest(len(metric), len(tag))) as quick_score,
    1.0 - levenshtein(lower(metric), lower(tag)) / greatest(len(metric), len(tag)) as phrase from cand),
  pre as (select *, row_number() over (partition by {keys} metric order by quick_score desc, tag) as quick_rank from sc qualify quick_rank <= 50),
  best as (select *, list_transform(mw, lambda w: list_max(list_transform(tw, lambda o: 1.0 - levenshtein(w, o) / greatest(len(w), len(o))))) as bs from sc where len(tw) > 0),
  ws as (select *, list_sum(bs) / len(mw) * 0.6 + len(list_filter(bs, lambda s: s >= 0.7)) / len(mw) * 0.4 as word_score,
    len(list_intersect(mw, tw)) = len(list_distinct(mw)) as all_words, len(list_distinct(mw)) = len(list_distinct(tw)) as same_size from best),
  scored as (select *, case when all_words and same_size then 1.0 when all_words and 0.7 * least(word_score, 1) + 0.3 * phrase >= 0.7
    then least(0.7 * least(word_score, 1) + 0.3 * phrase + 0.1, 1.0) else 0.7 * least(word_score, 1) + 0.3 * phrase end as score from ws),
  matches as (select {keys} metric, tag, score, row_number() over (partition by {keys} metric order by round(score, 9) desc, all_words desc, length(tag), tag) as match_rank
    from scored where score >= {threshold} - 1e-12 qualify match_rank <= 5)"""


def _sql_words(metric: str) -> str:
    words = "".join(" " + c if c.isupper() else c for c in metric).split()
    out = []
    for w in words:
        w = w.lower()
        for s in C.STOP_WORDS:
            w = w.replace(s, "")
        if w:
            out.append(w)
    return "[" + ", ".join(f"'{w}'" for w in out) + "]"


def match_sql(keys: str, threshold: float) -> str:
    stops = "lower(w)"
    for s in C.STOP_WORDS:
        stops = f"replace({stops}, '{s}', '')"
    metrics = ", ".join(f"('{m}', {_sql_words(m)})" for m in METRICS)
    return MATCH_SQL.format(keys=keys, stops=stops, metrics=metrics, threshold=threshold)


@query("a26", "tag_names", f""", {match_sql('cik,', 0.6)}, votes as (select metric, tag, count(distinct cik) as companies from matches group by all)
  select *, row_number() over (partition by metric order by companies desc, tag) as place from votes qualify place <= 2""")
def a26(spark, sf):
    return match.vote_tags(_company_matches(spark, sf))


@query("a27", "tag_names", f""", {match_sql('cik,', 0.6)}, f as (select * from matches where match_rank = 1),
  p as (select metric, count(distinct tag) as tags, count(distinct cik) as companies from f group by metric)
  select ms.metric, coalesce(tags, 0) as tags, coalesce(companies, 0) as companies, case when coalesce(companies, 0) = 0 then 4 when tags > 1 then 3 when companies = 25 then 1 else 2 end as category
  from ms left join p on ms.metric = p.metric""")
def a27(spark, sf):
    return match.agreement(_company_matches(spark, sf), 25, METRICS)


@query("a28", "scores", "select year_month, round(avg(price_return), 6) as market_return, count(*) as companies from scores group by all")
def a28(spark, sf):
    return rounded(selection.market_average(X.scores(spark, sf)))


@query("a29", "ratios_tall", """, g as (select ratio, count(value) as non_null, round(avg(value), 4) as mean_value, round(stddev_samp(value), 4) as std_value,
  round(quantile_cont(value, 0.5), 4) as median_value from ratios_tall group by ratio) select * from g""")
def a29(spark, sf):
    return rounded(features.ratio_stats(_ratios(spark, sf)), 4)
