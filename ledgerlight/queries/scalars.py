"""Scalar functions (X01-X31; X05-X07 are with the JSON sources)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight import config as C
from ledgerlight import fixtures as X
from ledgerlight.functions import dates as D
from ledgerlight.functions import numeric as N
from ledgerlight.functions import text as S
from ledgerlight.operators import evaluate, features, match
from ledgerlight.plans.features import filing_ratios
from ledgerlight.queries.aggregates import _BOUNDS, METRICS, _range_values, match_sql
from ledgerlight.queries.registry import query, rounded
from ledgerlight.sources.filings import datasets_by_recency


@query("x01", sql="select c_custkey as cik, lpad(cast(c_custkey as varchar), 10, '0') as padded from customer")
def x01(spark, sf):
    return X.table(spark, sf, "customer").select(F.col("c_custkey").alias("cik"), S.pad_cik(F.col("c_custkey")).alias("padded"))


_DAYS = """d as (select l_orderkey, datediff('day', cast(o_orderdate as date), cast(l_shipdate as date)) * (l_linenumber * 3) - l_linenumber as days
  from lineitem join orders on l_orderkey = o_orderkey)"""


def _days(spark, sf):
    li, o = X.table(spark, sf, "lineitem"), X.table(spark, sf, "orders")
    gap = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
    return li.join(o, li.l_orderkey == o.o_orderkey).select((gap * (F.col("l_linenumber") * 3) - F.col("l_linenumber")).alias("days"))


_NEAREST = "(select b from (values {v}) v(b) order by abs(b - days), b limit 1)"
_SIX = _NEAREST.format(v="(0), (91), (182), (273), (365), (730)")
_EIGHT = _NEAREST.format(v=", ".join(f"({b})" for b in C.QUARTER_DAYS_FINE))


@query("x02", sql=f"with {_DAYS}, u as (select days, count(*) as n from d group by days) select days, case when days <= 0 then days else {_SIX} end as rounded, n from u")
def x02(spark, sf):
    return _days(spark, sf).groupBy("days", D.round_quarter_days(F.col("days")).alias("rounded")).agg(F.count("*").alias("n"))


@query("x03", sql=f"""with {_DAYS}, u as (select days, count(*) as n from d group by days), b as (select *, {_EIGHT} as near from u)
  select days, case when days > 0 and abs(near - days) <= 15 then near else days end as rounded, n from b""")
def x03(spark, sf):
    return _days(spark, sf).groupBy("days", D.round_quarter_days_fine(F.col("days")).alias("rounded")).agg(F.count("*").alias("n"))


@query("x04", sql=f"""with {_DAYS}, u as (select case when days > 0 then {_SIX} else days end as near from d)
  select case near when 0 then 0 when 91 then 1 when 182 then 2 when 273 then 3 when 365 then 4 when 730 then 8 end as quarter, count(*) as n from u group by 1""")
def x04(spark, sf):
    q = D.days_to_quarter(D.round_quarter_days(F.col("days")))
    return _days(spark, sf).groupBy(q.alias("quarter")).agg(F.count("*").alias("n"))


@query("x08", sql="""select l_orderkey, l_linenumber, l_partkey, round(case when l_discount <> 0 and l_quantity > 3 then (l_extendedprice - 50000) / l_discount end, 6) as ratio from lineitem""")
def x08(spark, sf):
    num = F.when(F.col("l_quantity") > 3, F.col("l_extendedprice") - 50000)
    return rounded(X.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", N.safe_divide(num, F.col("l_discount")).alias("ratio")))


_RC = [r.column for r in C.RATIOS]


def _ratios(spark, sf):
    return features.ratio_features(X.features_wide(spark, sf))


@query("x09", "ratios_wide", "select cik, period, " + ", ".join(f'round("{c}", 6) as "{c}"' for c in _RC) + " from ratios_wide")
def x09(spark, sf):
    return rounded(_ratios(spark, sf).select("cik", "period", *_RC))


@query("x09_tall", "ratios_wide", "select cik, period, " + ", ".join(f'round("{c}", 6) as "{c}"' for c in _RC) + " from ratios_wide")
def x09_tall(spark, sf):
    tall = X.features_tall(spark, sf)
    keys = tall.select("cik", "period").distinct()
    return rounded(keys.join(features.tall_ratios(tall, ["cik", "period"]), ["cik", "period"], "left"))


def _defined_sql(legacy: bool) -> str:
    cols = []
    for r in C.RATIOS:
        num = " + ".join(f'({s if i == 0 or not legacy else -1} * "{t}_1qtrs_current")' for i, (s, t) in enumerate(r.numerator))
        den = f'"{r.denominator}_1qtrs_current"'
        cols.append(f'round(case when {den} <> 0 then ({num}) / {den} end, 6) as "{r.name}_augment"')
    return "select cik, period, " + ", ".join(cols) + " from features_wide"


@query("x10", "features_wide", _defined_sql(False))
def x10(spark, sf):
    return rounded(features.defined_ratios(X.features_wide(spark, sf)).select("cik", "period", *[f"{r.name}_augment" for r in C.RATIOS]))


@query("x10_legacy", "features_wide", _defined_sql(True))
def x10_legacy(spark, sf):
    return rounded(features.defined_ratios(X.features_wide(spark, sf), legacy=True).select("cik", "period", *[f"{r.name}_augment" for r in C.RATIOS]))


@query("x11", "features_wide", """select count("Assets_0qtrs_current") as exact, count("Revenues_1qtrs_current") as any_case, count("InventoryNet_1qtrs_current") as flexible,
  count("GrossProfit_1qtrs_current") as preferred, 1 as found_qtrs from features_wide""")
def x11(spark, sf):
    w = X.features_wide(spark, sf)
    col, qtrs = features.find_column_qtrs(w.columns, "GrossProfit", 4)
    names = {"exact": features.find_column(w.columns, "Assets", 0), "any_case": features.find_column(w.columns, "REVENUES", 1), "flexible": features.find_column(w.columns, "InventoryNet"), "preferred": col}
    return w.agg(*[F.count(c).alias(k) for k, c in names.items()]).withColumn("found_qtrs", F.lit(qtrs))


_HARD = " or ".join(
    [f'coalesce("{r.column}" > 1, false)' for r in C.RATIOS if r.name in C.MAX_ONE] + [f'coalesce("{r.column}" < 0, false)' for r in C.RATIOS if r.name in C.MIN_ZERO]
)


@query("x12", "ratios_wide", f"select cik, period, {_HARD} as flag_outlier from ratios_wide")
def x12(spark, sf):
    return features.hard_limit_flag(_ratios(spark, sf)).select("cik", "period", "flag_outlier")


_FLAGS = f"""{_BOUNDS}, {_range_values()}, hits as (select distinct cik, period from ratios_tall t join b using (ratio) join lim using (ratio) where {{w}})
  select w.cik, w.period, h.cik is not null as flag_outlier from ratios_wide w left join hits h on w.cik = h.cik and w.period = h.period"""
_EXTREME = "value < lo or value > hi"


@query("x13", "ratios_tall", ", " + _FLAGS.format(w=f"{_EXTREME} or value < tmin or value > tmax or value > ub or value < lb"))
def x13(spark, sf):
    return features.expected_range_flag(_ratios(spark, sf)).select("cik", "period", "flag_outlier")


@query("x14", "ratios_tall", ", " + _FLAGS.format(w=_EXTREME))
def x14(spark, sf):
    return features.extreme_flag(_ratios(spark, sf)).select("cik", "period", "flag_outlier")


@query("x15", "ratios_wide", """, p as (from (select cik, period, "Assets_0qtrs_current", "Revenues_1qtrs_current", "ROE_1qtrs_augment" from ratios_wide)
    unpivot include nulls (value for feature in ("Assets_0qtrs_current", "Revenues_1qtrs_current", "ROE_1qtrs_augment")))
  select cik, period, regexp_replace(feature, '(_current|_augment)$', '') as metric, round(value, 6) as value from p where feature like '%current' or value is not null""")
def x15(spark, sf):
    w = _ratios(spark, sf).select("cik", "period", "Assets_0qtrs_current", "Revenues_1qtrs_current", "ROE_1qtrs_augment")
    return rounded(features.metrics_map(w, ["cik", "period"]))


@query("x16", "row_scores", """select case when price_return >= 1.05 then 'good' when price_return <= 0.95 then 'bad' else 'mediocre' end as label_name, count(*) as n,
  round(min(price_return), 6) as low, round(max(price_return), 6) as high from row_scores group by 1""")
def x16(spark, sf):
    r = X.row_scores(spark, sf).withColumn("label_name", N.three_class(F.col("price_return"), 1.05, 0.95))
    return rounded(r.groupBy("label_name").agg(F.count("*").alias("n"), F.min("price_return").alias("low"), F.max("price_return").alias("high")))


@query("x17", "row_scores", "select label, case label when 1 then 'good' else 'bad' end as label_name, count(*) as n from row_scores group by all")
def x17(spark, sf):
    return evaluate.normalize_labels(X.row_scores(spark, sf), "label").groupBy("label", "label_name").agg(F.count("*").alias("n"))


@query("x17_three", sql="select l_returnflag as flag, case l_returnflag when 'A' then 'bad' when 'N' then 'mediocre' else 'good' end as label_name, count(*) as n from lineitem group by all")
def x17_three(spark, sf):
    rank = F.when(F.col("l_returnflag") == "A", -5.0).when(F.col("l_returnflag") == "N", 0.5).otherwise(7.0)
    li = X.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), rank.alias("y"))
    return evaluate.normalize_labels(li, "y").groupBy("flag", "label_name").agg(F.count("*").alias("n"))


@query("x18", "row_scores", "select round(l_discount, 6) as p_bad, round(score, 6) as p_good, round((-1 * l_discount + score + 1) / 2, 6) as expected from row_scores")
def x18(spark, sf):
    r = X.row_scores(spark, sf)
    return rounded(r.select(F.col("l_discount").alias("p_bad"), F.col("score").alias("p_good"), N.expected_score(F.col("l_discount"), F.col("score")).alias("expected")))


@query("x19", "row_scores", """, t as (select min(price_return) as lo, max(price_return) as hi from row_scores where price_return between 0.4 and 1.6)
  select round(price_return, 6) as price_return, round(least(greatest((price_return - lo) / (hi - lo), 0), 1), 6) as scaled, count(*) as n from row_scores, t group by all""")
def x19(spark, sf):
    r = X.row_scores(spark, sf)
    edge = r.filter("price_return between 0.4 and 1.6").agg(F.min("price_return").alias("lo"), F.max("price_return").alias("hi")).first()
    s = N.minmax_score(F.col("price_return"), F.lit(edge["lo"]), F.lit(edge["hi"]))
    return rounded(r.select("price_return", s.alias("scaled"))).groupBy("price_return", "scaled").agg(F.count("*").alias("n"))


@query("x20", "tag_names", "select tag, regexp_replace(tag, '([a-z])([A-Z])', '\\1 \\2', 'g') as words, count(*) as n from tag_names group by all")
def x20(spark, sf):
    return X.tag_names(spark, sf).groupBy("tag", F.array_join(S.split_camel(F.col("tag")), " ").alias("words")).agg(F.count("*").alias("n"))


def _phrases(spark, sf):
    p = X.table(spark, sf, "part")
    text = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" - The-"), F.col("p_type"), F.lit(" of the Interest, net"))).otherwise(
        F.replace(F.initcap(F.concat_ws(" ", "p_name", F.lower("p_type"))), F.lit(" "), F.lit(""))
    )
    return p.select("p_partkey", text.alias("text"))


def _sql_clean(col: str) -> str:
    out = f"regexp_replace(lower({col}), '[^a-z0-9_]', '', 'g')"
    for s in C.STOP_WORDS:
        out = f"replace({out}, '{s}', '')"
    return out


@query("x21", sql=f"""with p as (select p_partkey, case when p_size % 2 = 0 then p_name || ' - The-' || p_type || ' of the Interest, net'
    else array_to_string(list_transform(string_split(p_name || ' ' || lower(p_type), ' '), lambda w: upper(w[1]) || lower(w[2:])), '') end as text from part),
  w as (select p_partkey, text, case when contains(text, ' ') then string_split(text, ' ') else string_split(regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g'), ' ') end as ws from p),
  h as (select p_partkey, text, flatten(list_transform(ws, lambda x: string_split(x, '-'))) as hs from w)
  select p_partkey, text, array_to_string(list_filter(list_transform(hs, lambda x: {_sql_clean('x')}), lambda x: len(x) > 0), ' ') as words from h""")
def x21(spark, sf):
    return _phrases(spark, sf).select("p_partkey", "text", F.array_join(S.extract_words(F.col("text")), " ").alias("words"))


@query("x22", "tag_names", f", {match_sql('', 0.0)} select metric, tag, round(quick_score, 6) as quick_score, quick_rank from pre")
def x22(spark, sf):
    c = match.prefilter(match.candidates(X.tag_names(spark, sf), METRICS))
    return rounded(c.select("metric", "tag", "quick_score", "quick_rank"))


@query("x23", "tag_names", f", {match_sql('', 0.0)} select metric, tag, round(least(word_score, 1.0), 6) as word_score from ws")
def x23(spark, sf):
    c = match.match_scores(match.candidates(X.tag_names(spark, sf), METRICS))
    return rounded(c.select("metric", "tag", "word_score"))


@query("x24", "tag_names", f", {match_sql('', 0.0)} select metric, tag, round(score, 6) as score, all_words from scored")
def x24(spark, sf):
    c = match.match_scores(match.candidates(X.tag_names(spark, sf), METRICS))
    return rounded(c.select("metric", "tag", "score", "all_words"))


@query("x25", sql="select p_partkey, replace(lower(p_name || ' Stocks'), ' ', '_') as folder from part")
def x25(spark, sf):
    return X.table(spark, sf, "part").select("p_partkey", S.normalize_name(F.concat("p_name", F.lit(" Stocks"))).alias("folder"))


_NAMES = """names as (select distinct case when o_orderkey % 4 = 0 then strftime(o_orderdate, '%Y') when o_orderkey % 4 = 1 then strftime(o_orderdate, '%Y%m')
  when o_orderkey % 4 = 2 then 'notes' else year(o_orderdate) || 'q' || quarter(o_orderdate) end as name from orders)"""


@query("x26", sql=f"""with {_NAMES} select name, case when name like '%q%' then cast(split_part(name, 'q', 1) as int) when name ~ '^[0-9]+$' then cast(name as int) else 0 end as year,
  case when name like '%q%' then cast(split_part(name, 'q', 2) as int) else 0 end as part, case when name like '%q%' then 0 when name ~ '^[0-9]+$' then 1 else 3 end as kind from names""")
def x26(spark, sf):
    o, day = X.table(spark, sf, "orders"), F.col("o_orderdate")
    k = F.col("o_orderkey") % 4
    name = F.when(k == 0, F.date_format(day, "yyyy")).when(k == 1, F.date_format(day, "yyyyMM")).when(k == 2, "notes").otherwise(D.quarter_label(day))
    return datasets_by_recency(o.select(name.alias("name")).distinct()).select("name", "recency.*")


@query("x27", "features_tall", """, n as (select tag || '_' || qtrs || 'qtrs_' || case when cik % 3 = 0 then 'current' when cik % 3 = 1 then 'augment' else 'change_q' || (cik % 4) end as feature from features_tall)
  select feature, regexp_extract(feature, '^(.*)_([0-9]+)qtrs_', 1) as tag, cast(regexp_extract(feature, '_([0-9]+)qtrs_', 1) as int) as qtrs,
  regexp_extract(feature, 'qtrs_(.*)$', 1) as change_type, count(*) as n from n group by all""")
def x27(spark, sf):
    from ledgerlight.operators.explore import parse_feature_names

    t = X.features_tall(spark, sf)
    kind = F.when(F.col("cik") % 3 == 0, "current").when(F.col("cik") % 3 == 1, "augment").otherwise(F.concat(F.lit("change_q"), (F.col("cik") % 4).cast("string")))
    t = t.select(F.concat("tag", F.lit("_"), F.col("qtrs").cast("string"), F.lit("qtrs_"), kind).alias("feature"))
    return parse_feature_names(t).groupBy("feature", "tag", "qtrs", "change_type").agg(F.count("*").alias("n"))


_MISSING = ("Revenues", "InventoryNet")


@query("x28", "metric_facts", """, have as (select distinct tag from metric_facts where tag not in ('Revenues', 'InventoryNet')),
  u as (select unnest(['GrossMargin', 'OperatingMargin', 'NetMargin', 'ROE', 'ROA', 'CurrentRatio', 'CashRatio', 'DebtToEquity', 'DebtToAssets', 'InterestCoverage', 'AssetTurnover', 'ReceivablesTurnover']) as name)
  select 'metric' as kind, tag as name from have union all select 'ratio', name from u
  union all select 'substitute', 'RevenueFromContractWithCustomerExcludingAssessedTax' where (select count(*) from have) = 14""")
def x28(spark, sf):
    t = X.metric_facts(spark, sf).filter(~F.col("tag").isin(*_MISSING))
    mapping = {"Revenues": "RevenueFromContractWithCustomerExcludingAssessedTax"}
    found = features.metric_substitutes(t, mapping)
    metric = found.filter("tag is not null").select(F.lit("metric").alias("kind"), F.col("tag").alias("name")).distinct()
    ratio = features.usable_ratios(found).select(F.lit("ratio").alias("kind"), F.col("ratio").alias("name"))
    twice = found.filter("tag is not null").groupBy("tag").agg(F.count("*").alias("n")).filter("n > 1")
    return metric.union(ratio).union(twice.select(F.lit("substitute"), "tag"))


_TRACKED = [m for m in C.KEY_METRICS if m != "InventoryNet"] + ["Goodwill"]


@query("x29", "metric_facts", ", t(tag, tracked, in_ratio) as (values " + ", ".join(
    f"('{t}', {t in _TRACKED}, {any(t in r.tags for r in C.RATIOS)})" for t in sorted({*_TRACKED, *[x for r in C.RATIOS for x in r.tags]})
) + ") select t.*, count(distinct m.cik) as companies from t left join metric_facts m on m.tag = t.tag group by all")
def x29(spark, sf):
    return features.tag_coverage(X.metric_facts(spark, sf), _TRACKED)


@query("x30", sql="""select distinct cast(o_orderdate as date) as day, last_day(last_day(o_orderdate) - interval 6 month) as back, last_day(date_trunc('month', o_orderdate) + interval 3 month) as ahead,
  strftime(o_orderdate, '%Y-%m') as label from orders""")
def x30(spark, sf):
    d = X.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return d.select("day", D.shift_month_end(F.col("day"), -6).alias("back"), D.shift_month_end(F.col("day"), 3).alias("ahead"), D.month_label(D.month_index(F.col("day"))).alias("label"))


_X31 = [r.name for r in C.RATIOS]


def _either(tag: str) -> str:
    return f"(case when {tag}_1n > 0 then {tag}_1 else {tag}_0 end)"


def _x31_column(r: C.Ratio) -> str:
    num = " + ".join(f"({s} * {_either(t)})" for s, t in r.numerator)
    return f'round(case when {_either(r.denominator)} <> 0 then ({num}) / {_either(r.denominator)} end, 6) as "{r.name}_augment"'


@query("x31", "metric_facts", f""", f as (select distinct cik, tag, ddate, qtrs, ddate as period, '10-Q' as form, value from metric_facts),
  s as (select cik, tag, ddate, qtrs, period, form, max(value) as value from f group by all),
  h as (select cik, period, form, tag, qtrs, arg_max(value, ddate) as v from s group by all),
  a as (select cik, period, form, {", ".join(f"max(case when tag = '{t}' and qtrs = {q} then v end) as {t}_{q}" for t in C.KEY_METRICS for q in (0, 1))} from h group by all),
  w as (select *, {", ".join(f"count({t}_1) over (partition by cik) as {t}_1n" for t in C.KEY_METRICS)} from a qualify period = max(period) over (partition by cik))
  select cik, period, """ + ", ".join(_x31_column(r) for r in C.RATIOS if r.name in _X31) + " from w")
def x31(spark, sf):
    bulk = X.metric_facts(spark, sf).select(
        "adsh", "cik", "tag", F.lit("us-gaap").alias("version"), "ddate", "qtrs", "uom", F.lit("").alias("segments"), "value"
    )
    out = filing_ratios(bulk, "10-Q", C.KEY_METRICS)
    return rounded(out.select("cik", "period", *[f"{n}_augment" for n in _X31]))

