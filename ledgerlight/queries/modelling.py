"""Datasets, models, evaluation and back-tests (M01-M24; M19-M21 are with the strategies).

Forests run with the operators' defaults over every month of the test years; boosted models and the
network with fewer rounds and epochs (see the README). Rows are never left out. They return what
does not depend on the trainer (rows scored, classes, picks of limited strategies, values in range),
which SQL can repeat, and whether a target that can be learned was.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight import config as C
from ledgerlight import fixtures as X
from ledgerlight.functions.numeric import three_class
from ledgerlight.operators import clean, evaluate, models, prices, selection
from ledgerlight.plans import backtest, dataset
from ledgerlight.queries.registry import query, rounded
from ledgerlight.queries.scalars import _HARD
from ledgerlight.session import durable

SMALL = {"rf": {"numTrees": 10, "maxDepth": 5}, "boosted": {"maxIter": 5, "maxDepth": 4}}


def _company_trends(spark, sf):
    m = prices.month_end_prices(X.prices(spark, sf, company=True), tiebreak="tiebreak")
    return prices.price_trends(m, [C.HORIZONS[3]]).drop("horizon")


def _data(spark, sf):
    return dataset.assemble(X.features_wide(spark, sf), _company_trends(spark, sf))


_M01 = [*X.WIDE_COLUMNS, *[r.column for r in C.RATIOS]]
_GRADS = [(c, q) for c in _M01 for q in C.GRADIENT_QUARTERS]


def _base(c: str) -> str:
    return c.removesuffix("_current").removesuffix("_augment")


@query("m01", "ratios_wide trends_company", f""", f as (select *, (period // 10000) * 12 + (period // 100) % 100 - 1 as m, {_HARD} as bad from ratios_wide)
  select f.cik, f.period, f.m as year_month, t.ticker, t.trend_up_or_down, round(t.price_return, 6) as price_return, """
       + ", ".join(f'round(f."{c}", 6) as "{c}"' for c in _M01) + ", "
       + ", ".join(f'round(case when h{q}."{c}" <> 0 then (f."{c}" - h{q}."{c}") / h{q}."{c}" end, 6) as "{_base(c)}_change_q{q}"' for c, q in _GRADS)
       + " from f " + " ".join(f"left join f h{q} on h{q}.cik = f.cik and h{q}.m = f.m - {3 * q}" for q in C.GRADIENT_QUARTERS)
       + " join trends_company t on t.cik = f.cik and t.year_month = f.m and t.horizon = 1 where not f.bad")
def m01(spark, sf):
    cols = ["cik", "period", "year_month", "ticker", "trend_up_or_down", "price_return", *_M01, *[f"{_base(c)}_change_q{q}" for c, q in _GRADS]]
    return rounded(_data(spark, sf).select(*cols))


_D = f""", f as (select *, (period // 10000) * 12 + (period // 100) % 100 - 1 as m, {_HARD} as bad from ratios_wide),
  d as (select f.*, f.m as year_month, t.ticker, t.trend_up_or_down, t.price_return, case when price_return >= 1.05 then 'good' when price_return <= 0.95 then 'bad' else 'mediocre' end as class
    from f join trends_company t on t.cik = f.cik and t.year_month = f.m and t.horizon = 1 where not f.bad), test as (select * from d where year_month >= 24000)"""
_CTES = "ratios_wide trends_company"
_COLS = [*X.WIDE_COLUMNS, *[r.column for r in C.RATIOS]]
_AUG = [r.column for r in C.RATIOS]


def _split(spark, sf):
    """Checkpointed train and test rows, split at a month."""
    d = durable(_data(spark, sf))
    return d.filter("year_month < 24000"), d.filter("year_month >= 24000")


def _inside(*cols):
    """Whether all these values of one row lie in [0, 1]."""
    return F.least(*[F.coalesce(F.col(c).between(0, 1).cast("int"), F.lit(0)) for c in cols]) == 1 if len(cols) > 1 else F.col(cols[0]).between(0, 1)


@query("m02", _CTES, f"{_D} select count(*) as n, true as scores_inside, true as metrics_inside from test")
def m02(spark, sf):
    train, test = _split(spark, sf)
    a, b, used = models.indicate_missing(train, test, clean.suffix_columns(train.columns, ["_current", "_augment"]))
    scored = durable(models.classify(a, b, used, model="rf")[0])
    none = F.lit(scored.isEmpty())  # no test row: nothing lies outside
    metrics = models.classification_metrics(scored, "trend_up_or_down").select((none | _inside("accuracy", "precision", "recall", "roc_auc")).alias("metrics_inside"))
    return scored.agg(F.count("*").alias("n"), (none | F.bool_and(_inside("y_pred_proba"))).alias("scores_inside")).crossJoin(metrics)


@query("m02_importance", sql="with t(feature) as (values " + ", ".join(f"('{c}')" for c in _AUG) + f") select feature, true as inside, {len(_AUG)}::bigint as ranks from t")
def m02_importance(spark, sf):
    train, test = _split(spark, sf)
    a, b = clean.impute_median(train, test, _AUG)
    _, fitted = models.classify(a, b, _AUG, model="boosted", **SMALL["boosted"])
    found = models.importances(fitted, _AUG, spark)
    return found.crossJoin(found.agg(F.count_distinct("rank").alias("ranks"))).select("feature", _inside("importance").alias("inside"), "ranks")


_GRID = [f"{s}_{i}_{m}" for s in ("completeness", "current", "change", "all") for i in ("none", "median") for m in ("rf", "boosted")]


@query("m03", sql="with t(approach) as (values " + ", ".join(f"('{a}')" for a in _GRID) + ") select approach, true as inside from t")
def m03(spark, sf):
    """All selections, imputations and models."""
    train, test = _split(spark, sf)
    table, _ = models.model_grid(train, test, clean.feature_columns(train), params=SMALL)
    return table.select("approach", (F.lit(test.isEmpty()) | _inside("accuracy", "precision", "recall", "roc_auc")).alias("inside"))


@query("m04", _CTES, f"{_D}, t(model) as (values " + ", ".join(f"('{m}')" for m in models.REGRESSORS) + ") select model, count(*) as n, true as sane from test, t group by model")
def m04(spark, sf):
    """All regressors."""
    train, test = _split(spark, sf)
    cols = clean.suffix_columns(train.columns, ["_current", "_augment"])
    a, b = clean.impute_median(train, test, cols)
    out = None
    for name in models.REGRESSORS:
        small = SMALL["rf"] if name == "random_forest" else SMALL["boosted"]
        report = models.regression_report(models.regress(a, b, cols, model=name, **small)[0])
        sane = (F.col("r2") <= 1) & (F.col("rmse") > 0) & F.col("auc_trend").between(0, 1)
        row = report.filter("n > 0").select(F.lit(name).alias("model"), "n", sane.alias("sane"))
        out = row if out is None else out.unionByName(row)
    return out


@query("m05", _CTES, f"""{_D}, train as (select * from d where year_month < 24000), pc as (select period, count(*) as n from train group by 1),
  cum as (select period, sum(n) over (order by period) as c from pc), edge as (select max(period) as p from cum where c <= floor((select count(*) from train) * 0.7)),
  med as (select """ + ", ".join(f'quantile_cont("{c}", 0.5) as m{i}' for i, c in enumerate(_COLS)) + """ from train),
  k as (select """ + " + ".join(f'coalesce((var_samp(coalesce("{c}", m{i}, 0)) <> 0)::int, 1)' for i, c in enumerate(_COLS)) + """ as features from train, med, edge where period <= p)
  select class, count(*) as n, case when period <= p then 'train' else 'validation' end as part, features from train, edge, k group by all
  union all select class, count(*), 'test', any_value(features) from test, k group by class""")
def m05(spark, sf):
    train, test = _split(spark, sf)
    fit, val, rows, cols = models.prepare_three_class(train, test, rules={"period": "bottom"})
    parts = [d.groupBy("class").agg(F.count("*").alias("n")).withColumn("part", F.lit(p)) for p, d in (("train", fit), ("validation", val), ("test", rows))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("features", F.lit(len(cols)))


def _three(spark, sf):
    train, test = _split(spark, sf)
    fit, _, rows, cols = models.prepare_three_class(train, test, rules={"period": "bottom"})
    return models.classify_three(fit, rows, cols, layers=(16, 8), epochs=20)


@query("m06", _CTES, f"{_D} select cik, period, ticker, class, true as inside, true as known_class, true as sums_to_one from test")
def m06(spark, sf):
    total = F.abs(F.col("p_bad") + F.col("p_mediocre") + F.col("p_good") - 1) < 1e-6
    return _three(spark, sf).select(
        "cik", "period", "ticker", "class", _inside("p_bad", "p_mediocre", "p_good", "y_pred_proba").alias("inside"), F.col("predicted").isin(*models.CLASSES).alias("known_class"),
        total.alias("sums_to_one"),
    )


@query("m07", sql="select true as accuracy_inside, true as auc_inside, true as correlation_inside")
def m07(spark, sf):
    r = models.three_class_report(_three(spark, sf))
    return r.select(_inside("accuracy").alias("accuracy_inside"), _inside("auc_trend").alias("auc_inside"), F.coalesce(F.col("corr_label").between(-1, 1), F.lit(True)).alias("correlation_inside"))


@query("m07_confusion", _CTES, f"{_D} select class, count(*) as n from test group by class")
def m07_confusion(spark, sf):
    return evaluate.confusion_matrix(_three(spark, sf), "class", "predicted").groupBy("class").agg(F.sum("n").alias("n"))


_M08 = """with e as (select vec_id, label, vec_id // 256 as batch, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
  u as (select vec_id, label, batch, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v from e),
  p as (select a.vec_id, a.batch, exp(list_dot_product(a.v, b.v) / 0.1) as s, a.label = b.label as same from u a join u b on a.batch = b.batch and a.vec_id <> b.vec_id)"""


def _rule():
    """A class that follows from the columns: what a model can learn."""
    return F.when(F.col("cik") % 3 == 0, "good").when(F.col("cik") % 3 == 1, "bad").otherwise("mediocre")


@query("m07_matrix", _CTES, f"{_D} select class, case cik % 3 when 0 then 'good' when 1 then 'bad' else 'mediocre' end as predicted, count(*) as n from d group by all")
def m07_matrix(spark, sf):
    """The whole matrix of a prediction that SQL can repeat."""
    d = _data(spark, sf).withColumn("class", three_class(F.col("price_return"), 1.05, 0.95))
    return evaluate.confusion_matrix(d.withColumn("predicted", _rule()), "class", "predicted")


_LEARNERS = ["rf", "boosted", *models.REGRESSORS, "three_class"]


@query("m02_learnable", _CTES, f"{_D}, t(model) as (values " + ", ".join(f"('{m}')" for m in _LEARNERS) + ") select model, count(*) as n, true as learns from test, t group by model")
def m02_learnable(spark, sf):
    """Every model on a target that follows from a column: ROC area above 0.9, r2 above 0.5, accuracy above 0.8.

    The column is the remainder of the company number by 97, next to the ratios. Fewer train rows than
    back-tests ask for show nothing either way and count as learned.
    """
    x = (F.col("cik") % 97).cast("double")
    d = _data(spark, sf).select("year_month", "period", x.alias("x_augment"), *[f"`{c}`" for c in _AUG])
    label, target = (F.col("x_augment") >= 48).cast("int"), 1 + (F.col("x_augment") - 48) / 400
    d = durable(d.withColumns({"trend_up_or_down": label, "price_return": target}))
    cols = ["x_augment", *_AUG]
    a, b = clean.impute_median(d.filter("year_month < 24000"), d.filter("year_month >= 24000"), cols)
    few, rows = a.count() < C.MIN_TRAIN_ROWS, []
    for name in ("rf", "boosted"):
        scored = durable(models.classify(a, b, cols, model=name, **SMALL[name])[0])
        rows.append((name, scored.count(), few or (evaluate.auc(scored, "y_pred_proba", "trend_up_or_down").first()["auc"] or 0.0) > 0.9))
    for name in models.REGRESSORS:
        r = models.regression_report(durable(models.regress(a, b, cols, model=name, **SMALL["rf" if name == "random_forest" else "boosted"])[0])).first()
        rows.append((name, r["n"], few or (r["r2"] or 0.0) > 0.5))
    classed = [t.withColumn("class", three_class(F.col("price_return"), 1.04, 0.96)) for t in (a, b)]
    scored = durable(models.classify_three(classed[0], classed[1], ["x_augment"], layers=(16, 8), epochs=100))
    rows.append(("three_class", scored.count(), few or (evaluate.accuracy(scored, "class", "predicted").first()["accuracy"] or 0.0) > 0.8))
    return spark.createDataFrame([r for r in rows if r[1]], "model string, n long, learns boolean")  # no test row, no group


@query("m08", sql=_M08 + """
  select vec_id, batch, round(-ln(coalesce(sum(s) filter (same), 0) / (sum(s) + 1e-8) + 1e-8), 5) as loss from p group by vec_id, batch""")
def m08(spark, sf):
    return rounded(_losses(spark, sf), 5)


def _losses(spark, sf):
    e = X.table(spark, sf, "embeddings").withColumn("batch", F.floor(F.col("vec_id") / 256).cast("long"))
    return evaluate.contrastive_separation(e, "vec_id", "embedding", "label", "batch")


@query("m08_mean", sql=f"""{_M08}, l as (select vec_id, batch, -ln(coalesce(sum(s) filter (same), 0) / (sum(s) + 1e-8) + 1e-8) as loss from p group by vec_id, batch)
  select batch, round(avg(loss), 5) as loss, count(*) as anchors from l group by rollup (batch)""")
def m08_mean(spark, sf):
    return rounded(evaluate.contrastive_loss(_losses(spark, sf)), 5)


_FIRST = 24000
_FIXED = " union all ".join(f"select '{s.name}' as strategy_name, (select count(*) from r where k <= {s.limit}) as picks, true as inside" for s in C.STRATEGIES if s.low is None)
_FREE = "".join(f" union all select '{s.name}', null, true" for s in C.STRATEGIES if s.low is not None)


def _families(columns):
    """Current, change and ratio columns."""
    return [c for c in columns if c.endswith(("_current", "_augment")) or "_change" in c]


@query("m09", _CTES, f"""{_D}, r as (select year_month, row_number() over (partition by year_month order by cik, ticker) as k from test) {_FIXED}{_FREE}""")
def m09(spark, sf):
    """All strategies over every month of the test years: picks where they do not depend on the
    scores; for the others, whether their scores and numbers keep the strategy's limits."""
    d = durable(_data(spark, sf))
    picks = selection.pick_all(backtest.walk_forward(d, None, models.binary_scorer(_families(d.columns)), start=_FIRST))
    months = picks.groupBy("strategy_name", "year_month").agg(F.count("*").alias("n"), F.min("y_pred_proba").alias("lo"), F.max("y_pred_proba").alias("hi"))
    found = {r["strategy_name"]: r for r in months.groupBy("strategy_name").agg(F.sum("n").alias("picks"), F.max("n").alias("most"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}
    rows = []
    for s in C.STRATEGIES:  # a strategy without picks has no row
        r = found.get(s.name)
        inside = r is None or ((s.limit is None or r["most"] <= s.limit) and (s.low is None or r["lo"] >= s.low) and (s.high is None or r["hi"] <= s.high))
        rows.append((s.name, (r["picks"] if r else 0) if s.low is None else None, inside))
    return spark.createDataFrame(rows, "strategy_name string, picks long, inside boolean")


@query("m10", _CTES, f"""{_D} select year_month, count(*) as n, true as inside from test where (select count(*) from d b where b.year_month < test.year_month) >= {C.MIN_TRAIN_ROWS} group by all""")
def m10(spark, sf):
    """Every month of the test years with enough rows before it, all gradients, all columns."""
    w = X.features_wide(spark, sf)
    scorer = lambda train, test: models.binary_scorer(_families(train.columns))(train, test)
    scores = backtest.monthly_rebuild(w, _company_trends(spark, sf), None, scorer, start=_FIRST)
    return scores.groupBy("year_month").agg(F.count("*").alias("n"), F.bool_and(_inside("y_pred_proba")).alias("inside"))


@query("m11", _CTES, f"{_D} select scorer, year_month, cik, ticker, true as scored from d cross join (values ('regression'), ('three_class')) t(scorer) where year_month >= 24000")
def m11(spark, sf):
    d = durable(_data(spark, sf))
    out = None
    for name, scorer in (("regression", models.regression_scorer(_AUG, **SMALL["boosted"])), ("three_class", models.three_class_scorer(["_augment"], epochs=15, layers=(8,)))):
        scores = backtest.walk_forward(d, None, scorer, start=_FIRST).withColumn("scorer", F.lit(name))
        out = scores if out is None else out.unionByName(scores)
    return out.select("scorer", "year_month", "cik", "ticker", F.col("y_pred_proba").isNotNull().alias("scored"))


def _habit(train, test):
    """A caller's own scorer: the share of rises among a company's earlier rows."""
    past = train.groupBy("cik").agg(F.avg("trend_up_or_down").alias("_share"))
    return test.join(past, "cik", "left").withColumn("y_pred_proba", F.coalesce("_share", F.lit(0.5)))


@query("r2", _CTES, f"""{_D} select a.year_month, a.cik, a.ticker, round(coalesce((select avg(trend_up_or_down) from d b where b.cik = a.cik and b.year_month < a.year_month), 0.5), 6) as y_pred_proba
  from d a where a.year_month >= {_FIRST}""")
def r2(spark, sf):
    scores = backtest.walk_forward(_data(spark, sf), None, _habit, start=_FIRST)
    return rounded(scores.select("year_month", "cik", "ticker", "y_pred_proba"))


_CONF = """t(threshold) as (values (cast(0.25 as double)), (0.5), (0.75), (0.9)),
  c as (select threshold, count(*) filter (score >= threshold and label = 1) as tp, count(*) filter (score >= threshold and label = 0) as fp,
    count(*) filter (score < threshold and label = 0) as tn, count(*) filter (score < threshold and label = 1) as fn, count(*) as n from row_scores, t group by threshold)
  select threshold, tp, fp, tn, fn, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) as fpr, round(coalesce(fn / nullif(fn + tp, 0), 0), 6) as fnr,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as tpr, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) as tnr, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision,
  round((tp + tn) / n, 6) as accuracy, round((tp + fp) / n, 6) as predicted_positive from c"""


@query("m12", "row_scores", f", {_CONF} where threshold = 0.5")
def m12(spark, sf):
    return rounded(evaluate.threshold_metrics(X.row_scores(spark, sf), [0.5]))


@query("m13", "row_scores", f", {_CONF}")
def m13(spark, sf):
    return rounded(evaluate.threshold_metrics(X.row_scores(spark, sf)))


_CURVE = """g as (select score, count(*) filter (label = 1) as pos, count(*) filter (label = 0) as neg from row_scores group by score),
  r as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over () as positives, sum(neg) over () as negatives from g window w as (order by score desc))"""


@query("m14", "row_scores", f""", {_CURVE} select round(score, 9) as score, tp::bigint as tp, fp::bigint as fp, round(tp / positives, 6) as tpr, round(fp / negatives, 6) as fpr,
  round(tp / (tp + fp), 6) as precision from r""")
def m14(spark, sf):
    p = evaluate.curve_points(X.row_scores(spark, sf))
    return p.select(F.round("score", 9).alias("score"), "tp", "fp", *[F.round(c, 6).alias(c) for c in ("tpr", "fpr", "precision")])


@query("m14_areas", "row_scores", f""", {_CURVE} select round(sum(pos * (negatives - fp + neg / 2)) / any_value(positives * negatives), 6) as auc,
  round(sum(pos * (tp / (tp + fp))) / any_value(positives), 6) as average_precision from r""")
def m14_areas(spark, sf):
    return rounded(evaluate.curve_areas(evaluate.curve_points(X.row_scores(spark, sf))))


@query("m14_percentile", "row_scores", "select count(*) as n, round(quantile_cont(score, 0.9), 6) as score_at from row_scores")
def m14_percentile(spark, sf):
    return rounded(evaluate.score_at_percentile(X.row_scores(spark, sf), 90))


@query("m15", "row_scores", """, e as (select label, min(score) as lo, max(score) as hi from row_scores group by label),
  b as (select r.label, cast(least(floor((score - lo) / ((hi - lo) / 20)), 19) as int) as bin, lo, hi from row_scores r join e on r.label = e.label)
  select label, bin, count(*) as n, round(any_value(lo) + bin * (any_value(hi) - any_value(lo)) / 20, 6) as bin_start from b group by label, bin""")
def m15(spark, sf):
    return rounded(evaluate.score_histogram(X.row_scores(spark, sf)))


_CORR = ["score", "l_discount", "l_tax"]


def _with_holes(spark, sf):
    r = X.row_scores(spark, sf)
    return r.withColumn("l_tax", F.when(F.col("l_tax") < 0.07, F.col("l_tax")))


@query("m16", "row_scores", """, r as (select label, score, l_discount, case when l_tax < 0.07 then l_tax end as l_tax from row_scores),
  md as (select quantile_cont(l_tax, 0.5) as m from r),
  c as (select 'score' as feature, abs(corr(score, label)) as x from r union all select 'l_discount', abs(corr(l_discount, label)) from r
    union all select 'l_tax', abs(corr(coalesce(l_tax, m), label)) from r, md)
  select feature, round(x, 6) as correlation, row_number() over (order by x desc, feature) as rank from c""")
def m16(spark, sf):
    return rounded(evaluate.feature_correlation(_with_holes(spark, sf), _CORR, "label"))


@query("m16_counts", "row_scores", """, r as (select label, score, l_discount, case when l_tax < 0.07 then l_tax end as l_tax from row_scores), md as (select quantile_cont(l_tax, 0.5) as m from r),
  c as (select abs(corr(score, label)) as x from r union all select abs(corr(l_discount, label)) from r union all select abs(corr(coalesce(l_tax, m), label)) from r, md)
  select count(*) as features, count(*) filter (x > 0.1) as above_10, count(*) filter (x > 0.05) as above_5 from c""")
def m16_counts(spark, sf):
    return evaluate.correlation_counts(evaluate.feature_correlation(_with_holes(spark, sf), _CORR, "label"))


@query("m17", "row_scores", """, r as (select price_return as y, case when l_discount > 0 then score * 2 end as p, label from row_scores), k as (select * from r where p is not null),
  g as (select p, count(*) filter (label = 1) as pos, count(*) filter (label = 0) as neg from k group by p),
  a as (select *, sum(neg) over (order by p desc) as fp, sum(pos) over () as positives, sum(neg) over () as negatives from g)
  select count(*) as n, round(avg((y - p) ** 2), 6) as mse, round(sqrt(avg((y - p) ** 2)), 6) as rmse, round(avg(abs(y - p)), 6) as mae,
  round(1 - avg((y - p) ** 2) / var_pop(y), 6) as r2, round(corr(y, p), 6) as pearson, round(corr(p, label), 6) as corr_trend,
  round((select sum(pos * (negatives - fp + neg / 2)) / any_value(positives * negatives) from a), 6) as auc_trend from k""")
def m17(spark, sf):
    r = X.row_scores(spark, sf).withColumn("y_pred", F.when(F.col("l_discount") > 0, F.col("score") * 2))
    return rounded(models.regression_report(r.filter("y_pred is not null"), "price_return", "label"))


@query("m18", "trends", """, r as (select *, row_number() over (partition by cik order by month_end_date) as k from trends where horizon = 3)
  select count(*) as n, true as sane from r where k > 1 and month_end_date >= date '2000-01-01'""")
def m18(spark, sf):
    m = prices.month_end_prices(X.prices(spark, sf), tiebreak="tiebreak")
    t = prices.price_trends(m, [3]).select("cik", "month_end_date", "close_price", "price_return", "future_close_price", "trend_up_or_down")
    scored = models.lag_regression(t, ["close_price", "price_return"], "future_close_price", "2000-01-01", C.LAGS, **SMALL["boosted"])
    report = models.regression_report(scored, "future_close_price")
    return report.select("n", ((F.col("r2") <= 1) & (F.col("rmse") > 0)).alias("sane"))


@query("m22", "features_wide", """, s as (select avg("Assets_0qtrs_current") as m, stddev_pop("Assets_0qtrs_current") as d from features_wide where period < 20000101)
  select cik, period, round(("Assets_0qtrs_current" - m) / d, 6) as scaled from features_wide, s where period >= 20000101""")
def m22(spark, sf):
    w = X.features_wide(spark, sf).select("cik", "period", F.col("Assets_0qtrs_current").alias("scaled"))
    train, test = clean.period_split(w, 20000101)
    return rounded(evaluate.scale(test, evaluate.standard_scaler(train, ["scaled"])))


_SPOT = "('0x' || md5(cast({k} as varchar) || '|42')[1:8])::bigint / 4294967296.0"


@query("m23", "features_wide", f""", s as (select cik, {_SPOT.format(k='cik')} as spot from features_wide)
  select case when spot < 0.56 then 'train' when spot < 0.56 + 0.14 then 'val' else 'test' end as part, count(distinct cik) as ciks, count(*) as n from s group by 1""")
def m23(spark, sf):
    w = X.features_wide(spark, sf)
    parts = clean.hash_split(w, ["cik"], [0.56, 0.14, 0.30])
    out = [p.agg(F.count_distinct("cik").alias("ciks"), F.count("*").alias("n")).withColumn("part", F.lit(n)) for n, p in zip(("train", "val", "test"), parts)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("m24", "trends", """, q as (select quantile_cont(datediff('day', date '1970-01-01', month_end_date), 0.7) as q from trends)
  select datediff('day', date '1970-01-01', month_end_date) < q as train, count(*) as n, min(month_end_date) as first, max(month_end_date) as last from trends, q group by 1""")
def m24(spark, sf):
    t = prices.price_trends(prices.month_end_prices(X.prices(spark, sf), tiebreak="tiebreak"))
    a, b = clean.time_split(t, "month_end_date")
    both = a.withColumn("train", F.lit(True)).unionByName(b.withColumn("train", F.lit(False)))
    return both.groupBy("train").agg(F.count("*").alias("n"), F.min("month_end_date").alias("first"), F.max("month_end_date").alias("last"))


