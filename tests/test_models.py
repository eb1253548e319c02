"""Models, back-tests and streams on small data."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import evaluate as E
from ledgerlight.operators import clean, models
from ledgerlight.plans import backtest
from ledgerlight.streaming import catchup


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(0)
    rows = []
    for i in range(400):
        x, z = rng.gauss(0, 1), rng.gauss(0, 1)
        ret = 1 + 0.1 * x + rng.gauss(0, 0.03)
        rows.append((i % 8, i % 40, 20200131, f"T{i % 40}", int(ret > 1), ret, x, z if i % 5 else None))
    return spark.createDataFrame(rows, "year_month int, cik int, period int, ticker string, trend_up_or_down int, price_return double, x_0qtrs_current double, z_0qtrs_current double")


FEATURES = ["x_0qtrs_current", "z_0qtrs_current"]


def test_classifier_finds_the_signal(data):
    train, test = data.filter("year_month < 6"), data.filter("year_month >= 6")
    a, b, used = models.indicate_missing(train, test, FEATURES)
    assert used == [*FEATURES, *[f"{c}_missing" for c in FEATURES]]
    scored, fitted = models.classify(a, b, used, numTrees=10, maxDepth=4)
    m = models.classification_metrics(scored, "trend_up_or_down").first()
    assert m["roc_auc"] > 0.9 and m["accuracy"] > 0.8 and m["recall"] == pytest.approx(m["accuracy"])
    assert models.importances(fitted, used, data.sparkSession).orderBy("rank").first()["feature"] == "x_0qtrs_current"


def test_regression_and_three_classes(data):
    train, test = data.filter("year_month < 6"), data.filter("year_month >= 6")
    fit, val, rows, used = models.prepare_three_class(train, test, rules={"cik": "bottom"})
    assert fit.count() + val.count() == train.count() and used == FEATURES
    scored, _ = models.regress(fit, rows, used, maxIter=10, maxDepth=3)
    assert models.regression_report(scored).first()["pearson"] > 0.7
    out = models.classify_three(fit, rows, used, layers=(8,), epochs=40)
    r = models.three_class_report(out).first()
    assert r["corr_label"] > 0.5 and r["auc_trend"] > 0.8
    sums = out.select((F.col("p_bad") + F.col("p_mediocre") + F.col("p_good")).alias("s")).collect()
    assert all(s["s"] == pytest.approx(1.0) for s in sums)


def test_walk_forward_trains_on_the_past_only(data):
    seen = []

    def scorer(train, test):
        seen.append((train.agg(F.max("year_month")).first()[0], test.agg(F.min("year_month")).first()[0]))
        return test.withColumn("y_pred_proba", F.col("x_0qtrs_current"))

    out = backtest.walk_forward(data, [0, 3, 5, 9], scorer)
    assert sorted(seen) == [(2, 3), (4, 5)] and {r["year_month"] for r in out.select("year_month").distinct().collect()} == {3, 5}
    assert out.count() == data.filter("year_month in (3, 5)").count()


def test_new_filings_come_once_and_none_is_lost(spark, tmp_path):
    places = {n: str(tmp_path / n) for n in ("in", "known", "out")}

    def file(*rows):
        spark.createDataFrame(rows, "adsh string, t string").select("adsh", F.to_timestamp("t").alias("filed_at")).coalesce(1).write.mode("append").parquet(places["in"])

    def know(*names):
        spark.createDataFrame([(n,) for n in names], "adsh string").write.mode("append").parquet(places["known"])

    def run():
        schema = spark.read.parquet(places["in"]).schema
        stream = catchup.read_stream(spark, places["in"], "*.parquet", schema, 1)
        return sorted(r["adsh"] for r in catchup.store_new_filings(stream, places["known"], places["out"]).collect())

    know("b")
    file(("a", "2024-06-30 00:00:00"), ("b", "2024-06-30 00:00:00"))
    file(("c", "2024-06-29 00:00:00"), ("a", "2024-06-30 00:00:00"))
    file(("d", "2024-01-05 00:00:00"))
    assert run() == ["a", "c", "d"]
    # a repeat in a later run stays out, and so does a filing that became known meanwhile
    know("e")
    file(("d", "2024-01-05 00:00:00"), ("e", "2024-07-01 00:00:00"), ("f", "2020-01-01 00:00:00"))
    assert run() == ["a", "c", "d", "f"]


def test_late_older_facts_do_not_overwrite(spark, tmp_path):
    cols = "cik long, period int, form string, tag string, qtrs int, ddate int, value double"
    path = str(tmp_path / "in")
    for d, v in ((20240331, 5.0), (20230331, 1.0), (20240630, 7.0), (20240101, 2.0)):
        spark.createDataFrame([(1, 20240630, "10-Q", "A", 0, d, v)], cols).coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    stream = catchup.latest_facts(catchup.read_stream(spark, path, "*.parquet", schema, 1))
    keys = ["cik", "period", "form", "tag", "qtrs"]
    out = catchup.drain(stream, "f", "update", keys).collect()
    assert [(r["crt_ddate"], r["crt_value"]) for r in out] == [(20240630, 7.0)]


def test_correlations_of_constant_columns_are_null(spark):
    rows = [(1.0, 2.0, 0, float(i), None) for i in range(6)]
    df = spark.createDataFrame(rows, "fixed double, y_pred double, label int, x double, empty double")
    r = {c["feature"]: c for c in E.feature_correlation(df.withColumn("y", F.col("x") * 2), ["fixed", "x", "empty"], "y").collect()}
    assert r["x"]["correlation"] == pytest.approx(1.0) and r["x"]["rank"] == 1
    assert r["fixed"]["correlation"] is None and r["empty"]["correlation"] is None
    assert {c["correlation"] for c in E.feature_correlation(df, ["fixed", "x"], "label").collect()} == {None}
    one = E.regression_metrics(df.withColumn("y", F.col("x")), "y", "y_pred").first()
    assert one["pearson"] is None and one["n"] == 6 and one["r2"] is not None
    flat = E.regression_metrics(df.withColumn("y", F.lit(3.0)), "y", "x").first()
    assert flat["pearson"] is None and flat["r2"] is None
    single = E.regression_metrics(df.limit(1), "x", "y_pred").first()
    assert single["pearson"] is None and single["n"] == 1
    report = models.regression_report(df.withColumn("price_return", F.col("x")), "price_return", "label").first()
    assert report["corr_trend"] is None and report["auc_trend"] is None


def test_grid_with_constant_scores_and_one_class(data):
    """A label that never changes gives constant scores: metrics without a value are NULL, nothing fails."""
    flat = data.withColumn("trend_up_or_down", F.lit(1))
    table, best = models.model_grid(flat.filter("year_month < 6"), flat.filter("year_month >= 6"), FEATURES, selections=["current"], models=["rf"], params={"rf": {"numTrees": 2}})
    rows = table.collect()
    assert len(rows) == 2 and all(r["corr_confidence_growth"] is None and r["roc_auc"] is None and r["accuracy"] == 1.0 for r in rows)


def test_every_month_between_start_and_end(data, tmp_path):
    """Months come from the data, side by side or one by one; a restart scores what is missing."""
    seen = []

    def scorer(train, test):
        month = test.agg(F.min("year_month")).first()[0]
        seen.append(month)
        if month == 6 and len(seen) < 5:
            raise RuntimeError("lost")
        return test.withColumn("y_pred_proba", F.col("x_0qtrs_current"))

    path = str(tmp_path / "scores")
    with pytest.raises(RuntimeError, match="lost"):
        backtest.walk_forward(data, None, scorer, path=path, start=3, end=6, together=1)
    assert seen == [3, 4, 5, 6]
    out = backtest.walk_forward(data, None, scorer, path=path, start=3, end=6)
    assert seen == [3, 4, 5, 6, 6]
    assert {r["year_month"]: r["count"] for r in out.groupBy("year_month").count().collect()} == {m: 50 for m in (3, 4, 5, 6)}
    none = backtest.walk_forward(data, None, scorer, start=3, min_train=10**6)
    assert none.count() == 0 and none.columns == out.columns
    assert backtest.months_between({5: 1, 1: 2, 9: 3}, 2) == [5, 9] and backtest.months_between({5: 1}) == [5]


def test_upserted_table_keeps_the_newest_row_of_each_key(spark, tmp_path, monkeypatch):
    """Batches rewrite the parts they touch; a batch that failed is run again; files do not grow with batches."""
    rng, want, path, source = random.Random(1), {}, str(tmp_path / "table"), str(tmp_path / "in")

    def file(rows):
        spark.createDataFrame(rows, "k int, name string, day int, value double").coalesce(1).write.mode("append").parquet(source)
        for k, name, day, value in rows:
            want[k, name] = max(want.get((k, name), (0, 0.0)), (day, value))

    def run():
        stream = catchup.read_stream(spark, source, "*.parquet", spark.read.parquet(source).schema, 1)
        return catchup.upsert_latest(stream, path, ["k", "name"], ["day"], buckets=4)

    def some(n, keys):
        return [(rng.choice(keys), rng.choice(["a", None]), rng.randint(1, 50), float(rng.randint(0, 9))) for _ in range(n)]

    for _ in range(3):
        file(some(40, range(20)))
    first = {(r["k"], r["name"]): (r["day"], r["value"]) for r in run().collect()}
    assert first == want

    # a batch that fails between its parts and its map leaves the table as it was
    file([(1, "a", 99, 1.0), (500, "b", 1, 2.0)])
    dealt = catchup._map_of(spark, path)
    write = spark.createDataFrame

    def lost(*args, **kw):
        if args[1:] and args[1] == "bucket int, at long" and args[0]:
            raise RuntimeError("lost")
        return write(*args, **kw)

    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, *args, **kw: lost(*args, **kw))
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.undo()
    assert catchup._map_of(spark, path) == dealt
    schema = spark.read.parquet(source).schema
    assert {(r["k"], r["name"]): (r["day"], r["value"]) for r in catchup.read_upserted(spark, path, schema).collect()} == first
    assert {(r["k"], r["name"]): (r["day"], r["value"]) for r in run().collect()} == want and want[1, "a"] == (99, 1.0)

    for _ in range(5):
        file([(1, "a", rng.randint(1, 200), 3.0)])
    out = run()
    assert {(r["k"], r["name"]): (r["day"], r["value"]) for r in out.collect()} == want
    parts = [p for p in (tmp_path / "table" / "parts").glob("batch=*/bucket=*")]
    assert len(parts) <= 8 and len(out.inputFiles()) <= 4
    untouched = {b: a for b, a in catchup._map_of(spark, path)[1].items()}
    assert len(set(untouched.values())) > 1  # parts without changes stay where they were


def test_monthly_rebuild_scores_every_month_with_enough_rows_before_it(spark):
    """Datasets are rebuilt for each month; one with too few earlier rows is left out."""
    periods = [20000131, 20000229, 20000331]
    features = spark.createDataFrame([(c, p, "10-Q", 1.0 * c) for p in periods for c in range(4)], "cik long, period int, form string, x_0qtrs_current double")
    trends = spark.createDataFrame([(c, f"T{c}", 24000 + m, c % 2, 1.0) for m in range(3) for c in range(4)], "cik long, ticker string, year_month int, trend_up_or_down int, price_return double")
    seen = []

    def scorer(train, test):
        seen.append((train.count(), test.agg(F.min("year_month")).first()[0]))
        return test.withColumn("y_pred_proba", F.lit(0.5))

    out = backtest.monthly_rebuild(features, trends, None, scorer, min_train=4, quarters=None, ratios=False)
    assert sorted(seen) == [(4, 24001), (8, 24002)]
    assert {r["year_month"]: r["count"] for r in out.groupBy("year_month").count().collect()} == {24001: 4, 24002: 4}


def test_models_without_labelled_train_rows(spark, data):
    """Nothing to learn from: every test row is scored, by an uninformed value, and nothing is important."""
    none, test, cols = data.filter("false"), data.limit(20), ["x_0qtrs_current", "z_0qtrs_current"]
    for train in (none, data.withColumn("trend_up_or_down", F.lit(None).cast("int"))):
        for name in models.CLASSIFIERS:
            a, b, used = models.indicate_missing(train, test, cols)
            scored, fitted = models.classify(a, b, used, model=name)
            assert fitted is None and {r["y_pred_proba"] for r in scored.collect()} == {0.5} and scored.count() == 20
            assert [r["importance"] for r in models.importances(fitted, used, spark).collect()] == [0.0] * len(used)
    for name in models.REGRESSORS:
        a, b = clean.impute_median(none, test, cols)
        scored, fitted = models.regress(a, b, cols, model=name)
        assert fitted is None and {r["y_pred"] for r in scored.collect()} == {0.0} and models.regression_report(scored).first()["n"] == 20
    table, importances = models.model_grid(none, test, cols, params={"rf": {"numTrees": 2}, "boosted": {"maxIter": 2}})
    assert {r["approach"] for r in table.collect()} == {f"{s}_{i}_{m}" for s in ("all", "current", "completeness") for i in ("none", "median") for m in ("rf", "boosted")}
    assert importances.count() > 0


def test_a_forest_that_saw_one_class_scores_the_other_zero(data):
    cols = ["x_0qtrs_current"]
    for label in (0, 1):
        a, b = clean.impute_median(data.withColumn("trend_up_or_down", F.lit(label)), data.limit(20), cols)
        assert {r["y_pred_proba"] for r in models.classify(a, b, cols, numTrees=2)[0].collect()} == {float(label)}


def test_three_classes_without_labelled_train_rows(data):
    """No network: every test row is kept, all classes alike, for no train rows as for unlabelled ones."""
    test = data.limit(20).withColumn("class", F.lit("good"))
    for train in (data.filter("false").withColumn("class", F.lit("bad")), data.withColumn("class", F.lit(None).cast("string"))):
        a, b = clean.impute_median(train, test, FEATURES)
        out = models.classify_three(a, b, FEATURES, layers=(4,), epochs=2)
        rows = out.collect()
        assert len(rows) == 20 and {r["predicted"] for r in rows} == {"mediocre"} and {r["y_pred_proba"] for r in rows} == {0.5}
        assert all(r["p_bad"] == r["p_mediocre"] == r["p_good"] == pytest.approx(1 / 3) for r in rows)
        assert set(out.columns) == {*b.columns, "p_bad", "p_mediocre", "p_good", "predicted", "y_pred_proba"}
    assert models.classify_three(a, b.filter("false"), FEATURES, layers=(4,), epochs=2).count() == 0
