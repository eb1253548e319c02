"""Names, tag matching and pipeline comparison."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlight import config as C
from ledgerlight.functions import numeric as N
from ledgerlight.functions import text as S
from ledgerlight.operators import clean, evaluate, match, reconcile
from ledgerlight.operators.features import find_column, substitute_metrics


def _one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("o")).first()["o"]


def test_words(spark):
    assert _one(spark, "DeferredTaxRefundReceivable", S.split_camel) == ["Deferred", "Tax", "Refund", "Receivable"]
    assert _one(spark, "Long-Term  Interest, of the Investment", S.extract_words) == ["lg", "term", "terest", "vestment"]  # "on" goes inside "long"
    assert _one(spark, "NetIncomeLoss", S.extract_words) == ["net", "come", "loss"]
    assert _one(spark, "GAAPTax", S.split_camel) == ["G", "A", "A", "P", "Tax"]


def test_padding_and_names(spark):
    assert _one(spark, "320193", S.pad_cik) == "0000320193"
    assert _one(spark, "NYSE MKT Stocks", S.normalize_name) == "nyse_mkt_stocks"
    keys = {n: tuple(_one(spark, n, S.dataset_key)) for n in ("2024q2", "2024", "202412", "notes")}
    assert keys == {"2024q2": (2024, 2, 0), "2024": (2024, 0, 1), "202412": (202412, 0, 1), "notes": (0, 0, 3)}


def test_feature_names(spark):
    df = spark.createDataFrame([("A_b_1qtrs_current",), ("ROE_1qtrs_augment",), ("X_0qtrs_change_q4",), ("GrossMargin_augment",)], "feature string")
    got = [tuple(r) for r in df.select(S.feature_tag(F.col("feature")), S.feature_qtrs(F.col("feature")), S.feature_change(F.col("feature"))).collect()]
    assert got == [("A_b", 1, "current"), ("ROE", 1, "augment"), ("X", 0, "change_q4"), ("GrossMargin", None, "augment")]


def test_matches_prefer_exact_words(spark):
    tags = spark.createDataFrame([("AssetsCurrent",), ("CurrentAssets",), ("Assets",), ("Goodwill",)], "tag string")
    out = match.tag_matches(tags, ["AssetsCurrent"], 0.7).orderBy("match_rank").collect()
    assert [(r["tag"], r["score"]) for r in out][:2] == [("AssetsCurrent", 1.0), ("CurrentAssets", 1.0)]


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9])
def test_only_pairs_that_can_reach_the_threshold_are_scored(spark, threshold):
    """The same matches as from scoring all pairs, from fewer scored pairs; a tag of many companies is scored once."""
    rng = random.Random(3)
    parts = ["Assets", "Current", "Net", "Income", "Loss", "Total", "Equity", "Debt", "Liabilities", "Cash", "Asset", "Incomes", "X"]
    rows = [(i % 7, "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))) for i in range(600)] + [(0, ""), (0, "of"), (1, None)]
    tags = spark.createDataFrame(rows, "cik int, tag string")
    metrics = ["AssetsCurrent", "NetIncomeLoss", "Total Debt", "StockholdersEquity", "of"]
    every = match.match_scores(match.candidates(tags, metrics, ["cik"])).filter(F.col("score") >= threshold)
    got = match.tag_matches(tags, metrics, threshold, ["cik"], best=10**6)
    assert {(r["cik"], r["metric"], r["tag"], r["score"]) for r in got.collect()} == {(r["cik"], r["metric"], r["tag"], r["score"]) for r in every.collect()}
    once = match.candidates(tags, metrics)
    assert 0 < every.select("metric", "tag").distinct().count() <= match.reachable(once, threshold).count() < once.count() * {0.5: 1, 0.7: 1, 0.9: 0.25}[threshold]


def test_agreement_categories(spark):
    rows = [(1, "A", "a", 1), (2, "A", "a", 1), (1, "B", "b", 1), (1, "C", "c", 1), (2, "C", "d", 1)]
    m = spark.createDataFrame(rows, "cik int, metric string, tag string, match_rank int")
    assert {r["metric"]: r["category"] for r in match.agreement(m, 2, ["A", "B", "C", "D"]).collect()} == {"A": 1, "B": 2, "C": 3, "D": 4}


def test_pair_comparison(spark):
    cols = "cik int, form string, period int, feature string, value double"
    batch = spark.createDataFrame([(1, "10-Q", 20240331, f, v) for f, v in (("a", 100.0), ("b", 5.0), ("c", None))], cols)
    catch = spark.createDataFrame([(1, "10-Q", 20240402, f, v) for f, v in (("a", 100.5), ("b", 9.0), ("c", 1.0))], cols)
    pairs = reconcile.overlapping_reports(batch, catch)
    r = reconcile.compare_pairs(batch, catch, pairs, ["a", "b", "c", "d"]).first()
    assert (r["period_delta_days"], r["n_both_present"], r["n_value_close"], r["n_disagree"], r["n_one_nan"], r["n_both_nan"]) == (2, 2, 1, 1, 1, 1)
    assert r["match_rate_present"] == 0.5 and r["disagreements"] == "b"


def test_catchup_actions(spark):
    f = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("c", 2, 1), ("d", 2, 2), ("e", 2, 3), ("f", 3, 1)], "adsh string, cik int, filed int")

    def ids(*x):
        return spark.createDataFrame([(i,) for i in x], "adsh string")

    out = reconcile.catchup_actions(f, ids("a", "c"), ids("b"), ids("e"))
    assert {r["adsh"]: r["action"] for r in out.collect()} == {"a": "already_in_batch", "b": "already_in_catchup", "d": "no_xbrl_facts", "e": "downloaded", "f": "no_xbrl_facts"}


def test_labels(spark):
    df = spark.createDataFrame([(v,) for v in (0.08, 0.02, -0.07, 0.0, -0.03, None)], "v double")
    assert [r["c"] for r in df.select(N.three_class(F.col("v")).alias("c")).collect()] == ["good", "mediocre", "bad", "mediocre", "mediocre", None]
    with pytest.raises(ValueError):
        evaluate.normalize_labels(spark.createDataFrame([(v,) for v in (0, 1, 2, 3)], "y int"), "y")
    s = spark.createDataFrame([(1.0, 2.0, 2.0), (5.0, 0.0, 4.0), (-9.0, 0.0, 4.0)], "v double, lo double, hi double")
    assert [r["s"] for r in s.select(N.minmax_score(F.col("v"), F.col("lo"), F.col("hi")).alias("s")).collect()] == [0.0, 1.0, 0.0]


def test_nan_is_null_and_zero_divides_to_null(spark):
    df = spark.createDataFrame([(float("nan"), 1.0), (float("inf"), 1.0), (2.0, 0.0), (2.0, -4.0)], "a double, b double")
    got = [r["x"] for r in df.select(N.safe_divide(N.clean(F.col("a")), F.col("b")).alias("x")).collect()]
    assert got == [None, None, None, -0.5]


def test_columns(spark):
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    assert clean.standardize_columns(df, ["b", "c"]).columns == ["b", "c"]
    assert clean.standardize_columns(df, ["b", "c"], keep_extra=True).columns == ["b", "c", "a"]
    assert find_column(["assets_0qtrs_current"], "Assets") == "assets_0qtrs_current" and find_column(["x"], "Assets") is None


def test_substitution(spark):
    have = spark.createDataFrame([("Revenue2",), ("GrossProfit",), ("Assets",)], "tag string")
    present, ratios = substitute_metrics(have, {"Revenues": "Revenue2", "NetIncomeLoss": "Unknown"})
    assert present == ["Assets", "GrossProfit", "Revenue2"]
    assert {r.name: r.denominator for r in ratios} == {"GrossMargin": "Revenue2", "AssetTurnover": "Assets"}
    assert len(C.RATIOS) == 14
