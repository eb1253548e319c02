"""Segment summary, history, pivot and gradients on hand-made facts."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ledgerlight import config as C
from ledgerlight.functions import dates as D
from ledgerlight.operators import clean, facts, features
from ledgerlight.plans.features import filing_ratios

SHAPE = "cik long, tag string, ddate int, qtrs int, period int, form string, segments string, value double, uom string, custom_tag int"


def _fact(tag="A", ddate=20230630, segments=None, value=1.0, qtrs=1, period=20230630, form="10-Q", uom="USD", custom=0, cik=1):
    return (cik, tag, ddate, qtrs, period, form, segments, value, uom, custom)


def test_three_rules_and_ties(spark):
    rows = [
        _fact("one", segments="s", value=5.0), _fact("one", segments="s", value=5.0),
        _fact("null", value=3.0), _fact("null", segments="s", value=9.0), _fact("null", value=4.0),
        _fact("max", segments="b", value=7.0), _fact("max", segments="a", value=7.0), _fact("max", segments="c", value=2.0),
        _fact("gone", uom="shares"), _fact("gone", custom=1), _fact("gone", form="8-K"), _fact("gone", value=None),
    ]
    out = {r["tag"]: (r["segments"], r["value"], r["summary_reason"]) for r in facts.segment_summary(spark.createDataFrame(rows, SHAPE)).collect()}
    assert out == {
        "one": ("s", 5.0, "single_record"), "null": (None, 4.0, "segments_null_summary"), "max": ("a", 7.0, "max_value"),
    }


def test_summary_is_one_row_per_key_and_keeps_null_keys(spark):
    rng = random.Random(1)
    rows = [
        _fact(rng.choice("AB"), rng.choice([20230331, 20230630]), rng.choice([None, "x", "y"]), float(rng.randrange(4)), rng.choice([0, 1, None]))
        for _ in range(400)
    ]
    df = spark.createDataFrame(rows, SHAPE)
    out = facts.segment_summary(df)
    assert out.count() == out.select("cik", "tag", "ddate", "qtrs", "period", "form").distinct().count()
    groups = {}
    for r in set(rows):
        groups.setdefault((r[1], r[2], r[3]), set()).add((r[6], r[7]))
    for r in out.collect():
        g = groups[(r["tag"], r["ddate"], r["qtrs"])]
        if len(g) == 1:
            want = (*next(iter(g)), "single_record")
        elif any(s is None for s, _ in g):
            want = (None, max(v for s, v in g if s is None), "segments_null_summary")
        else:
            top = max(v for _, v in g)
            want = (min(s for s, v in g if v == top), top, "max_value")
        assert (r["segments"], r["value"], r["summary_reason"]) == want


def test_summary_plan_has_one_shuffle(spark):
    df = spark.createDataFrame([_fact()], SHAPE)
    plan = facts.segment_summary(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_history_arrays(spark):
    rows = [
        _fact(ddate=20230630, value=10.0), _fact(ddate=20230331, value=8.0), _fact(ddate=29220630, value=4.0),
        _fact(ddate=10111231, value=99.0), _fact("zero", ddate=20230630, value=0.0), _fact("zero", ddate=20220630, value=3.0),
    ]
    out = {r["tag"]: r for r in facts.history_comparisons(facts.segment_summary(spark.createDataFrame(rows, SHAPE))).collect()}
    a = out["A"]
    assert a["crt_value"] == 10.0 and a["other_values"] == [4.0, 8.0] and a["quarter_intervals"] == [4, 1]
    assert a["other_ddates"] == [datetime.date(2022, 6, 30), datetime.date(2023, 3, 31)]
    assert a["percentage_diffs"] == pytest.approx([0.6, 0.2]) and a["num_historical_points"] == 2
    assert out["zero"]["percentage_diffs"] == [None]


def test_pivot_keeps_filings_without_chosen_tags(spark):
    rows = [_fact(), _fact(ddate=20230331, value=0.5), _fact("other", period=20230331), _fact("big", qtrs=5)]
    h = facts.history_comparisons(facts.segment_summary(spark.createDataFrame(rows, SHAPE)))
    wide = facts.pivot_features(h, ["A", "big"], 2)
    assert wide.columns == ["cik", "period", "form", "A_1qtrs_change_q1", "A_1qtrs_change_q2", "A_1qtrs_current"]
    got = {r["period"]: tuple(r)[3:] for r in wide.collect()}
    assert got == {20230630: (0.5, None, 1.0), 20230331: (None, None, None)}


def test_tall_equals_wide(spark):
    rows = [_fact(t, qtrs=q, period=p, value=float(len(t) + q + p % 100)) for t in ("A", "BB") for q in (0, 1) for p in (20230331, 20230630)]
    h = facts.history_comparisons(facts.segment_summary(spark.createDataFrame(rows, SHAPE)))
    tall = {(r["period"], f"{r['tag']}_{r['qtrs']}qtrs_current"): r["value"] for r in facts.tall_features(h, ["A", "BB"]).collect()}
    wide = facts.pivot_features(h, ["A", "BB"])
    assert tall == {(r["period"], c): r[c] for r in wide.collect() for c in wide.columns[3:]}


def test_refiled_keys_go_entirely(spark):
    rows = [("a", 1590364, "10-Q", 20220930), ("b", 1590364, "10-Q", 20220930), ("c", 1590364, "10-K", 20220930)]
    sub = spark.createDataFrame(rows, "adsh string, cik long, form string, period int")
    assert [r["adsh"] for r in clean.drop_refiled(sub).collect()] == ["c"]


def test_top_tags_fail_when_short(spark):
    stats = spark.createDataFrame([("A", 1, 3), ("B", 5, 3), ("C", 1, 9)], "tag string, occurrences long, distinct_companies long")
    assert [r["tag"] for r in facts.top_tags(stats, 2).orderBy("rank").collect()] == ["C", "A"]
    with pytest.raises(ValueError):
        facts.top_tags(stats, 4)


def test_gradients_keep_rows_and_use_history(spark):
    cols = "cik long, period int, form string, X_0qtrs_current double"
    work = spark.createDataFrame([(1, 20230615, "10-Q", 12.0), (1, 20230331, "10-Q", 8.0), (2, 20230630, "10-Q", 5.0)], cols)
    past = spark.createDataFrame([(1, 20220630, "10-K", 0.0), (2, 20230331, "10-K", 4.0), (1, 20230331, "10-K", 77.0)], cols)
    out = {(r["cik"], r["period"]): r for r in features.gradients(work, (1, 4), history=past).collect()}
    assert set(out) == {(1, 20230630), (1, 20230331), (2, 20230630)}
    assert out[(1, 20230630)]["X_0qtrs_change_q1"] == 0.5 and out[(1, 20230630)]["X_0qtrs_change_q4"] is None
    assert out[(2, 20230630)]["X_0qtrs_change_q1"] == 0.25


def test_gradients_of_two_thousand_columns(spark):
    names = [f"T{i}_0qtrs_current" for i in range(2000)]
    rows = spark.range(8).select(F.lit(1).cast("long").alias("cik"), F.element_at(F.array(*map(F.lit, (20220331, 20220630, 20220930, 20221231, 20230331, 20230630, 20230930, 20231231))), F.col("id").cast("int") + 1).alias("period"), "id")
    wide = rows.select("cik", "period", *[F.when(F.col("id") != i % 8, (F.col("id") + i).cast("double")).alias(c) for i, c in enumerate(names)])
    out = features.gradients(wide, (1, 4))
    assert len(out.columns) == 2 + 3 * 2000
    got = {r["period"]: r for r in out.collect()}
    for n, period in ((7, 20231231), (4, 20230331), (0, 20220331)):
        for i in (0, 3, 7, 1999):
            now, quarter, year = (None if k < 0 or k == i % 8 else k + i for k in (n, n - 1, n - 4))
            for q, past in ((1, quarter), (4, year)):
                want = (now - past) / past if now is not None and past else None
                assert got[period][f"T{i}_0qtrs_change_q{q}"] == want


def test_ratio_signs(spark):
    cols = {"AssetsCurrent": 10.0, "InventoryNet": 4.0, "LiabilitiesCurrent": 2.0, "LongTermDebtNoncurrent": 6.0, "StockholdersEquity": -4.0}
    wide = spark.createDataFrame([(1, *cols.values())], "cik int, " + ", ".join(f"{c}_0qtrs_current double" for c in cols))
    r = features.ratio_features(wide).first()
    assert (r["QuickRatio_0qtrs_augment"], r["DebtToEquity_0qtrs_augment"]) == (3.0, -2.0)
    assert "ROE_1qtrs_augment" not in r.asDict()
    d = features.defined_ratios(wide, legacy=True).first()
    assert (d["QuickRatio_augment"], d["DebtToEquity_augment"]) == (3.0, -1.0)


def test_expected_ranges_and_existing_flags(spark):
    rows = [(0.3, False), (0.9, False), (None, True), (-0.5, False), (0.4, False)]
    wide = spark.createDataFrame(rows, "GrossMargin_1qtrs_augment double, flag_outlier boolean")
    flags = [r["flag_outlier"] for r in features.expected_range_flag(wide).collect()]
    assert flags == [False, True, True, True, False]
    hard = features.hard_limit_flag(wide.drop("flag_outlier"))
    assert [r["flag_outlier"] for r in hard.collect()] == [False, False, False, True, False]


def test_filing_ratios_of_newest_period(spark):
    shape = "adsh string, cik long, tag string, version string, ddate int, qtrs int, uom string, segments string, value double"
    rows = [
        ("x", 1, "GrossProfit", "us-gaap", 20230630, 1, "USD", "", 4.0), ("x", 1, "Revenues", "us-gaap", 20230630, 1, "USD", "", 8.0),
        ("x", 1, "Revenues", "x", 20230630, 0, "USD", "", 1.0), ("x", 1, "GrossProfit", "us-gaap", 20220630, 1, "USD", "", 1.0),
    ]
    out = filing_ratios(spark.createDataFrame(rows, shape), "10-Q", C.KEY_METRICS).collect()
    assert len(out) == 1 and out[0]["period"] == 20230630 and out[0]["GrossMargin_augment"] == 0.5


def test_dates(spark):
    one = spark.createDataFrame([("29230630", "20230630", "10111231")], "a string, b string, c string")
    r = one.select(D.repair_year(F.col("a")).alias("a"), D.parse_day(F.col("b")).alias("b"), D.parse_day(F.col("c")).alias("c")).first()
    assert tuple(r) == ("20230630", datetime.date(2023, 6, 30), None)
    f = spark.createDataFrame(
        [("CY2024Q1I", None, None, 0), ("CY2024Q3D", "2024-07-01", "2024-09-30", 1), ("CY2024Q3D", None, None, 3), (None, "2024-01-01", "2024-12-31", 4),
         (None, "2020-01-01", "2024-12-31", 4), (None, "2024-01-01", "2024-01-02", 0), (None, None, None, 0)], "f string, s string, e string, want int")
    q = D.frame_to_qtrs(F.col("f"), F.col("s").cast("date"), F.col("e").cast("date"))
    assert all(r["q"] == r["want"] for r in f.select("want", q.alias("q")).collect())
    end = spark.sql("select date'2024-04-30' d").select(D.shift_month_end(F.col("d"), 3).alias("e")).first()["e"]
    assert end == datetime.date(2024, 7, 31)


def test_quarter_rounding(spark):
    days = spark.range(-5, 900).select(F.col("id").cast("int").alias("d"))
    out = days.select("d", D.round_quarter_days(F.col("d")).alias("a"), D.round_quarter_days_fine(F.col("d")).alias("b"), D.days_to_quarter(D.round_quarter_days(F.col("d"))).alias("q"))
    for r in out.collect():
        d = r["d"]
        a = d if d <= 0 else min(sorted(C.QUARTER_DAYS), key=lambda x: abs(x - d))
        near = min(C.QUARTER_DAYS_FINE, key=lambda x: abs(x - d))
        assert r["a"] == a and r["b"] == (near if d > 0 and abs(near - d) <= 15 else d)
        assert r["q"] == C.QUARTER_DAYS.get(a)


def test_one_build_equals_quarterly_builds(spark, tmp_path):
    from ledgerlight.plans.features import build_features, store_new_quarters

    cols = "cik long, tag string, ddate int, qtrs int, period int, form string, segments string, value double, uom string, custom_tag int, data_qtr string"
    rows = [(1, "A", 20240331, 0, 20240331, "10-Q", None, 5.0, "USD", 0, "2024q1"), (1, "A", 20240331, 0, 20240331, "10-Q", None, 9.0, "USD", 0, "2024q2"), (2, "A", 20240331, 0, 20240331, "10-Q", None, 4.0, "USD", 0, "2024q2")]
    df = spark.createDataFrame(rows, cols)
    key = lambda d: sorted((r["cik"], r["data_qtr"], r["A_0qtrs_current"]) for r in d.collect())
    want = [(1, "2024q1", 5.0), (1, "2024q2", 9.0), (2, "2024q2", 4.0)]
    assert key(build_features(df, ["A"])) == want
    assert key(store_new_quarters(df, str(tmp_path / "one"), ["A"])) == want
    store_new_quarters(df.filter("data_qtr = '2024q1'"), str(tmp_path / "two"), ["A"])
    assert key(store_new_quarters(df, str(tmp_path / "two"), ["A"])) == want


def test_tall_gradients_match_a_loop_and_shuffle_once(spark):
    """Of several filings in a month the latest counts; a month with a NULL value is there, one without a row or a company is not."""
    rng = random.Random(2)
    rows = [(c, f, p, None if rng.random() < 0.1 else rng.choice([0.0, 2.0, 5.0])) for c in (1, 2, None) for f in "ab" for p in (20200131, 20200331, 20200430, 20200415, 20200630, 20200731, 20201231, 20210430) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "cik long, feature string, period int, value double")
    out = features.tall_gradients(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    month = lambda p: p // 10000 * 12 + p // 100 % 100
    latest = {}
    for c, f, p, v in sorted(rows, key=lambda r: r[2]):
        latest[c, f, month(p)] = v
    want = {(*k, q): (v, latest[k[0], k[1], k[2] - 3 * q]) for k, v in latest.items() for q in C.GRADIENT_QUARTERS if k[0] and (k[0], k[1], k[2] - 3 * q) in latest}
    got = {(r.cik, r.feature, month(r.period), r.q): (r.current, r.past) for r in out.collect()}
    assert got == want and any(v[1] is None for v in want.values()) and len(want) > 10
    for r in out.collect():
        assert r.gradient == ((r.current - r.past) / r.past if r.past and r.current is not None else None)
