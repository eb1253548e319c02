"""Prices, labels, strategies and portfolios against loops."""

import datetime
import random

import pytest

from ledgerlight import config as C
from ledgerlight.operators import clean, portfolio, prices, selection


def _prices(seed=4):
    rng = random.Random(seed)
    out = []
    for cik, t in ((1, "A"), (1, "B"), (2, "C")):
        for d in sorted(rng.sample(range(500), 60)):
            out.append((cik, t, datetime.date(2020, 1, 1) + datetime.timedelta(days=d), float(rng.randrange(1, 40))))
    return out


@pytest.fixture(scope="module")
def daily(spark):
    return spark.createDataFrame(_prices(), "cik long, ticker string, date date, close_price double")


def _month(d):
    return d.year * 12 + d.month - 1


def test_month_end_and_trends(daily):
    want = {}
    for cik, t, d, p in _prices():
        k = (cik, t, _month(d))
        want[k] = max(want.get(k, (datetime.date.min, 0.0)), (d, p))
    monthly = prices.month_end_prices(daily)
    assert {(r["cik"], r["ticker"], r["year_month"]): (r["month_end_date"], r["close_price"]) for r in monthly.collect()} == want
    got = {(r["ticker"], r["year_month"], r["horizon"]): (r["trend_up_or_down"], r["trend_5per_up"], r["price_return"]) for r in prices.price_trends(monthly, [3, 1]).collect()}
    exp = {}
    for (cik, t, m), (_, p) in want.items():
        for h in (3, 1):
            if (cik, t, m + h) in want:
                q = want[(cik, t, m + h)][1]
                exp[(t, m, h)] = (int(q > p), int(q > p * 1.05), q / p)
    assert got == exp


def test_gap_filter_reports_tied_gaps(spark):
    days = [(("X"), d) for d in (1, 5, 9)] + [("Y", d) for d in (1, 2, 3)] + [("Z", 1)]
    df = spark.createDataFrame([(t, datetime.date(2024, 1, d)) for t, d in days], "ticker string, date date")
    assert {r["ticker"] for r in clean.continuous_tickers(df, 3).collect()} == {"Y", "Z"}
    info = clean.broken_tickers(df, 3).orderBy("gap_end_date").collect()
    assert [(r["max_gap_days"], r["gap_start_date"].day, r["gap_end_date"].day) for r in info] == [(4, 1, 5), (4, 5, 9)]


def test_missing_and_repeated_months(spark):
    rows = [(1, "A", 10), (1, "A", 11), (2, "B", 23), (2, "B", 26), (3, "C", 5), (3, "C", 5), (4, "D", 7)]
    df = spark.createDataFrame(rows, "cik int, ticker string, year_month int")
    bad = {r["ticker"]: r["missing_months"] for r in clean.missing_months(df).collect()}
    assert bad == {"B": "0002-01,0002-02", "C": ""}
    assert {r["ticker"] for r in clean.complete_series(df).collect()} == {"A", "D"}


def _scores(seed=2, n=400):
    rng = random.Random(seed)
    return [(rng.choice([1, 2, 2, 2, 3, 5]), i % 40, f"S{i % 40}", round(rng.random(), 1), rng.random() + 0.5) for i in range(n)]


def test_strategies_match_sorting(spark):
    rows = sorted({(m, c): (m, c, t, p, r) for m, c, t, p, r in _scores()}.values())
    df = spark.createDataFrame(rows, "year_month int, cik int, ticker string, y_pred_proba double, price_return double")
    got = {}
    for r in selection.pick_all(df).collect():
        got.setdefault((r["strategy_name"], r["year_month"]), []).append((r["rank"], r["cik"]))
    want = {}
    for s in C.STRATEGIES:
        for m in {r[0] for r in rows}:
            hits = [r for r in rows if r[0] == m and (s.low is None or r[3] >= s.low) and (s.high is None or r[3] <= s.high)]
            hits = sorted(hits, key=lambda r: (-r[3], r[1]))[: s.limit]
            if hits:
                want[(s.name, m)] = [(i + 1, h[1]) for i, h in enumerate(hits)]
    assert {k: sorted(v) for k, v in got.items()} == want
    assert len(got) == len(want)


def test_buy_and_hold_matches_a_loop(spark):
    rng = random.Random(8)
    rows = sorted({(m, c): (m, c, f"S{c}", rng.random()) for m in (1, 2, 4, 5) for c in rng.sample(range(9), 6)}.values())
    quotes = {(f"S{c}", m): float(rng.randrange(0, 9)) for c in range(9) for m in range(1, 6) if rng.random() < 0.7}
    scores = spark.createDataFrame(rows, "year_month int, cik int, ticker string, y_pred_proba double")
    price = spark.createDataFrame([(t, m, p) for (t, m), p in quotes.items()], "ticker string, year_month int, close_price double")
    owned, invested, want = {}, 0.0, {}
    for m in (1, 2, 4, 5):
        top = sorted([r for r in rows if r[0] == m], key=lambda r: (-r[3], r[1]))[:3]
        buys = [r[2] for r in top if quotes.get((r[2], m), 0) > 0]
        for t in buys:
            owned[t] = owned.get(t, 0.0) + 100.0 / len(buys) / quotes[(t, m)]
        invested += 100.0 if buys else 0.0
        held = [(t, n) for t, n in owned.items() if (t, m) in quotes]
        want[m] = (sum(n * quotes[(t, m)] for t, n in held), invested, len(held))
    got = {r["year_month"]: r for r in portfolio.buy_and_hold(scores, price, 100.0, 3).collect()}
    assert set(got) == set(want)
    for m, (value, total, n) in want.items():
        assert (got[m]["portfolio_value"], got[m]["total_invested"], got[m]["num_stocks"]) == (pytest.approx(value), total, n)


def test_cost_averaging_shows_the_last_value_in_empty_months(spark):
    price = spark.createDataFrame([("I", 2, 10.0), ("I", 4, 20.0)], "ticker string, year_month int, close_price double")
    rows = portfolio.dollar_cost_average(price, 1, 5, 100.0).orderBy("year_month").collect()
    assert [r["portfolio_value"] for r in rows] == [0.0, 100.0, 100.0, 300.0, 300.0]
    assert [r["total_invested"] for r in rows] == [0.0, 100.0, 100.0, 200.0, 200.0]
    assert rows[3]["cumulative_return"] == pytest.approx(50.0)


def test_benchmark_start_is_exclusive_and_joins_fan_out(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (2, 1, 3.0), (2, 2, 5.0)], "year_month int, cik int, price_return double")
    far = spark.createDataFrame([(2, 1, 2.0), (2, 1, 4.0), (1, 1, 9.0)], "year_month int, cik int, price_return double")
    r = selection.benchmark(df, far, 1, 2).first()
    assert (r["short_term_return"], r["long_term_return"], r["num_records"], r["num_with_long_term"]) == (4.0, 3.0, 2, 2)


def test_sequences_keep_the_most_recent(spark):
    rows = [(1, m, float(m), float(-m)) for m in range(30)] + [(2, m, 1.0, 1.0) for m in range(3)]
    df = spark.createDataFrame(rows, "cik int, month_end_date int, f double, y double")
    out = prices.sequences(df, ["f"], "y").collect()
    assert len(out) == 1 and out[0]["length"] == 20 and [x[0] for x in out[0]["features"]] == [float(m) for m in range(10, 30)]


def test_lags_and_fills(spark):
    df = spark.createDataFrame([(1, 1, None, 5.0), (1, 2, 2.0, None), (1, 3, None, None)], "cik int, month_end_date int, a double, b double")
    filled = prices.fill_gaps(df, ["a", "b"]).orderBy("month_end_date").collect()
    assert [(r["a"], r["b"]) for r in filled] == [(2.0, 5.0), (2.0, 5.0), (2.0, 5.0)]
    lagged = prices.lag_features(df, ["a", "b"], [1, 2]).orderBy("month_end_date").collect()
    assert [(r["month_end_date"], r["b_lag_1"], r["a_lag_1"], r["b_lag_2"]) for r in lagged] == [(2, 5.0, None, None), (3, None, 2.0, 5.0)]
