"""As-of and nearest joins against brute force."""

import datetime
import random
import re

import pytest

from ledgerlight import session
from ledgerlight.config import KEY_METRICS
from ledgerlight.operators import joins, reconcile, sets
from ledgerlight.queries import joining
from ledgerlight.sources import sinks


def _day(i):
    return datetime.date(2020, 1, 1) + datetime.timedelta(days=i)


def _data(seed):
    rng = random.Random(seed)
    left = [(rng.choice([1, 1, 1, 2, 3]), _day(rng.randrange(200)), i) for i in range(300)]
    right = sorted({(rng.choice([1, 2]), _day(rng.randrange(0, 200, 7))) for _ in range(30)})
    return left, [(k, d, float(i)) for i, (k, d) in enumerate(right)]


@pytest.mark.parametrize("seed", [1, 2])
def test_asof_takes_the_latest_earlier_row(spark, seed):
    left, right = _data(seed)
    a, b = spark.createDataFrame(left, "k int, d date, id int"), spark.createDataFrame(right, "k int, r date, v double")
    got = {r["id"]: (r["r"], r["v"]) for r in joins.asof_join(a, b, ["k"], "d", "r", ["v"]).collect()}
    want = {}
    for k, d, i in left:
        hits = [(r, v) for kk, r, v in right if kk == k and r <= d]
        if hits:
            want[i] = max(hits)
    assert got == want
    assert joins.asof_join(a, b, ["k"], "d", "r", ["v"], "left").count() == len(left)


@pytest.mark.parametrize("tolerance", [1, 3, 90])
def test_nearest_within_tolerance(spark, tolerance):
    left, right = _data(5)
    a, b = spark.createDataFrame(left, "k int, d date, id int"), spark.createDataFrame(right, "k int, r date, v double")
    got = {r["id"]: (r["delta_days"], r["r"], r["v"]) for r in joins.nearest_join(a, b, ["k"], "d", "r", ["v"], tolerance).collect()}
    want = {}
    for k, d, i in left:
        hits = [(abs((r - d).days), r, v) for kk, r, v in right if kk == k and abs((r - d).days) <= tolerance]
        if hits:
            want[i] = min(hits)
    assert got == want


def test_combine_first_equals_union_on_disjoint_keys(spark):
    a = spark.createDataFrame([(1, 2.0, None), (2, None, 1.0)], "k int, x double, y double")
    b = spark.createDataFrame([(3, 5.0)], "k int, z double")
    merged = sorted(map(tuple, sets.combine_first(a, b, ["k"]).collect()))
    assert merged == sorted(map(tuple, sets.merge_forms([a, b], ["k"]).collect()))


def test_combine_first_prefers_left_values(spark):
    a = spark.createDataFrame([(1, 2.0, None)], "k int, x double, y double")
    b = spark.createDataFrame([(1, 9.0, 7.0), (2, 3.0, None)], "k int, x double, y double")
    assert sorted(map(tuple, sets.combine_first(a, b, ["k"]).collect())) == [(1, 2.0, 7.0), (2, 3.0, None)]


def test_shift_join_is_gap_safe(spark):
    m = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 5, 5.0)], "t string, m int, p double")
    got = {r["m"]: r["p_next"] for r in joins.shift_join(m, m, ["t"], "m", 1, ["p"], "_next").collect()}
    assert got == {1: 2.0, 2: None, 5: None}


def test_key_diff(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    r = joins.key_diff(a, b, ["k"]).first()
    assert (r["in_both"], r["only_left"], r["only_right"], r["pct_of_left"]) == (1, 1, 1, 50.0)


def test_asof_on_one_key_with_many_times(spark):
    """Time stamps of a single key, more than its days."""
    right = spark.range(0, 50000, 100).selectExpr("1 as k", "timestamp_millis(id * 1000) as r", "id as v")
    left = spark.range(50000).selectExpr("1 as k", "timestamp_millis(id * 1000) as d", "id")
    assert joins.asof_join(left, right, ["k"], "d", "r", ["v"]).filter("v <> id - id % 100").count() == 0
    assert joins.asof_join(left, right, ["k"], "d", "r", ["v"]).count() == 50000


def _plan(df):
    df.collect()  # the last plan is the one that ran
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_value_diff_reads_each_side_once_and_bucketed_tables_without_a_shuffle(spark, tmp_path):
    rng = random.Random(4)
    cells = [(c, p, f"f{k}", rng.choice([None, 1.0, 2.0])) for c in range(40) for p in range(3) for k in range(6) if rng.random() < 0.7]
    other = [(c, p, f, rng.choice([v, v, 3.0, None])) for c, p, f, v in cells if (c + p) % 4 and rng.random() < 0.9]
    kind = "cik long, period int, feature string, value double"
    a, b = spark.createDataFrame(cells, kind), spark.createDataFrame(other, kind)
    one, two = {(c, p, f): v for c, p, f, v in cells}, {(c, p, f): v for c, p, f, v in other}
    keys = {k[:2] for k in one} & {k[:2] for k in two}
    want = {}
    for f in {k[2] for k in one}:
        pairs = [(one.get((*k, f)), two.get((*k, f))) for k in keys]
        both = [abs(x - y) for x, y in pairs if x is not None and y is not None]
        bad = sum((x is None) != (y is None) for x, y in pairs) + sum(d > 1e-10 for d in both)
        want[f] = (len(both), bad, bad * 100.0 / len(keys), max(both))
    stored = [sinks.write_tall(d, f"diff_{n}", str(tmp_path / n), 4) for n, d in (("a", a), ("b", b))]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for left, right in ((a, b), stored):
            out = reconcile.value_diff(left, right, ["cik", "period"])
            assert {r["feature"]: (r["matching_pairs"], r["mismatches"], pytest.approx(r["mismatch_pct"]), r["max_abs_diff"]) for r in out.collect()} == want
        plan = _plan(out)
        # what is left to shuffle are sums for each feature
        assert plan.count("FileScan parquet") == 2 and "Bucketed: true" in plan
        assert all("hashpartitioning(feature" in x or "SinglePartition" in x for x in plan.splitlines() if " Exchange " in x)
        diff = {(r["cik"], r["period"]): (r["v1"], r["v2"]) for r in reconcile.feature_diff(*stored, ["cik", "period"], "f1").collect()}
        assert diff == {k: (one.get((*k, "f1")), two.get((*k, "f1"))) for k in keys if one.get((*k, "f1")) != two.get((*k, "f1"))}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for n in "ab":
            spark.sql(f"drop table diff_{n}")


def test_more_facts_of_customers_take_more_tasks(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    customers = [(c, "BUILDING", c % 25) for c in range(60)]
    orders = [(o, rng.choice([None, 7, rng.randrange(80)]), datetime.datetime(1995, rng.randrange(12) + 1, 3)) for o in range(600)]
    lines = [(rng.choice([None, rng.randrange(700)]), rng.randrange(40)) for _ in range(2000)]
    spark.createDataFrame(customers, "c_custkey long, c_mktsegment string, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(str(tmp_path / "orders.parquet"))
    items = spark.createDataFrame(lines, "l_orderkey long, l_partkey long").selectExpr(
        "*", "1 as l_linenumber", "3.0D as l_quantity", "1.0D as l_extendedprice", "'N' as l_returnflag", "timestamp_ntz'1995-05-05' as l_shipdate")
    items.write.parquet(str(tmp_path / "lineitem.parquet"))
    seen = {}
    filed = {o: (c, "left" if day.month > 9 else "right") for o, c, day in orders if c is not None and c < 60}
    for o, part in lines:
        if o in filed:
            cik, side = filed[o]
            seen.setdefault((cik, KEY_METRICS[part % len(KEY_METRICS)]), set()).add(side)
    want = {(*k, "both" if len(s) > 1 else min(s)) for k, s in seen.items()}
    parts = {}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows in (100, 1_000_000):  # 2,000 lines: 20 tasks, or the session's 8
            monkeypatch.setattr(session, "TASK_ROWS", rows)
            out = joining.u04(spark, str(tmp_path))
            got = [tuple(r) for r in out.collect()]
            assert len(got) == len(want) and set(got) == want
            plan = out._jdf.queryExecution().executedPlan().toString()
            parts[rows] = set(re.findall(r"hashpartitioning\(.*?, (\d+)\)", plan))
        assert parts == {100: {"20"}, 1_000_000: {"8"}}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
