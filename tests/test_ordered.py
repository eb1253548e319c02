"""Ordered operators against brute force, with one group that holds most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import evaluate, ordered
from ledgerlight.operators.clean import hash_split, impute_median, split_by_value


def _rows(n=3000):
    rng = random.Random(3)
    out = []
    for i in range(n):
        g = "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None])
        out.append((g, i, float(rng.choice([1, 2, 2, 2, 5, 9, 9.5])), rng.random()))
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(_rows(), "g string, id int, v double, x double")


def test_row_number_matches_sorting(frame):
    got = {(r["g"], r["id"]): r["rank"] for r in ordered.global_row_number(frame, ["g"], [F.desc("v"), F.asc("id")]).collect()}
    want, seen = {}, {}
    for g, i, v, _ in sorted(_rows(), key=lambda r: (-r[2], r[1])):
        seen[g] = seen.get(g, 0) + 1
        want[(g, i)] = seen[g]
    assert got == want


def test_a_hot_group_spreads_over_blocks(spark):
    """One group with 70 % of the rows, half of them at one score, never meets in one block."""
    rows = spark.range(80000).selectExpr("if(id % 10 < 7, 'hot', concat('k', id % 97)) g", "if(id % 2 = 0, 0.5D, id / 80000D) v", "id")
    # small blocks are merged adaptively; at size they stay apart
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = ordered.range_blocks(rows, ["g"], [F.desc("v"), F.asc("id")], "b")
        sizes = [r["n"] for r in blocks.groupBy("b").agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 8 and max(sizes) < 2 * 80000 / 8


def test_running_sum_without_keys(frame):
    out = ordered.running(frame, [], [F.asc("id")], {"cum": F.col("v")}, totals={"cum": "total"})
    got = sorted((r["id"], round(r["cum"], 6), round(r["total"], 6)) for r in out.collect())
    total = 0.0
    whole = round(sum(r[2] for r in _rows()), 6)
    for i, (_, idx, v, _) in enumerate(sorted(_rows(), key=lambda r: r[1])):
        total += v
        assert got[i] == (idx, round(total, 6), whole)


def test_quantiles_match_numpy(frame):
    out = {r["g"]: r for r in ordered.exact_quantiles(frame, ["g"], "x", {"q1": 0.25, "q2": 0.5, "q9": 0.9}).collect()}
    for g in ("hot", "a", "b", None):
        xs = [r[3] for r in _rows() if r[0] == g]
        assert out[g]["n"] == len(xs)
        for name, p in (("q1", 0.25), ("q2", 0.5), ("q9", 0.9)):
            assert out[g][name] == pytest.approx(np.quantile(xs, p), abs=1e-12)


def test_top_rows_plan_cuts_before_the_shuffle(frame):
    top = ordered.top_rows(frame, ["g"], [F.desc("v"), F.asc("id")], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert top.count() == 12


def test_split_takes_whole_values_in_order(spark):
    df = spark.createDataFrame([(v,) for v in [1, 1, 2, 2, 2, 3, 4, 4, None, 5]], "v int")
    train, val = split_by_value(df, 0.5, "v")
    assert sorted(r["v"] for r in train.collect()) == [1, 1, 2, 2, 2]
    assert val.count() == 5
    top, _ = split_by_value(df, 0.5, "v", "top")
    assert sorted(r["v"] for r in top.collect()) == [3, 4, 4, 5]
    a, b = split_by_value(df, 0.5, "v", "random")
    assert {r["v"] for r in a.collect()}.isdisjoint({r["v"] for r in b.collect()}) and a.count() + b.count() == 10 and a.count() <= 5


def test_hash_split_keeps_keys_together(frame):
    parts = hash_split(frame, ["id"], [0.5, 0.2, 0.3])
    ids = [{r["id"] for r in p.select("id").collect()} for p in parts]
    assert sum(map(len, ids)) == 3000 and not (ids[0] & ids[1] or ids[1] & ids[2] or ids[0] & ids[2])


def test_impute_uses_the_train_median_and_zero_for_empty_columns(spark):
    train = spark.createDataFrame([(1.0, None), (3.0, None), (float("inf"), None), (8.0, None)], "a double, b double")
    test = spark.createDataFrame([(None, 2.0), (float("nan"), None)], "a double, b double")
    _, out = impute_median(train, test, ["a", "b"])
    assert [tuple(r) for r in out.orderBy("b").collect()] == [(3.0, 0.0), (3.0, 2.0)]


def test_auc_counts_ties_half(spark):
    rows = [(0.9, 1), (0.9, 0), (0.5, 1), (0.4, 0), (0.4, 1), (0.1, 0)]
    df = spark.createDataFrame(rows, "score double, label int")
    pairs = [(p, n) for p, a in rows if a == 1 for n, b in rows if b == 0]
    want = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in pairs) / len(pairs)
    assert evaluate.auc(df, "score", "label").first()["auc"] == pytest.approx(want)


def test_contrastive_batches_match_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), int(i % 3), [float(x) for x in rng.normal(size=4)]) for i in range(25)]
    df = spark.createDataFrame([(*r, r[0] // 10) for r in rows], "id long, y int, v array<double>, part int")
    out = evaluate.contrastive_separation(df, "id", "v", "y", "part")
    means = {r["part"]: (r["loss"], r["anchors"]) for r in evaluate.contrastive_loss(out, "part").collect()}
    assert means[None][1] == 25 and means[2][1] == 5 and means[0][0] == pytest.approx(np.mean([r["loss"] for r in out.collect() if r["part"] == 0]))
    got = {r["id"]: (r["part"], r["loss"]) for r in out.collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}
    for i, y, _ in rows:
        mates = [(j, k) for j, k, _ in rows if j // 10 == i // 10 and j != i]
        e = {j: np.exp(unit[i] @ unit[j] / 0.1) for j, _ in mates}
        want = -np.log(sum(e[j] for j, k in mates if k == y) / (sum(e.values()) + 1e-8) + 1e-8)
        assert got[i][0] == i // 10 and got[i][1] == pytest.approx(want, rel=1e-6)


def test_contrastive_batches_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "LARGEST_BATCH", 4)
    df = spark.range(5).selectExpr("id", "id % 2 as y", "array(1.0D, id) as v", "0 as part")
    with pytest.raises(Exception, match="a batch has 5 rows"):
        evaluate.contrastive_separation(df, "id", "v", "y", "part").collect()


def test_exact_quantiles_of_large_groups_use_brackets(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=30_000), np.full(9_000, 0.25), rng.integers(0, 5, size=11_000)])
    df = spark.createDataFrame([(None if i % 2 else 1, float(v)) for i, v in enumerate(values)] + [(1, None)], "g int, x double")
    got = {r["g"]: r for r in ordered.exact_quantiles(df, ["g"], "x", {"a": 0.01, "b": 0.5, "c": 0.999, "d": 1.0}).collect()}
    for g, part in ((1, values[::2]), (None, values[1::2])):
        assert got[g]["n"] == len(part)
        for name, p in (("a", 0.01), ("b", 0.5), ("c", 0.999), ("d", 1.0)):
            assert got[g][name] == pytest.approx(np.quantile(part, p), abs=1e-12)


@pytest.mark.parametrize("keys", [["g"], []])
def test_last_known_and_next_known_match_a_loop(spark, keys):
    rng = random.Random(7)
    rows = [(g, i, rng.random() if rng.random() < 0.05 else None, i % 2) for i, g in enumerate(rng.choice(["hot", "hot", "hot", "a", None]) for _ in range(4000))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, id int, v double, side int").repartition(5)
    got = {r["id"]: (r["before"], r["after"]) for r in ordered.last_known(df, keys, ["id", "side"], {"before": "v"}, {"after": "v"}).collect()}
    want_before, want_after, seen = {}, {}, {}
    for g, i, v, _ in sorted(rows, key=lambda r: r[1]):
        k = g if keys else 0
        seen[k] = seen.get(k) if v is None else v
        want_before[i] = seen[k]
    seen = {}
    for g, i, v, _ in sorted(rows, key=lambda r: -r[1]):
        k = g if keys else 0
        seen[k] = seen.get(k) if v is None else v
        want_after[i] = seen[k]
    assert got == {i: (want_before[i], want_after[i]) for i in want_before}


def test_last_known_of_one_key_is_spread(spark):
    """No window of the plan is over the key alone but that over its blocks' ends."""
    df = spark.range(60000).selectExpr("1 as k", "id as t", "if(id % 1000 = 0, id, null) as v")
    out = ordered.last_known(df, ["k"], ["t"], {"b": "v"}, {"a": "v"})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window " in f" {line.strip(' +-:')} "]
    assert windows and all("_block" in line for line in windows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["n"] for r in ordered.range_blocks(df, ["k"], [F.col("t")], "b").groupBy("b").agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 8 and max(sizes) < 2 * 60000 / 8
    assert out.filter("b <> t - t % 1000 or a <> (t + 999) - (t + 999) % 1000").count() == 0
    assert ordered.last_known(df.limit(0), ["k"], ["t"], {"b": "v"}).count() == 0


def test_rows_of_a_hot_group_do_not_meet_for_its_quantiles(spark):
    """The brackets come to the rows: one group's rows stay in the tasks that read them."""
    df = spark.range(60_000).selectExpr("case when id < 50000 then 'hot' when id < 59990 then 'b' end as k", "cast(id as double) as v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = ordered.exact_quantiles(df, ["k"], "v", {"m": 0.5})
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert {r["k"]: (r["n"], r["m"]) for r in got.collect()} == {"hot": (50_000, 24_999.5), "b": (9_990, 54_994.5), None: (10, 59_994.5)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
