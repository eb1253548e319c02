"""Statistics kept by quarter: equal to those over all rows, and old quarters are not read again."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight import config as C
from ledgerlight.operators import explore, facts, features, quarterly
from ledgerlight.sources.sinks import write_features

PROBS = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.75, "e": 0.999, "f": 1.0}
QUARTERS = ["2020q1", "2020q2", "2020q3"]


def _values(seed=3, n=6000):
    """One feature with most rows, one of few values, one constant, one in a single row, one in one quarter."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        q = rng.choice(QUARTERS)
        rows.append((q, "hot", rng.choice([rng.gauss(0, 3), 0.5, float(rng.randint(-4, 4))])))
        if rng.random() < 0.2:
            rows.append((q, "few", float(rng.choice([1, 1, 1, 2, 7]))))
            rows.append((q, "flat", 2.5))
        if rng.random() < 0.05:
            rows.append((QUARTERS[1], "late", rng.random()))
            rows.append((q, "hot", None))
            rows.append((q, None, 1.0))
    return rows + [(QUARTERS[0], "one", 3.0)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("values"))
    tall = spark.createDataFrame(_values(), "data_qtr string, feature string, value double")
    quarterly.add_values(tall, path, QUARTERS[:2], cell=50)
    quarterly.add_values(tall, path, QUARTERS[2:], cell=50)
    return path


def _of(feature, rows=None):
    return [v for _, f, v in rows or _values() if f == feature and v is not None]


def test_quantiles_are_exact(spark, stored):
    got = {r["feature"]: r for r in quarterly.stored_quantiles(spark, stored, PROBS).collect()}
    assert set(got) == {"hot", "few", "flat", "late", "one"}
    for feature, row in got.items():
        assert row["n"] == len(_of(feature))
        for name, p in PROBS.items():
            assert row[name] == pytest.approx(np.quantile(_of(feature), p), abs=1e-12), (feature, name)


def test_moments_come_from_the_summaries(spark, stored):
    got = {r["feature"]: r for r in quarterly.stored_moments(spark, stored).collect()}
    for feature, row in got.items():
        v = _of(feature)
        assert row["non_null"] == len(v) and row["mean_value"] == pytest.approx(np.mean(v))
        assert row["std_value"] is None if len(v) == 1 else row["std_value"] == pytest.approx(np.std(v, ddof=1), abs=1e-9)


def test_few_values_are_read_for_a_quantile(spark, stored, monkeypatch):
    """A quantile reads some cells of each quarter, not the values of a feature."""
    read = []
    whole = quarterly._open

    def counting(*args):
        out = whole(*args)
        read.append(out.count())
        return out

    monkeypatch.setattr(quarterly, "_open", counting)
    quarterly.stored_quantiles(spark, stored, {"m": 0.7}).collect()
    assert 0 < read[0] <= 4 * 50 * len(QUARTERS) * 5 < len(_of("hot"))


def test_a_new_quarter_reads_no_old_rows(spark, tmp_path):
    """The source of the old quarters is gone when the new one is added."""
    path, rows = str(tmp_path / "kept"), _values(5, 500)
    tall = spark.createDataFrame(rows, "data_qtr string, feature string, value double")
    quarterly.add_values(tall, path, QUARTERS[:2])
    quarterly.add_values(tall.filter(F.col("data_qtr") == QUARTERS[2]), path, QUARTERS[2:])
    assert quarterly.value_quarters(spark, path) == QUARTERS
    assert quarterly.stored_quantiles(spark, path, {"m": 0.5}).filter("feature = 'hot'").first()["m"] == pytest.approx(np.median(_of("hot", rows)))
    # adding a quarter again replaces it
    quarterly.add_values(tall.withColumn("value", F.col("value") + 100), path, [QUARTERS[0]])
    moved = [v + 100 if q == QUARTERS[0] else v for q, f, v in rows if f == "hot" and v is not None]
    row = quarterly.stored_quantiles(spark, path, {"m": 0.5}).filter("feature = 'hot'").first()
    assert row["n"] == len(moved) and row["m"] == pytest.approx(np.median(moved))


def test_a_quarter_without_summaries_is_missing_and_repeated(spark, tmp_path):
    """A run that ended between the values and their summaries."""
    path, rows = str(tmp_path / "kept"), _values(6, 300)
    tall = spark.createDataFrame(rows, "data_qtr string, feature string, value double")
    quarterly.add_values(tall, path, QUARTERS)
    quarterly.delete_paths(spark, f"{path}/cells/data_qtr={QUARTERS[1]}")
    assert quarterly.value_quarters(spark, path) == [QUARTERS[0], QUARTERS[2]]
    quarterly.add_values(tall, path, [QUARTERS[1]])
    assert quarterly.stored_quantiles(spark, path).filter("feature = 'hot'").first()["n"] == len(_of("hot", rows))


def test_empty_and_odd_quarters(spark, tmp_path):
    path = str(tmp_path / "kept")
    tall = spark.createDataFrame([], "data_qtr string, feature string, value double")
    quarterly.add_values(tall, path, QUARTERS)
    assert quarterly.value_quarters(spark, path) == []
    assert quarterly.stored_quantiles(spark, path).count() == 0 and quarterly.stored_moments(spark, path).count() == 0
    assert quarterly.stored_outlier_report(spark, path).count() == 0
    with pytest.raises(ValueError):
        quarterly.add_values(tall, path, ["../other"])


def test_outlier_report_equals_that_over_all_rows(spark, tmp_path):
    rng = random.Random(8)
    names = [r.column for r in C.RATIOS]
    rows = [(rng.choice(QUARTERS), *[None if rng.random() < 0.1 else rng.gauss(0.5, 1) * rng.choice([1, 1, 1, 40]) for _ in names]) for _ in range(900)]
    wide = spark.createDataFrame(rows, "data_qtr string, " + ", ".join(f"`{c}` double" for c in names))
    path = str(tmp_path / "kept")
    tall = features.unpivot_ratios(wide, ["data_qtr"]).withColumnRenamed("ratio", "feature")
    for q in QUARTERS:
        quarterly.add_values(tall, path, [q], cell=16)
    want = {r["ratio"]: r.asDict() for r in features.outlier_report(wide).collect()}
    got = {r["ratio"]: r.asDict() for r in quarterly.stored_outlier_report(spark, path).collect()}
    assert set(got) == set(want) == set(names) and any(r["extreme_iqr"] for r in want.values())
    for ratio, row in want.items():
        assert {k: pytest.approx(v) if isinstance(v, float) else v for k, v in row.items()} == got[ratio]
    bounds = quarterly.stored_bounds(spark, path)
    ids = wide.withColumn("id", F.monotonically_increasing_id())
    for flag in (features.extreme_flag, features.expected_range_flag):
        assert flag(ids, bounds).filter("flag_outlier").count() == flag(ids).filter("flag_outlier").count() > 0


def _facts(spark):
    """A tag of nearly all companies, one of few, rows without a company or a tag, numbers far apart."""
    rng = random.Random(4)
    rows = [(q, rng.choice(["10-K", "10-Q"]), "common", cik, cik * 10 + i) for i, q in enumerate(QUARTERS) for cik in range(100, 40100, 3)]
    rows += [(rng.choice(QUARTERS), rng.choice(["10-K", "10-Q", "8-K"]), rng.choice(["rare", "odd", None]), rng.choice([5, 99999999999, 40000, 7, None]), i) for i in range(400)]
    return spark.createDataFrame(rows, "data_qtr string, form string, tag string, cik long, adsh long")


def test_company_sets_count_like_all_rows(spark, tmp_path):
    f, path = _facts(spark), str(tmp_path / "sets")
    for q in QUARTERS:
        write_features(quarterly.company_sets(f.filter(F.col("data_qtr") == q), ["form", "tag"]), path)
    write_features(quarterly.company_sets(f.filter(F.col("data_qtr") == QUARTERS[1]), ["form", "tag"]), path)  # replaced, not added
    sets = spark.read.parquet(path)
    assert sets.filter("bits is not null").count() > 0 and sets.filter("few is not null").count() > 0

    def rows(df):
        return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=str)

    assert rows(quarterly.tag_stats(sets)) == rows(facts.tag_stats(f))
    assert rows(quarterly.form_overlap(sets)) == rows(explore.form_overlap(f.filter("cik is not null")))
    tags = ["common", "rare", "none of these"]
    assert rows(quarterly.tag_population(sets, tags)) == rows(explore.tag_population(f, tags))
    total = quarterly.count_companies(sets, []).first()
    assert total["companies"] == f.select("cik").distinct().count() - 1 and total["occurrences"] == f.count()


def test_company_sets_of_nothing(spark):
    sets = quarterly.company_sets(_facts(spark).limit(0), ["form", "tag"])
    assert quarterly.tag_stats(sets).count() == 0
    assert tuple(quarterly.form_overlap(sets).first()) == (0, 0, 0)
    assert quarterly.tag_population(sets, ["x"]).first()["pct"] == 0.0
