"""Files and JSON on small fixtures."""

import datetime
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.sources import companyfacts, entities, filings, headers, prices, sinks

SUB_HEAD = "adsh\tcik\tname\tsic\tcountryba\tfye\tform\tperiod\tfy\tfp\tfiled\n"
NUM_HEAD = "adsh\ttag\tversion\tddate\tqtrs\tuom\tsegments\tcoreg\tvalue\tfootnote\n"


def _write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.fixture()
def quarters(tmp_path):
    for q, adsh in (("2024q1", "a"), ("2024Q2", "b")):
        _write(tmp_path / q / "sub.txt", SUB_HEAD + f"{adsh}\t320193\tNA\t\tUS\t0930\t10-Q\t\t2024\tQ1\t20240201\n{adsh}2\t5\tB\t3571\tUS\t1231\t10-K\t20231231\t2023\tFY\t20240301\n"
               + f"{adsh}3\t5\tB\t3571\tUS\t1231\t10-K\t20231231\t2023\tFY\t20240302\n")
        _write(tmp_path / q / "num.txt", NUM_HEAD + f"{adsh}\tAssets\tus-gaap/2023\t20231231\t0\tUSD\t\t\t5.5\t\n{adsh}\tOwn\t{adsh}\t20231231\t0\tUSD\tX=1;\t\t\tnote\n{adsh}2\tAssets\tus-gaap/2023\t20231231\t0\tUSD\t\t\t1\t\n")
    _write(tmp_path / "notes" / "sub.txt", "not a quarter\n")
    return str(tmp_path)


def test_headers_by_name_with_blanks_as_null(spark, quarters):
    rows = {r["adsh"]: r for r in filings.read_headers(spark, f"{quarters}/2024q1/sub.txt").collect()}
    assert rows["a"]["name"] == "NA" and rows["a"]["period"] is None and rows["a"]["sic"] is None and rows["a"]["cik"] == 320193
    assert rows["a2"]["filed"] == 20240301 and rows["a2"]["fp"] == "FY"


def test_quarters_and_join(spark, quarters):
    sub, num = filings.read_quarters(spark, quarters)
    assert {(r["adsh"], r["data_qtr"]) for r in sub.collect()} == {("a", "2024q1"), ("a2", "2024q1"), ("a3", "2024q1"), ("b", "2024q2"), ("b2", "2024q2"), ("b3", "2024q2")}
    joined = filings.load_quarters(spark, quarters).select("adsh", "tag", "custom_tag", "value", "segments").collect()
    assert sorted((r["adsh"], r["tag"], r["custom_tag"]) for r in joined) == [("a", "Assets", 0), ("a", "Own", 1), ("b", "Assets", 0), ("b", "Own", 1)]
    assert filings.read_quarters(spark, quarters, ["2024q1"])[1].count() == 3


def test_catchup_bundles_coerce_numbers(spark, tmp_path):
    _write(tmp_path / "f1" / "sub.txt", SUB_HEAD + "f1\tx9\tC\t\t\t\t10-Q\t20240331\t\t\t20240501\n")
    _write(tmp_path / "f1" / "num.txt", NUM_HEAD + "f1\tAssets\tus-gaap\tn/a\t1\tUSD\t\t\t7\t\n")
    r = filings.load_catchup(spark, str(tmp_path)).first()
    assert (r["cik"], r["period"], r["ddate"], r["qtrs"], r["value"]) == (None, 20240331, None, 1, 7.0)


def test_index_keeps_the_newest_row(spark):
    cols = "adsh string, run string, caught_up_at string"
    old = spark.createDataFrame([("a", "1", "2026-01-01T00:00:00"), ("b", "1", "2026-01-01T00:00:00")], cols)
    new = spark.createDataFrame([("a", "2", "2026-01-02T00:00:00")], cols)
    assert {r["adsh"]: r["run"] for r in filings.upsert_index(old, new).collect()} == {"a": "2", "b": "1"}


def test_price_files_of_both_dialects(spark, tmp_path):
    _write(tmp_path / "nasdaq_stocks" / "AAPL.US.txt", "<TICKER>,<PER>,<DATE>,<OPEN>,<CLOSE>\nAAPL.US,D,20240102,1,185.5\nAAPL.US,D,2024,1,9\n")
    _write(tmp_path / "nyse_stocks" / "ibm.us.csv", "Date,Open,Close\n2024-01-03,1,160\n")
    _write(tmp_path / "nyse_stocks" / "BRK-B.US.csv", "Date,Open,Close\n2024-01-03,1,360\n")
    _write(tmp_path / "nyse_stocks" / "T_A.US.csv", "Date,Open,Close\n2024-01-03,1,20\n")
    _write(tmp_path / "nyse_stocks" / "NONE.US.csv", "Day,Price\n2024-01-03,1\n")
    _write(tmp_path / "nyse_stocks" / "EMPTY.US.csv", "")
    rows = {(r["ticker"], r["exchange"], r["date"], r["close_price"]) for r in prices.read_price_files(spark, str(tmp_path)).collect()}
    assert rows == {
        ("AAPL", "nasdaq_stocks", datetime.date(2024, 1, 2), 185.5), ("AAPL", "nasdaq_stocks", None, 9.0),
        ("ibm.us", "nyse_stocks", datetime.date(2024, 1, 3), 160.0),
    }
    entity = spark.createDataFrame([("ibm", 51143)], "ticker string, cik long")
    mapped = prices.read_exchanges(spark, str(tmp_path), entity).collect()
    assert [(r["ticker"], r["cik"], r["exchange"]) for r in mapped] == [("IBM", 51143, "nyse_stocks")]


def test_price_batches_need_all_columns(spark, tmp_path):
    _write(tmp_path / "batch_1.csv", "Date,Close,cik,ticker\n2024-01-02 22:00:00-05:00,10.5,7,X\n")
    _write(tmp_path / "batch_2.csv", "Date,Price,cik,ticker\n2024-01-02,10.5,7,Y\n")
    _write(tmp_path / "other.csv", "Date,Close,cik,ticker\n2024-01-02,10.5,7,Z\n")
    rows = prices.read_price_batches(spark, str(tmp_path)).collect()
    assert [(r["cik"], r["ticker"], r["date"], r["close_price"]) for r in rows] == [(7, "X", datetime.date(2024, 1, 3), 10.5)]


def test_entity_maps(spark, tmp_path):
    doc = {"0": {"cik_str": 1, "ticker": "A", "title": "a"}, "1": {"cik_str": 1, "ticker": "A-W", "title": "a"}, "2": {"cik_str": 22, "ticker": "B", "title": "b"}}
    _write(tmp_path / "t.json", json.dumps(doc))
    rows = entities.entity_rows(entities.json_documents(spark, str(tmp_path / "t.json")))
    assert {r["cik_padded"]: r["ticker"] for r in entities.cik_to_ticker(rows).collect()} == {"0000000001": "A-W", "0000000022": "B"}
    assert {r["ticker"]: r["cik"] for r in entities.ticker_to_cik(rows).collect()} == {"A": 1, "A-W": 1, "B": 22}
    _write(tmp_path / "x.json", json.dumps({"fields": ["cik", "name", "ticker", "exchange"], "data": [[1, "Aa", "A", "NYSE"], [2, "Bb", "B", None]]}))
    got = entities.exchange_rows(entities.json_documents(spark, str(tmp_path / "x.json"))).collect()
    assert {(r["ticker"], r["name"], r["exchange"]) for r in got} == {("A", "Aa", "NYSE"), ("B", "Bb", None)}


def _facts_doc():
    def fact(accn, end, val, filed="2024-05-01", form="10-Q"):
        return {"accn": accn, "end": end, "val": val, "filed": filed, "form": form, "start": "2024-01-01"}

    facts = [fact("n", "2024-03-31", 1), fact("n", "2023-03-31", 2), fact("o", "2023-12-31", 3, "2024-02-01"), fact("k", "2024-06-30", 4, form="10-K"), fact("z", "bad", 5)]
    return {"facts": {"us-gaap": {"Assets": {"units": {"USD": facts}}}, "invest": {"X": {"units": {"USD": facts}}}}}


def test_facts_flatten_and_pick(spark):
    docs = spark.createDataFrame([(1, json.dumps(_facts_doc()))], "cik long, json string")
    flat = companyfacts.flatten_facts(docs)
    assert flat.count() == 5 and {r["taxonomy"] for r in flat.collect()} == {"us-gaap"}
    assert sorted(r["value"] for r in companyfacts.pick_filing(flat, "10-Q").collect()) == [1.0, 2.0]
    assert [r["value"] for r in companyfacts.pick_filing(flat, "10-Q", "2024-01-05").collect()] == [3.0]
    assert sorted(r["value"] for r in companyfacts.pick_filing(flat, "10-Q", "someday").collect()) == [1.0, 2.0]


def test_pick_falls_back_to_the_filing_date(spark):
    doc = {"facts": {"dei": {"T": {"units": {"USD": [
        {"end": "2024-03-31", "val": 1, "filed": "2024-05-01", "form": "10-Q"}, {"end": "2023-03-31", "val": 2, "filed": "2024-05-01", "form": "10-Q", "accn": "q"},
        {"end": "2023-01-31", "val": 3, "filed": "2024-02-01", "form": "10-Q", "accn": "r"}]}}}}}
    flat = companyfacts.flatten_facts(spark.createDataFrame([(1, json.dumps(doc))], "cik long, json string"))
    assert sorted(r["value"] for r in companyfacts.pick_filing(flat, "10-Q").collect()) == [1.0, 2.0]


def test_submissions(spark):
    recent = {"accessionNumber": ["1", "2", "3", "4"], "form": ["10-K", "8-K", "10-Q", "10-Q"], "filingDate": ["2024-01-01", "2024-01-01", "soon", None], "reportDate": ["2023-12-31"] * 4}
    docs = spark.createDataFrame([(1, json.dumps({"name": "N", "tickers": [], "sic": "", "filings": {"recent": recent}}))], "cik long, json string")
    assert [r["adsh"] for r in companyfacts.flatten_submissions(docs).orderBy("adsh").collect()] == ["1", "3", "4"]
    kept = companyfacts.flatten_submissions(docs, as_of="2024-06-01").orderBy("adsh")
    assert [r["adsh"] for r in kept.collect()] == ["1", "4"]
    info = companyfacts.company_info(docs).first()
    assert (info["name"], info["ticker"], info["sic"]) == ("N", "", None)
    head = companyfacts.header_rows(kept, companyfacts.company_info(docs)).orderBy("adsh").first()
    assert (head["period"], head["filed"], head["sic"]) == ("20231231", "20240101", None)


def test_feature_sink_replaces_only_its_quarters(spark, tmp_path):
    path = str(tmp_path / "features")
    assert sinks.missing_quarters(spark, path, ["2024q1"]) == ["2024q1"]
    cols = "cik long, form string, x double, data_qtr string"
    sinks.write_features(spark.createDataFrame([(1, "10-K", 1.0, "2024q1"), (1, "10-Q", 2.0, "2024q2")], cols), path)
    sinks.write_features(spark.createDataFrame([(2, "10-Q", 3.0, "2024q2")], cols), path)
    assert {(r["cik"], r["data_qtr"]) for r in sinks.read_features(spark, path).collect()} == {(1, "2024q1"), (2, "2024q2")}
    assert sinks.missing_quarters(spark, path, ["2024q1", "2024q3"]) == ["2024q3"]


def test_bundle_shape(spark):
    flat = companyfacts.flatten_facts(spark.createDataFrame([(1, json.dumps(_facts_doc()))], "cik long, json string"))
    bulk = companyfacts.to_bulk(flat)
    assert bulk.columns == companyfacts.BULK_COLUMNS
    assert {(r["ddate"], r["qtrs"]) for r in bulk.filter(F.col("adsh") == "n").collect()} == {(20240331, 1), (20230331, 0)}


def test_files_are_read_by_their_own_header(spark, tmp_path):
    for q, text in (
        ("2009q4", "adsh\ttag\tversion\tddate\tqtrs\tuom\tvalue\n1\tA\tv\t20091231\t0\tUSD\t5.0\n"),
        ("2010q1", "value\tsegments\tadsh\ttag\tversion\tuom\tqtrs\tddate\textra\n7.5\tX=1\t2\tB\tv\tUSD\t1\t20100331\tz\n"),
        ("2010q2", ""),
    ):
        (tmp_path / q).mkdir()
        (tmp_path / q / "num.txt").write_text(text)
    got = {r["adsh"]: r for r in filings.read_facts(spark, str(tmp_path / "*" / "num.txt")).collect()}
    assert (got["1"]["ddate"], got["1"]["qtrs"], got["1"]["uom"], got["1"]["value"], got["1"]["segments"]) == (20091231, 0, "USD", 5.0, None)
    assert (got["2"]["ddate"], got["2"]["qtrs"], got["2"]["uom"], got["2"]["value"], got["2"]["segments"]) == (20100331, 1, "USD", 7.5, "X=1")


def test_many_files_are_read_by_their_own_headers(spark, tmp_path):
    """2,000 files with three headers: one row for each header reaches the driver, which opens no file."""
    heads = [("a", "b", "c"), ("c", "a"), ("b", "x,y", "a")]
    for i in range(2000):
        names = heads[i % 3]
        text = ",".join(f'"{n}"' if "," in n else n for n in names) + ("\r\n" if i % 5 == 0 else "\n") + ",".join(f"{n[0]}{i}" for n in names) + "\n"
        (tmp_path / f"f {i}.csv").write_text(("\ufeff" if i % 7 == 0 else "") + text)
    (tmp_path / "empty.csv").write_text("")
    files = headers.files_of(spark, str(tmp_path))
    lines = headers.first_lines(spark, files)
    assert lines.count() <= 6  # with and without a mark at the beginning
    by = headers.by_header(spark, files, ",")
    assert {k: len(v) for k, v in by.items()} == {heads[0]: 667, heads[1]: 667, heads[2]: 666}
    shape = T.StructType([T.StructField(n, T.StringType()) for n in ("a", "b", "c")])
    rows = headers.read_named(spark, by, ",", shape)
    got = {r["a"]: (r["b"], r["c"]) for r in rows.collect()}
    assert got == {f"a{i}": (f"b{i}" if i % 3 != 1 else None, f"c{i}" if i % 3 != 2 else None) for i in range(2000)}
    assert headers.read_named(spark, {}, ",", shape).count() == 0 and headers.by_header(spark, [], ",") == {}


def test_headers_come_from_the_first_block_only(spark, tmp_path):
    """A file of many blocks has one header."""
    (tmp_path / "long.csv").write_text("a,b\n" + "".join(f"{i},{i}\n" for i in range(50_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        assert headers.first_lines(spark, [str(tmp_path / "long.csv")]).collect()[0]["line"] == "a,b"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_filing_is_picked_without_another_pass_over_the_facts(spark):
    rows = [(1, "10-Q", "a", "2020-01-31", "2019-12-31"), (1, "10-Q", "a", "2020-01-31", "2019-09-30"), (1, "10-Q", "b", "2019-10-31", "2019-09-30"),
            (None, "10-Q", None, "2020-01-31", "2019-12-31"), (None, "10-Q", None, "2020-01-31", None), (None, "10-Q", "c", "2019-01-31", None), (2, "10-K", "d", "2020-01-31", "2019-12-31")]
    flat = spark.createDataFrame(rows, "cik long, form string, accn string, filing_date string, report_date string").withColumn("report_date", F.to_date("report_date"))
    got = companyfacts.pick_filing(flat.repartition("cik"), "10-Q")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1 and got.columns == flat.columns
    assert sorted((str(r["cik"]), str(r["accn"]), str(r["report_date"])) for r in got.collect()) == [("1", "a", "2019-09-30"), ("1", "a", "2019-12-31"), ("None", "None", "2019-12-31"), ("None", "None", "None")]
