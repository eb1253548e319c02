"""Chat, shards and archives against plain versions of their contracts."""

import collections
import hashlib
import os
import random
import re
import sys
import zlib

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from helpers import empty, hard, hard_rows, prose  # noqa: E402

import check
from ledgerlight.llm import chat, oracle_sql, queries, slots, warc
from ledgerlight.llm.common import table
from ledgerlight.session import table_path


@pytest.mark.parametrize("key", sorted(oracle_sql()))
def test_query_equals_sql(spark, small, key):
    ok, message = check.compare(spark, check.duck(small), queries()[key], oracle_sql()[key], small)
    assert ok, message


# ---- op3


def test_op3_any_text_comes_back():
    rng = random.Random(1)
    bits = [*chat.CONTROL, "\\", "<", "[", "s>", "/s>", "|im_end|>", "\n", "a", "é", "<\\s>", "[\\INST]", "<\\\\/s>", "<<"]
    for _ in range(4000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 8)))
        role = "".join(rng.choices(["user", "\n", "\\", "<", "[", "n", "l"], k=rng.randint(0, 3)))
        made, a, b = chat.render_turn(role, text)
        assert chat.parse(made + made) == [(role, text)] * 2
        assert chat.unescape(made[a:b]) == text
        assert not any(c in made[a:b] for c in chat.CONTROL)


def test_op3_plain_text_is_not_escaped():
    assert chat.render_turn("user", "a < b [x] \\ c")[0] == "<|im_start|>user\na < b [x] \\ c<|im_end|>\n"


def test_op3_broken_text_is_an_error():
    for text in ("x", "<|im_start|>user\nabc", "<|im_start|>user\na</s>b<|im_end|>\n", "<|im_start|>user"):
        with pytest.raises(chat.GrammarError):
            chat.parse(text)


def test_op3_awkward_rows(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", None), (1, None, None, "x"), (None, 0, "user", "y"), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (3, 0, "assistant", "é" * 9000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    made = chat.format_turns(df)
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    want = collections.defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((t is not None, t or 0, r or "", x or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        turns = sorted(turns)
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = {r.conv_id: r for r in chat.conversation_texts(made).collect()}
    for c, r in whole.items():
        assert len(r.formatted) == got[c].formatted_chars
        assert "".join(chat.unescape(r.formatted[s.start : s.end]) for s in r.loss_spans) == "".join(x for _, _, role, x in sorted(want[c]) if role == "assistant")
        assert len(chat.parse(r.formatted)) == got[c].n_turns
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


# ---- op4


def check_shards(rows, shards):
    places = collections.defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in places.values())
    assert set(places) <= set(range(shards))


def test_op4_bytes_are_near_equal(spark, small):
    rows = queries()["op4_virtual_slots"](spark, small).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, small, "documents").collect()}
    assert len(rows) == len(texts)
    check_shards(rows, 8)
    total = collections.Counter()
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        total[r.shard] += r.size
    assert max(total.values()) - min(total.values()) <= max(r.size for r in rows)


def test_op4_a_hot_text_is_divided(spark):
    rows = [(i, prose(40) if i % 3 == 0 else f"text {i}") for i in range(6000)]
    out = slots.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    check_shards(out, 8)
    total = collections.Counter()
    for r in out:
        total[r.shard] += r.size
    assert max(total.values()) < 1.05 * min(total.values())


def test_op4_equal_texts_stay_together(spark):
    rows = [(i, f"text {i // 4} " + prose(20, i // 4)) for i in range(2000)]
    out = slots.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    where = collections.defaultdict(set)
    for r in out:
        where[r.doc_id // 4].add(r.shard)
    assert all(len(x) == 1 for x in where.values())


def test_op4_map_versions(spark):
    docs = spark.createDataFrame([(i, prose(5 + i % 50, i)) for i in range(3000)], "doc_id long, text string")
    path = table_path(spark, "map")
    out = slots.shard_documents(docs, 8, path)
    first, second = slots.read_map(spark, path, 1), slots.read_map(spark, path, 2)
    assert first.count() == second.count()
    sizes = slots.slot_bytes(slots.divided(slots.keyed(docs)))
    third = slots.save_map(slots.grown(sizes, second, 9), path, 3)
    moved = second.join(third.withColumnRenamed("shard", "to"), ["virtual_slot", "part"]).filter("shard <> to")
    assert {r.to for r in moved.select("to").distinct().collect()} == {8}
    loads = {r.shard: r.b for r in sizes.join(third, ["virtual_slot", "part"]).groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
    assert len(loads) == 9 and loads[8] > 0.9 * sum(loads.values()) / 9
    at = table_path(spark, "shards")
    slots.write_shards(docs.withColumn("shard", F.lit("x")), second, at)
    written = {r.doc_id: r.shard for r in spark.read.parquet(at).collect()}
    assert written == {r.doc_id: r.shard for r in out.collect()}


def test_op4_awkward_rows(spark):
    out = slots.shard_documents(hard(spark), 3).collect()
    assert len(out) == len(hard_rows())
    check_shards(out, 3)
    assert sorted(r.size for r in out) == sorted(len((x[1] or "").encode()) + 1 for x in hard_rows())
    assert slots.shard_documents(empty(spark), 3).count() == 0


@pytest.mark.parametrize("name", ["op4_virtual_slots", "op8_warc_revisits"])
def test_no_python_in_the_plan(spark, small, name):
    assert not re.search("Python|Pandas|Arrow", queries()[name](spark, small)._jdf.queryExecution().toString())


# ---- op8

PAGES = "page_id long, url string, html string, digest string, payload string"


def pages(spark):
    big, other = "<p>" + prose(300), "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 60
    rows = [(1, "http://a/ b\r\nx: y", big), (5, "http://b", big), (3, None, big), (4, "http://c", other), (6, "u", other), (6, "u", other), (7, "u", None), (8, "u", ""), (9, "u", "short"), (10, "u", "short"), (None, "u", big), (None, None, None), (11, "u", "é\n\r\n" * 500)]
    return spark.createDataFrame([(*r, "d", "p") for r in rows], PAGES), rows


def expected(rows):
    top = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000:
            top.setdefault(data, []).append(-1 if i is None else i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        keep = max(top.get(data, [-1]))
        revisit = len(top.get(data, [])) > 1 and i != keep
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keep if revisit else None))
    return sorted(out, key=str)


def shown(records):
    return sorted([tuple(r) for r in warc.followed(records).select("page_id", "payload_bytes", "digest", "record_type", "refers_to").collect()], key=str)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_op8_archives_come_back(spark, compression):
    df, rows = pages(spark)
    at = warc.write_archive(warc.resolved(warc.page_records(df)), table_path(spark, "warc"), compression=compression)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        read = warc.read_archive(spark, at)
        assert shown(read) == expected(rows)
        kept = {r.page_id: r.payload for r in read.filter("record_type = 'response'").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert kept[5] == rows[0][2] and kept[6] == rows[3][2] and kept[11] == rows[12][2]


def test_op8_deduplicates_an_archive(spark):
    df, rows = pages(spark)
    plain = warc.write_archive(warc.resolved(warc.page_records(df), least=1 << 30), table_path(spark, "warc"))
    assert warc.read_archive(spark, plain).filter("record_type = 'revisit'").count() == 0
    again = warc.deduplicate_archive(spark, plain, table_path(spark, "warc"))
    assert shown(warc.read_archive(spark, again)) == expected(rows)
    third = warc.deduplicate_archive(spark, again, table_path(spark, "warc"))
    assert shown(warc.read_archive(spark, third)) == expected(rows)


def test_op8_damage_is_an_error(spark):
    at = warc.write_archive(warc.resolved(warc.page_records(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"))), table_path(spark, "warc"), compression="none")
    folder = at.removeprefix("file:")
    name = next(x for x in os.listdir(folder) if x.startswith("part-"))
    with open(os.path.join(folder, name), newline="") as f:
        text = f.read()
    for old, new in (("abc", "abd"), ("abc\r\n\r\n", "a")):
        with open(os.path.join(folder, name), "w", newline="") as f:
            f.write(text.replace(old, new))
        for x in os.listdir(folder):
            if x.endswith(".crc"):
                os.remove(os.path.join(folder, x))
        with pytest.raises(Exception, match="digest|Content-Length"):
            warc.read_archive(spark, at).collect()


def test_op8_no_pages(spark):
    df, _ = pages(spark)
    at = warc.write_archive(warc.resolved(warc.page_records(df.limit(0))), table_path(spark, "warc"))
    assert warc.read_archive(spark, at).count() == 0


def test_op8_page_ids_of_any_text(spark):
    """Text ids with line breaks, colons, percent signs or nothing come back, in revisits as well."""
    ids = ["a b", "x\r\nWARC-Type: response", "50%2B", "é:+", "", None]
    df = spark.createDataFrame([(i, f"http://h/{n}", "p" * 1200) for n, i in enumerate(ids)], "page_id string, url string, html string")
    at = warc.write_archive(warc.resolved(warc.page_records(df)), table_path(spark, "warc"))
    got = [(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.followed(warc.read_archive(spark, at, "string")).collect()]
    top = max(i for i in ids if i is not None)
    assert sorted(got, key=str) == sorted([(i, "response", None) if i == top else (i, "revisit", top) for i in ids], key=str)
