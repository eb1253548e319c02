"""The pipeline's stages on awkward rows and against plain versions."""

import os
import random
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from helpers import SPACE, ascii_lower, empty, hard, hard_rows, prose  # noqa: E402
from test_llm_documents import hits  # noqa: E402

import corpus_pipeline
from ledgerlight.llm import minhash, sentencepiece_scan, surrogates
from ledgerlight.llm.common import stored, stored_tables, table


def test_stages_and_query():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "benchmark", "privacy", "pieces"]
    assert list(corpus_pipeline.queries()) == ["pipeline"]


def test_every_stage_on_awkward_rows(spark, small):
    df, columns = hard(spark), hard(spark).columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        none = stage(spark, empty(spark), small)
        assert none.count() == 0, name
        out = stage(spark, df, small)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        assert out.count() <= len(hard_rows())
        df = stored(out, name)
    ids = sorted(str(r.doc_id) for r in df.collect())
    assert ids == sorted(["1", "6", "7", "8", "9", "10", "None"])


def shingles(text):
    words = re.findall(SPACE, ascii_lower(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard_groups(rows):
    """Smallest id of the group of every (id, text), by comparing all pairs."""
    label, sets = {i: i for i, _ in rows}, {i: shingles(t) for i, t in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and (a == b or (0.8 * max(len(a), len(b)) <= min(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b))):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return {i: find(i) for i in label}


def test_run_equals_plain_stages(spark, small):
    rows = sorted(table(spark, small, "documents").collect(), key=lambda r: r.doc_id)
    before = stored_tables()
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, small).collect()}
    assert stored_tables() == before + 1  # the result alone
    led = [r for r in rows if any(c.isalpha() for c in r.text or "")]
    groups = jaccard_groups([(r.doc_id, r.text) for r in led])
    first = {r.doc_id: r for r in led if groups[r.doc_id] == r.doc_id}
    items = [(r["item_id"], r["text"]) for r in table(spark, small, "benchmark").collect()]
    dirty = {h[0] for h in hits([(r.doc_id, r.text) for r in first.values()], items) if h[5]}
    want = {i: r for i, r in first.items() if i not in dirty}
    assert got.keys() == want.keys()
    with open(sentencepiece_scan.MODEL, "rb") as f:
        vocabulary = sentencepiece_scan.Vocabulary(f.read())
    plain = 0
    for i, r in got.items():
        assert (r.lang, r.source) == (want[i].lang, want[i].source)
        assert list(r.token_ids) == vocabulary.encode(r.text) and r.n_tokens == len(r.token_ids)
        plain += r.text == want[i].text
    mentions = spark.createDataFrame([(r.doc_id, r.text) for r in want.values()], "doc_id long, text string").filter(surrogates.F.size(surrogates.mentions(surrogates.F.col("text"))) > 0).count()
    assert plain == len(want) - mentions


def test_language_keeps_documents_of_many_languages(spark, small):
    docs = table(spark, small, "documents")
    parts = {}
    for r in docs.filter("text is not null and length(text) > 1200").collect():
        parts.setdefault(r.lang, " ".join(r.text.split()[:120]))
    assert len(parts) >= 3
    mixed = docs.limit(1).withColumn("text", F.lit(" ".join(parts[k] for k in sorted(parts))))
    assert corpus_pipeline.language(spark, docs.union(mixed.withColumn("doc_id", F.lit(-5).cast("long"))), small).filter("doc_id = -5").count() == 1


def test_near_copies_equal_brute_force_jaccard(spark):
    rng, rows = random.Random(11), []
    for base in range(12):
        for copy, changes in enumerate((0, 1, 2, 3, 4, 5, 6, 9, 14, 20)):
            words = prose(150 + 30 * base, base).split()
            for at in rng.sample(range(len(words)), changes):
                words[at] = f"new{rng.randrange(10**6)}"
            rows.append((base * 10 + copy, " ".join(words)))
    rows += [(900, None), (901, " "), (902, "one"), (903, "ONE")]
    want = set(jaccard_groups(rows).values())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, df, "").collect()} == want
    assert len(want) < len(rows) / 2


@pytest.mark.parametrize("block", [minhash.BLOCK, 3000])
def test_a_bucket_of_members_below_the_limit(spark, monkeypatch, block):
    """Many texts at a similarity of 0.5 to 0.78 to each other, and a few copies of some: what is written
    and compared grows with the members, and no link is lost."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "STAR", 50)
    sizes = {}
    plain_stored = minhash.stored
    monkeypatch.setattr(minhash, "stored", lambda df, name: (out := plain_stored(df, name), sizes.__setitem__(name, out.count()))[0])
    rng, base, rows = random.Random(2), [f"w{i}" for i in range(400)], []
    for i in range(300 if block > 5000 else 150):
        words = list(base[:300])
        # four or five shingles change with a word, so 7 to 16 changed words leave 0.5 to 0.78 to another text
        for at in rng.sample(range(300), rng.randrange(7, 16)):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
        if i % 50 == 0:
            words[rng.randrange(300)] = "copy"
            rows.append((10_000 + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = jaccard_groups(rows)
    got = {r.doc_id for r in minhash.one_of_each(df).collect()}
    assert got == set(groups.values()) and len(got) < len(rows)
    assert max(sizes.values()) <= minhash.BANDS * len(rows)
    assert sizes["block-links"] <= minhash.BANDS * len(rows) and sizes["open-buckets"] > 0


def test_two_thousand_members_of_one_bucket(spark, monkeypatch):
    """One group, no member linked: rows follow the members, not their 2 million pairs."""
    rng = np.random.default_rng(3)
    common = np.sort(rng.integers(1, 1 << 62, 150).astype(np.uint64))
    own = [np.unique(np.concatenate([common, rng.integers(1, 1 << 62, 40).astype(np.uint64)])) for _ in range(2000)]
    label = minhash.group_links(own, np.zeros(2000, dtype=np.int64), np.arange(2000))
    assert (label == np.arange(2000)).all()  # 150 of 230 shingles: 0.65
    own[1999] = np.unique(np.concatenate([own[7][:-3], own[7][:1]]))
    label = minhash.group_links(own, np.zeros(2000, dtype=np.int64), np.arange(2000))
    assert np.flatnonzero(label != np.arange(2000)).tolist() == [1999] and label[1999] == 7


def test_overlaps_of_all_sets():
    rng = np.random.default_rng(5)
    for n, m, kinds in ((1, 1, 5), (3, 40, 30), (60, 50, 200), (40, 40, 10_000)):
        a, b = ([np.unique(rng.integers(0, kinds, rng.integers(1, 80)).astype(np.int64)) for _ in range(k)] for k in (n, m))
        want = [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]
        assert minhash.overlaps(a, b).tolist() == want


def test_near_copies_in_any_script(spark):
    """Texts without spaces, in capitals or in other forms of equal characters are near copies too."""
    rng = random.Random(4)
    han, thai = ("".join(chr(rng.randint(a, b)) for _ in range(300)) for a, b in ((0x4E00, 0x9FA5), (0x0E01, 0x0E2E)))
    french = " ".join(w + "é" for w in prose(80, 9).split())
    rows = [(1, han), (2, han[:150] + "\u4e00" + han[151:]), (3, han[150:] + han[:20]), (4, thai), (5, thai[:-2]), (6, french), (7, french.upper()), (8, french.replace("é", "e\u0301").replace(" ", "\u00a0"))]
    kept = minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3, 4, 6]


def test_near_copies_without_spaces_or_with_others(spark):
    """Data and code in one piece, more scripts without spaces, other white space, unseen characters and
    case folding: of each text a copy with small changes goes, and another text of the kind stays."""
    rng = random.Random(8)
    kinds = {
        "values": lambda: ",".join(str(rng.randrange(10**5)) for _ in range(200)),
        "base64": lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1500)),
        "glued": lambda: "".join(prose(200, rng.randrange(10**6)).replace(".\n", "").split()),
        "tibetan": lambda: "".join(chr(rng.randint(0x0F40, 0x0F6C)) for _ in range(300)),
        "javanese": lambda: "".join(chr(rng.randint(0xA984, 0xA9B2)) for _ in range(300)),
    }
    rows = []
    for k, make in enumerate(kinds.values()):
        text, other = make(), make()
        rows += [(10 * k, text), (10 * k + 1, text[: len(text) // 2] + text[len(text) // 2 + 1 :]), (10 * k + 2, other)]
    words = [w + "ß" for w in prose(80, 9).replace(".\n", " ").split()]
    ways = ["\u2028".join(words), "\u200b".join(words), "\u1680".join(words), " ".join(w[:2] + "\u00ad" + w[2:] for w in words), " ".join(words).replace("ß", "SS")]
    rows += [(90, " ".join(words)), *[(91 + i, t) for i, t in enumerate(ways)]]
    kept = minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == sorted([i for i, _ in rows if i < 90 and i % 10 != 1] + [90])


def test_words_of_plain_texts_are_those_between_spaces():
    """A long address or line of signs in prose is one word; texts of signs alone keep them together."""
    address = "https://example.com/" + "a,b-c/" * 30
    for text in (f"{prose(60)} {address} {prose(20, 1)}", "Tom, Dick. " * 9, "", "one", "x" * minhash.LONGEST, " \n"):
        assert minhash.comparable(text) == text
    assert minhash.comparable("=" * 400).split() == ["=" * 400] and minhash.comparable(None) is None
    assert "".join(minhash.comparable(address).split()) == address
