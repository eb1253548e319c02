"""Spelling variants against all pairs of words."""

import collections
import os
import random
import re
import sys
import zlib

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from helpers import empty, hard, hard_rows  # noqa: E402

from ledgerlight.llm import queries, variants  # noqa: E402
from ledgerlight.llm.common import table  # noqa: E402


def plain_words(rows, least=5):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode()) & 0xFFFFFFFF
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def plain_groups(words):
    near = {w: [] for w in words}
    todo = sorted(words)
    for i, a in enumerate(todo):
        for b in todo[i + 1 :]:
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def found(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_equals_all_pairs(spark, small):
    rows = [(r.doc_id, r.text) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    want = plain_groups(plain_words(rows))
    assert found(queries()["op13_gram_variants"](spark, small)) == want
    assert sum(x[3] for x in want.values()) > 100


@pytest.mark.parametrize("frequent", [0, 3, 64])
def test_dense_words_equal_all_pairs(spark, monkeypatch, frequent):
    """Few syllables, so that most grams are frequent, chains of forms, and every place of an edit."""
    monkeypatch.setattr(variants, "FREQUENT", frequent)
    rng = random.Random(frequent)
    words = {}
    for _ in range(250):
        w = "".join(rng.choice(["an", "ana", "th", "é", "ß", "tion", "aa", "b"]) for _ in range(rng.randrange(3, 7)))
        if len(w) < 6:
            w += "ananan"
        words[w] = rng.choice([5, 26, 140, 800, 4500])
        for _ in range(2):
            at = rng.randrange(len(w) + 1)
            v = rng.choice([w[:at] + rng.choice("anthé") + w[at:], w[:at] + w[at + 1 :], w[:at] + rng.choice("anz") + w[at + 1 :]])
            if len(v) >= 6:
                words[v] = rng.choice([5, 26, 140])
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = plain_groups(words)
    assert found(variants.grouped(df)) == want
    assert any(x[1] != x[0] and x[1] != w for w, x in want.items())


def test_chain_of_forms(spark):
    words = {"aaaaaaaa" + "b" * k: 5**k * 5 for k in range(1, 9)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert {r.root for r in variants.grouped(df).collect()} == {"aaaaaaaa" + "b" * 8}


def test_surviving_gram(monkeypatch):
    """After any edit one of the grams looked up is left, within half a word."""
    rng = random.Random(1)
    for _ in range(300):
        w = "".join(rng.choice("ab") for _ in range(rng.randrange(4, 25)))
        frequent = {w[p : p + q]: rng.randrange(100) for q in range(2, 8) for p in range(len(w)) if rng.random() < 0.6}
        grams = variants.looked_up(w, frequent)
        assert all(w[p : p + len(g)] == g and len(g) <= max(2, len(w) // 2) for p, g in grams)
        for place in range(len(w)):
            assert any(not p <= place < p + len(g) for p, g in grams)


def test_misspelt_and_awkward_rows(spark):
    assert sum(variants.misspelt(str(i), "garden") != "garden" for i in range(20_000)) == sum(zlib.crc32(f"{i}:garden".encode()) % 199 == 0 for i in range(20_000)) > 50
    rows = [("" if r[0] is None else r[0], r[1]) for r in hard_rows()]
    got = {r.word: r.n for r in variants.vocabulary(hard(spark)).collect()}
    assert got == plain_words(rows)
    assert found(variants.grouped(variants.vocabulary(hard(spark)))) == plain_groups(got)
    assert variants.grouped(variants.vocabulary(empty(spark))).count() == 0


def test_no_join_sends_the_vocabulary_through_the_driver(spark, monkeypatch):
    """Whatever Spark takes the lists of a small stored vocabulary for, and in every join of the operator."""
    plans = []

    def planned(df, name, store=variants.stored):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, name)

    monkeypatch.setattr(variants, "stored", planned)
    words = {"abcdefgh" + "i" * k: 5 ** (k + 1) for k in range(6)}
    out = variants.grouped(spark.createDataFrame(list(words.items()), "word string, n long"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert found(out) == plain_groups(words)
    assert sum(p.count("SortMergeJoin") for p in plans) >= 4 and not any("Broadcast" in p for p in plans)
