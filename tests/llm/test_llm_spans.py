"""Token spans against a plain version that knows nothing but decoded bytes of whole texts."""

import collections
import hashlib
import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from helpers import empty, hard, hard_rows  # noqa: E402

from ledgerlight.llm import queries, token_spans  # noqa: E402
from ledgerlight.llm.common import table  # noqa: E402

ODD = [
    None, "", " ", "  ", "\n", "x", " lead", "trail ", "a\n", "\na", "a  b", "a \n b", "a\n\nb", "a\tb c", "é", "ñandú à la carte\nÜber", "日本語 テキスト。\n日本", "🧿🧿 🧿", "👩‍👩‍👧 family",
    "a▁b", "▁", "tail ▁", "<|endoftext|> a </s> <s> <unk>", "<0x41> <0x0A>", "\x00 a", "a\r\nb", "a　b  c", "don't 'll 've", "=" * 5000, "x" * 3000 + " y", "á ë", "ﬁ ½ Å", "​ a", "123 4567 8,9",
]


@pytest.fixture(scope="module")
def own():
    with open(f"{token_spans.FOLDER}/{token_spans.FILE_A}", "rb") as a, open(f"{token_spans.FOLDER}/{token_spans.FILE_B}", "rb") as b:
        return token_spans.Aligner(a.read(), b.read())


def plain_groups(own, text):
    """Groups of the whole text: lists of A and B ids between common byte offsets."""
    if not text:
        return []
    data = (" " + text).encode()
    a, b = own.a.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text, out_type=int)
    if b"".join(own.bytes_a[i] for i in a) != data or b"".join(own.bytes_b[i] for i in b) != data:
        return []

    def ends(ids, table):
        at, out = 0, []
        for i in ids:
            at += len(table[i])
            out.append(at)
        return out

    ea, eb = ends(a, own.bytes_a), ends(b, own.bytes_b)
    groups, last = [], 0
    for cut in sorted(set(ea) & set(eb)):
        groups.append(([i for i, e in zip(a, ea) if last < e <= cut], [i for i, e in zip(b, eb) if last < e <= cut]))
        last = cut
    return groups


def plain(own, texts):
    groups = [plain_groups(own, t) for t in texts]
    links = [[(x, y) for ga, gb in g for x in ga for y in gb] for g in groups]
    count = collections.Counter(p for g in links for p in set(g))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for g, pairs in zip(groups, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        digest = hashlib.sha256(text.encode()).hexdigest() if g else ""
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(pairs), sum(count[p] == best[p[0]] for p in pairs), sum(count[p] for p in pairs), digest))
    return out


def values(r):
    return r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256


def by_id(rows):
    return sorted(((str(r[0]), *r[1:]) for r in rows), key=str)


def test_query_equals_plain(spark, small, own):
    rows = [(r.doc_id, r.text) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    got = queries()["op11_token_spans"](spark, small)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    # quadratic plain cuts: shorter documents, counts over all
    want = plain(own, [t for _, t in rows])
    assert by_id((r.doc_id, *values(r)) for r in got.collect()) == by_id((i, *w) for (i, _), w in zip(rows, want))


def test_odd_texts_and_a_small_head(spark, own, monkeypatch):
    monkeypatch.setattr(token_spans, "HEAD", 8)  # most links are then joined in a shuffle
    rng = random.Random(5)
    texts = ODD + [" ".join(rng.choice(ODD[5:]) for _ in range(12)) for _ in range(30)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    got = {r.doc_id: values(r) for r in token_spans.alignments(df).collect()}
    assert got == dict(enumerate(plain(own, texts)))
    assert sum(not g[0] for g in got.values()) < len(texts) / 2


def test_segments_are_remembered_within_bounds(own, monkeypatch):
    monkeypatch.setattr(token_spans, "REMEMBER", 20)
    texts = [f"word{i % 7} next{i % 11}\nline{i} é{i}" for i in range(60)]
    for k in range(0, 60, 10):
        for text, found in zip(texts[k : k + 10], own.rows(texts[k : k + 10])):
            a, b, n, names, pairs = found
            groups = plain_groups(own, text)
            assert (a, b, n) == (sum(len(x) for x, _ in groups), sum(len(x) for _, x in groups), len(groups))
            assert len(pairs) == sum(len(x) * len(y) for x, y in groups)
    assert len(own.memory) <= 20 + 60


def test_awkward_rows(spark, own):
    rows = hard_rows()
    got = token_spans.alignments(hard(spark)).collect()
    assert by_id((r.doc_id, *values(r)) for r in got) == by_id((r[0], *w) for r, w in zip(rows, plain(own, [r[1] for r in rows])))
    assert token_spans.alignments(empty(spark)).count() == 0


def test_more_ids_than_fit(monkeypatch, own):
    with open(f"{token_spans.FOLDER}/{token_spans.FILE_A}", "rb") as a, open(f"{token_spans.FOLDER}/{token_spans.FILE_B}", "rb") as b:
        files = a.read(), b.read()
    monkeypatch.setattr(token_spans, "LARGEST_ID", 1 << 15)
    with pytest.raises(ValueError, match="below"):
        token_spans.Aligner(*files)
