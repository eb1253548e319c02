"""Address rules and models against plain versions."""

import collections
import math
import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from helpers import empty, hard  # noqa: E402

from ledgerlight.llm import queries, url_model  # noqa: E402
from ledgerlight.llm.common import table  # noqa: E402
from ledgerlight.llm.registered.vocabularies import RULES  # noqa: E402

ODD = [
    None, "", "x", "no scheme/en/", "http://", "HTTP://A.Example.NET/en/x?y#z", "http://example.net/en/", "http://example.net/en", "http://net/", "http://net", "http://net?x/", "http://internet/a",
    "https://b.example.com/de/1#top", "https://EXAMPLE.com/de/1?a=http://x.net/", "https://example.com/en/?u=://net/", "http://a.org/fr/x", "http://a.org/fr", "http://É.org/fr/é", "http://İ.org/FR/", "://org/fr/", "a://b://net/",
    "http://user@x.net:80/en/", "http://x.net:80/", "http://a.net/\nb", "http://a\n.net/", "http://x.net/" + "a" * 5000, "http://.net/", "http://example.com/de/", "ftp://sub.example.com/de/é?#",
]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def plain_rule(host, path, rules):
    hit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(hit, key=lambda r: (len(r.host + r.path), len(r.host), r.verdict == "block"), default=None)


def plain_text(url, rules):
    if url is None or "://" not in url:
        return url
    host, path = plain_parts(url)
    rest = url.split("://", 1)[1]
    cut = max((len(r.host) for r in rules if host == r.host or host.endswith("." + r.host)), default=0)
    skip = max((len(r.path) for r in rules if path.startswith(r.path)), default=0)
    return host[: len(host) - cut] + rest[len(host) + skip :]


class PlainMarkov:
    def __init__(self, texts):
        self.grams = collections.Counter()
        for t in texts:
            data = b"\x02" + t.encode() + b"\x03"
            for i in range(1, len(data)):
                for k in range(6):
                    if i - k >= 0:
                        self.grams[data[i - k : i + 1]] += 1
        totals = collections.Counter()
        for g, n in self.grams.items():
            totals[len(g)] += n
        self.grams = {g: n for g, n in self.grams.items() if n * url_model.GRAMS >= totals[len(g)]}

    def chance(self, context, byte):
        after = {g[-1:]: n for g, n in self.grams.items() if g[:-1] == context}
        shorter = self.chance(context[1:], byte) if context else 1 / 256
        return (after.get(byte, 0) + len(after) * shorter) / (sum(after.values()) + len(after)) if after else shorter


def plain_score(a, r, text):
    data = b"\x02" + text.encode() + b"\x03"
    steps = [(data[max(0, i - 5) : i], data[i : i + 1]) for i in range(1, len(data))]
    return sum(math.log(a.chance(*s) / r.chance(*s)) for s in steps) / len(steps)


def test_query_rules_and_scores(spark, small):
    got = queries()["op12_url_ratio"](spark, small)
    assert got.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    rows = {r.page_id: r for r in got.collect()}
    urls = {r.page_id: r.url for r in table(spark, small, "pages").select("page_id", "url").collect()}
    assert rows.keys() == urls.keys()
    learned = {True: set(), False: set()}
    for i, url in urls.items():
        host, path = plain_parts(url)
        rule = plain_rule(host, path, RULES)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule and rule.host + rule.path)
        if rule:
            assert rows[i].verdict == rule.verdict
            learned[rule.verdict == "allow"].add(plain_text(url, RULES))
    a, r = PlainMarkov(learned[True]), PlainMarkov(learned[False])
    for i in sorted(urls)[:12]:
        assert rows[i].score == pytest.approx(plain_score(a, r, plain_text(urls[i], RULES)), abs=1e-9)
    free = [x for x in rows.values() if x.rule is None]
    allowed, blocked = ([x.score for x in free if x.verdict == v] for v in ("allow", "block"))
    assert min(allowed, default=9) >= max(blocked, default=-9)


def test_odd_addresses(spark):
    rules = [*RULES, url_model.Rule.parse("net/en/", "allow"), url_model.Rule("É.org", "", "block")]
    df = spark.createDataFrame([(u, "h", "v", 1.0) for u in ODD], "url string, host string, verdict string, _text double")
    got = url_model.judged(df, rules)
    assert got.columns == ["url", "_text", "host", "path", "rule", "verdict", "score"]
    for r in got.collect():
        host, path = plain_parts(r.url)
        rule = plain_rule(host, path, rules)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.host + rule.path), r.url
        assert r.verdict == rule.verdict if rule else r.verdict in ("allow", "block")
        if not r.url:
            assert r.verdict == "block"


def test_models_tell_a_word_in_the_address(spark):
    rows = [(f"http://{name}{i}.{top}{part if top == 'net' else ''}/{i}", good) for i in range(60) for name, part, good in (("garden", "/en", True), ("casino", "", False)) for top in ("net", "info")]
    rules = [url_model.Rule("net", "/en/", "allow"), url_model.Rule("net", "/", "block"), url_model.Rule("info", "/x/0/", "block")]
    got = url_model.judged(spark.createDataFrame(rows, "url string, good boolean"), rules)
    assert got.filter("rule is null").count() == 120
    assert got.filter("(verdict = 'allow') <> good").count() == 0


def test_gram_bound(spark, monkeypatch):
    monkeypatch.setattr(url_model, "GRAMS", 20)
    rows = spark.createDataFrame([(f"text {i} {i * i}", i % 2 == 0, False) for i in range(300)], "text string, accepted boolean, held boolean")
    ratio = url_model.Ratio.gather(url_model.learn(rows))
    for model in (ratio.accepted, ratio.rejected):
        assert max(collections.Counter(map(len, model.grams)).values()) <= 20
        for context in [b"", b"x", b"te", b"\x02tex"]:
            assert sum(model.chance(context + bytes([c])) for c in range(256)) == pytest.approx(1)


@pytest.mark.parametrize("whole", [url_model.WHOLE, 10])
def test_every_gram_counts(spark, monkeypatch, whole):
    """However rare a gram is, and whether the grams fit the tasks or are joined."""
    monkeypatch.setattr(url_model, "WHOLE", whole)
    monkeypatch.setattr(url_model, "BLOCK_TEXTS", 7)
    urls = [f"http://{'x' * (i % 3)}h{i * i}.{top}/{part}/{i}" for i in range(40) for top, part in (("net", "en"), ("net", "fr"), ("org", "fr"))] + ["", "é", None, "http://a.gov/ü"] * 2
    a, r = (PlainMarkov(sorted({plain_text(u, RULES) for u in urls if u and (rule := plain_rule(*plain_parts(u), RULES)) and rule.verdict == v})) for v in ("allow", "block"))
    monkeypatch.setattr(url_model, "GRAMS", 4)  # bounds nothing here
    got = url_model.judged(spark.createDataFrame([(i, u, "t") for i, u in enumerate(urls)], "page_id long, url string, text string"), RULES).collect()
    assert sorted(x.page_id for x in got) == list(range(len(urls)))
    for x in got[::5] + got[-8:]:
        assert x.url == urls[x.page_id] and x.text == "t"
        assert x.score is None if x.url is None else x.score == pytest.approx(plain_score(a, r, plain_text(x.url, RULES)), abs=1e-9)


def test_nothing_to_learn_from(spark):
    one_side = spark.createDataFrame([("http://a.net/x",), ("http://b.com/y",), (None,)], "url string")
    assert {r.url: r.verdict for r in url_model.judged(one_side, RULES).collect()}["http://a.net/x"] == "block"
    free = url_model.judged(spark.createDataFrame([("http://a.gov/x",), ("",)], "url string"), RULES)
    assert {r.url: (r.verdict, r.score) for r in free.collect()} == {"http://a.gov/x": ("allow", 0.0), "": ("block", 0.0)}
    assert url_model.judged(hard(spark).withColumnRenamed("text", "url"), RULES).count() == hard(spark).count()
    assert url_model.judged(empty(spark), RULES, "text").count() == 0
    with pytest.raises(ValueError, match="rules"):
        url_model.ordered([url_model.Rule(f"h{i}", "/", "block") for i in range(url_model.MOST_RULES + 1)])
