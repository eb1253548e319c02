"""Whole operators against plain Python versions: op5 (entities, surrogates, texts) and op10 (n-grams, EM, sets)."""

import hashlib
import math
import os
import random
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_llm_documents import FORMS  # noqa: E402

from ledgerlight.llm import langid  # noqa: E402
from ledgerlight.llm import surrogates as S  # noqa: E402
from ledgerlight.llm.common import table  # noqa: E402

# ---- op5: the patterns are shared, all else is written anew

MATCH = regex.compile(S.PATTERN)


def plain_kind(m):
    if m.startswith("=") or (regex.search("^" + S._KEYED, m) and regex.search("[:=]", m)) or regex.fullmatch("A[KS]IA[0-9A-Z]{16}", m):
        return "secret"
    if "@" in m:
        return "email"
    if regex.match(rf"(?:{S._TITLE})\.? ", m):
        return "name"
    if ":" in m:
        return "ip6"
    if m[0] in "+(" or regex.fullmatch(r"[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}", m):
        return "phone"
    for pattern, found in ((r"[0-9]+(?:\.[0-9]+){3}", "ip"), ("[0-9]{3}-[0-9]{2}-[0-9]{4}", "ssn"), ("[0-9 -]+", "card")):
        if regex.fullmatch(pattern, m):
            return found
    return "account"


def plain_luhn(digits):
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(digits))))


def inner(m):
    return regex.search('"([^"]+)"', m)[1] if m.startswith("=") else regex.search("([0-9A-Za-z+/_-]+)[\"']?$", m)[1]


def plain_entities(m):
    """[(type, canon)] of a mention."""
    found, digits = plain_kind(m), regex.sub("[^0-9]", "", m)
    if found == "email":
        return [("email", m.lower()), ("host", m.rsplit("@", 1)[1].lower())]
    if found == "name":
        title, *names = m.split(" ")
        title = title.rstrip(".")
        given = "given_f" if title in S.TITLES_F else "given_n" if title in S.TITLES_N else "given_m"
        return [(given, names[0].lower()), ("surname", names[1].lower())] if len(names) == 2 else [("surname", names[0].lower())]
    if found == "phone":
        own = regex.match(r"\+([0-9]{1,3})[^0-9]", m) or regex.match(r"\+([0-9]{2})", m)
        code = own[1] if own else ""
        return [("phone", code + "|" + digits[len(code) :])]
    if found == "card":
        usual = regex.fullmatch("[0-9]{4}(?:[ -]?[0-9]{4}){3}", m) or regex.match("3[47]", m)
        return [("card", digits)] if usual or plain_luhn(digits) % 10 == 0 else []
    if found == "secret":
        return [("secret", inner(m).lower() if regex.fullmatch("[0-9a-f]+|[0-9A-F]+", inner(m)) else inner(m))]
    return [(found, {"ip6": m.lower(), "ssn": digits, "account": m.replace(" ", ""), "ip": m}[found])]


def byte(h, i):
    at = i * 2 % 126
    return int(h[at : at + 2], 16)


def letters(text, h, hexadecimal=False):
    out = []
    for i, c in enumerate(text):
        low, b = c.lower(), byte(h, i)
        alphabets = (("[0-9]", "0123456789"), ("[a-z]", "abcdef" if hexadecimal else S.LATIN), ("[à-öø-ÿ]", S.ACCENTED), ("[α-ω]", S.GREEK), ("[а-я]", S.CYRILLIC), (r"\p{L}", S.LATIN), (r"\p{N}", "0123456789"))
        new = next((a[b % len(a)] for p, a in alphabets if regex.fullmatch(p, low)), c)
        out.append(new if c == low else new.upper())
    return "".join(out)


def sha(text):
    return hashlib.sha512(text.encode()).hexdigest()


def plain_surrogate(kind, canon, attempt, key):
    h = sha(key + "\x1e" + sha(key + "\x1f" + "\x1f".join((kind, canon, str(attempt)))))
    grown = attempt // S.GROW
    more = "".join(chr(ord("g") + int(c)) if c.isdigit() else c for c in h)[99 : 99 + grown]
    ends = {"given_f": ("na", "на"), "given_m": ("n", "н"), "given_n": ("s", "с"), "surname": ("r", "р")}
    if kind in ends:
        cyrillic = bool(regex.search("[а-яё]", canon))
        pool = S.SYLLABLES_CYRILLIC if cyrillic else S.SYLLABLES_LATIN
        n = max(2, min(4, math.ceil(len(canon) / 2))) + grown
        return "".join(pool[byte(h, i) % len(pool)] for i in range(1, n + 1)) + ends[kind][cyrillic]
    if kind == "email":
        return letters(canon.split("@")[0], h) + more
    if kind == "host":
        labels = canon.split(".")
        below = ".".join(letters(x, sha(h + str(i))) for i, x in enumerate(labels[: max(len(labels) - 2, 1)]))
        return f"{more}{below}.example.{('com', 'net', 'org')[byte(h, 60) % 3]}"
    if kind == "ip":
        return ".".join(str(byte(h, i) % 223 + 1) for i in range(4))
    if kind == "phone":
        code, rest = canon.split("|")
        return code + "|" + letters(rest, h)
    if kind == "card":
        new = canon[0] + letters(canon, h)[1:]
        return new if plain_luhn(canon) % 10 else new[:-1] + str(-plain_luhn(new[:-1] + "0") % 10)
    if kind == "account":
        return canon[:2] + letters(canon, h)[2:]
    return letters(canon, h, kind == "ip6" or bool(regex.fullmatch("[0-9a-f]+", canon)))


def plain_table(entities, key):
    attempts = dict.fromkeys(entities, 0)
    real = {e for e in entities if e[0] != "email"}
    while True:
        made = {e: plain_surrogate(*e, n, key) for e, n in attempts.items()}
        sharing = defaultdict(list)
        for (kind, canon), new in made.items():
            sharing[kind, canon.rsplit("@", 1)[-1] if kind == "email" else "", new].append((attempts[kind, canon], canon))
        again = {(k[0], canon) for k, members in sharing.items() for _, canon in sorted(members)[1:]}
        again |= {e for e, new in made.items() if (e[0], new) in real}
        if not again:
            return made
        for e in again:
            attempts[e] += 1


def fill(m, chars):
    chars = iter(chars)
    return "".join(next(chars) if regex.fullmatch(r"[\p{L}\p{N}]", c) else c for c in m)


def plain_written(m, new):
    found = plain_kind(m)
    if found == "name":
        return " ".join([m.split(" ")[0], *[x.capitalize() for x in new]])
    if found == "email":
        return "@".join(new).upper() if m == m.upper() and m != m.lower() else "@".join(new)
    if found == "secret":
        own = inner(m)
        at, made = m.rindex(own), new[0]
        return m[:at] + (made.upper() if own == own.upper() and own != own.lower() else made) + m[at + len(own) :]
    if found in ("phone", "card", "ssn", "account"):
        return fill(m, new[0].replace("|", ""))
    return new[0]


def plain_replaced(texts, key):
    """{id: (text, replaced mentions)}."""
    found = {i: [x[0] for x in MATCH.finditer(t)] for i, t in texts.items()}
    made = plain_table({e for ms in found.values() for m in ms for e in plain_entities(m)}, key)
    out = {}
    for i, text in texts.items():
        new = [plain_written(m, [made[e] for e in plain_entities(m)]) if plain_entities(m) else m for m in found[i]]
        names = [(m.split(" ", 1)[1], n.split(" ", 1)[1]) for m, n in zip(found[i], new) if plain_kind(m) == "name"]
        names = [x for x in names if " " in x[0]] + [(m.split(" ")[-1], n.split(" ")[-1]) for m, n in names]
        gaps, at = [], 0
        for m in MATCH.finditer(text):
            gaps.append(text[at : m.start()])
            at = m.end()
        gaps.append(text[at:])
        for known, put in dict.fromkeys(names):
            gaps = [regex.sub(rf"(?<!\p{{L}}){known}(?!\p{{L}})", put, g) for g in gaps]
        out[i] = "".join(g + n for g, n in zip(gaps, [*new, ""])), sum(bool(plain_entities(m)) for m in found[i])
    return out


MIXED = [
    "John Smith wrote. Mr. John Smith met Mrs. Anna O'Neil; then Smith left O'Neil, and Smithson and John stayed.",
    "Г-жа Анна Иванова и Г-н Иванов: Иванова, МАША@ПОЧТА.ORG, ñé.x@correo.es, UND.34@MAIL7.EXAMPLE.COM und.34@mail7.example.com",
    'password: "hunter2hunter2xx" api_key=abcdef0123456789abcd token = "04DBEBAB91AB85687D33EEAAF9AC699E1188F962" Dr Who Prof. Who',
    "cards 4111 1111 1111 1111 and 4111111111111112 and 1234567890123 and 4222222222222, none 12:30:45, 2024-01-05",
    "".join(f"{c}@{d}{e}.org " for c in "abcd" for d in "abcdefgh" for e in "ab"),
]


def test_op5_equals_the_plain_version(spark, small):
    docs = table(spark, small, "documents").select("doc_id", "text")
    more = spark.createDataFrame([(-1 - i, f"x {t} y") for i, t in enumerate(FORMS + MIXED)], docs.schema)
    both = docs.unionByName(more)
    texts = {r.doc_id: r.text for r in both.collect()}
    assert len(texts) == both.count()
    got = {r.doc_id: (r.text, r.n) for r in S.replaced(both, "a key", count="n").collect()}
    want = plain_replaced({i: t for i, t in texts.items() if t is not None}, "a key")
    assert sum(n > 0 for _, n in want.values()) > len(FORMS)
    for i, text in texts.items():
        assert got[i] == (want[i] if text is not None else (None, 0)), text


# ---- op10: exact n-grams of each word, EM in plain loops to a tolerance


def grams(word):
    data = b"\x02" + word.encode() + b"\x03"
    for at in range(1, len(data)):
        before = data[max(0, at - 2) : at]
        one = before[-1] if at > 1 else 3
        two = before[0] if at > 2 else 3
        yield data[at], (one, data[at]), (two, one, data[at])


class Plain:
    def __init__(self, rows):
        self.langs = sorted({lang for lang, _ in rows})
        self.counts = {x: [Counter(), Counter(), Counter()] for x in self.langs}
        for lang, text in rows:
            for word, n in Counter(langid.words_of(text)).items():
                for found in grams(word):
                    for counter, gram in zip(self.counts[lang], found):
                        counter[gram] += n
        self.sums = {x: sum(c[0].values()) for x, c in self.counts.items()}
        self.memory = {}

    def word(self, w):
        if w not in self.memory:
            cells = langid.BUCKETS
            out = []
            for x in self.langs:
                total = max(self.sums[x], 1) + 0.5 * cells
                p = [[(c[g] + 0.5) / total for c, g in zip(self.counts[x], found)] for found in grams(w)]
                out.append(sum(math.log(0.6 * t + 0.3 * b / cells**0.5 + 0.1 * u / cells) for u, b, t in p))
            self.memory[w] = [math.exp(max(v - max(out), -langid.CLIP)) for v in out]
        return self.memory[w]

    def em(self, words, use):
        share = [1 / len(use) if i in use else 0.0 for i in range(len(self.langs))]
        for _ in range(1000):
            new = [0.0] * len(share)
            for w, n in words.items():
                part = [a * b for a, b in zip(self.word(w), share)]
                total = sum(part)
                new = [x + n * y / total for x, y in zip(new, part)]
            new = [x / sum(new) for x in new]
            moved, share = max(abs(a - b) for a, b in zip(new, share)), new
            if moved < 1e-9:
                break
        return share, sum(n * math.log(sum(a * b for a, b in zip(self.word(w), share))) for w, n in words.items())

    def predict(self, text):
        words = Counter(langid.words_of(text))
        if not words:
            return langid.UND, {}
        cost = langid.PENALTY * math.log(sum(words.values()) + 1)
        use = set(range(len(self.langs)))
        share, ll = self.em(words, use)
        while len(use) > 1:
            less = use - {min(use, key=lambda i: (share[i], -i))}
            share2, ll2 = self.em(words, less)
            if ll2 + cost < ll:
                break
            use, share, ll = less, share2, ll2
        return self.langs[max(use, key=lambda i: (share[i], -i))], {self.langs[i]: share[i] for i in use}


@pytest.fixture(scope="module")
def learned(spark, small):
    rows = [(r.lang, r.text) for r in table(spark, small, "documents").select("lang", "text").collect() if r.lang and r.text]
    frame = spark.createDataFrame(rows, "lang string, text string")
    return Plain(rows), langid.Model.gather(langid.learn(frame)), rows


def mixed_texts(rows, parts, n=12, words=150):
    """Texts made of equally many words of some languages, each with its languages."""
    rng = random.Random(parts)
    pool = defaultdict(list)
    for lang, text in rows:
        pool[lang] += langid.words_of(text)
    for _ in range(n):
        chosen = rng.sample(sorted(pool), parts)
        starts = [rng.randrange(len(pool[x]) - words) for x in chosen]
        yield chosen, " ".join(w for x, a in zip(chosen, starts) for w in pool[x][a : a + words])


def test_op10_equals_a_plain_em(learned):
    """Hashed cells and few rounds change no language and hardly a share."""
    plain, model, rows = learned
    texts = [t for _, t in rows] + [t for k in (2, 3) for _, t in mixed_texts(rows, k)] + ["", "123", "猫"]
    got = model.predict(texts)
    want = [plain.predict(t) for t in texts]
    agree = [a[0] == b[0] for a, b in zip(got, want)]
    assert sum(agree) >= 0.98 * len(texts) and got[-3][0] == got[-2][0] == langid.UND
    away = [abs(a[1] - b[1].get(a[0], 0.0)) for a, b in zip(got, want)]
    assert np.mean(away) < 0.01 and np.quantile(away, 0.95) < 0.05


@pytest.mark.parametrize("parts", [2, 3, 4])
def test_op10_shares_of_equal_parts(learned, parts):
    _, model, rows = learned
    away, sets = [], 0
    for chosen, text in mixed_texts(rows, parts):
        [(_, _, found, shares)] = model.predict([text])
        sets += set(found) == set(chosen)
        away += [abs(dict(zip(found, shares)).get(x, 0.0) - 1 / parts) for x in chosen]
    assert np.mean(away) < 0.03 and sets >= 11
