"""Small inputs with every awkward case, and plain versions of the contracts."""

from __future__ import annotations

import random
import re

SPACE = r"[^\x20\x09-\x0D]+"

FILLER = "river stone garden winter music letter window silver market bridge forest candle morning paper island story doctor kitchen summer hotel"


def prose(n: int, seed: int = 0) -> str:
    """n words of natural variety, ten to a line; another seed, another text."""
    rng, base = random.Random(seed), FILLER.split()
    words = [rng.choice(base) + rng.choice(("", "", "s", "ing", "ly", "ed", "er")) for _ in range(n)]
    return ".\n".join(" ".join(words[a : a + 10]).capitalize() for a in range(0, n, 10)) + "."


#: doc_id, text, lang, source, n_chars and columns that clash with results and temporary names
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, fingerprint string, token_ids string, shard string, _digest string, _h1 string, digest string, n long"


def hard_rows() -> list[tuple]:
    more = ("s", "k", "f", "t", "h", "d", "h", "g", 1)
    long = prose(3000, 3)
    texts = [
        (1, prose(120), "en"),
        (2, prose(120), "en"),
        (2, prose(120), "en"),
        (3, None, "en"),
        (4, "", None),
        (5, " \n\t \x0b", "de"),
        (6, long, "en"),
        (None, prose(90, 5), None),
        (None, None, None),
        (7, "one", "en"),
        (8, "=" * 400 + " ▁ x", "en"),
        (9, "Ünïcode — ñandú 𝄞 日本語 " * 30, "es"),
        (10, "A### b$$$ c%%% " * 60, "en"),
        (11, "12345 67890 !!! ???", "fr"),
    ]
    return [(i, t, lang, None if i == 1 else "src", None if t is None else len(t), *more) for i, t, lang in texts]


def hard(spark):
    return spark.createDataFrame(hard_rows(), COLUMNS)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def ascii_lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
