"""Quality rules by labelling the line sequence of a text.

A linear-chain conditional random field with two labels reads each line with a word as bins of a
few measurements (length, symbols, capitals, digits, repetition, punctuation). Viterbi decoding
marks lines as content or boilerplate; a text is kept if it passes the base rule and at least
`SHARE` of its words stand in content lines.

The field is trained on at most `SAMPLE` labelled documents of together at most `LINES` lines, those
with the smallest hash of their id. Their labels are weak: line labels are latent and summed out, so
a document may hold both kinds. Sequences are cut at `CUT` lines for training only; decoding runs
over whole texts. Where the labels lack a class, `untrained` weights are used.

Null and wordless texts have zero counts, no content and fail the base rule. Extra columns stay;
result columns replace input columns of their names. Repeated rows are assessed alike. Repeated
labels of one document count once, the lower quality.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 4000
CUT = 64
SHARE = 0.5
#: Nats by which a document's label speaks for each of its lines, and the prior of transitions (a penalty).
TILT, STAY = 2.0, 1.0
#: Lines that training holds at most.
LINES = 200_000
MIN_WORDS = 50
MAX_REPEAT = 50

SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\v\f\r"
_END = frozenset(b".!?:;\"')")

# bins of each measurement: upper bounds, a value falls into the first bin it does not exceed
BINS = {
    "words": (1, 2, 4, 8),
    "symbols": (0.0, 0.01, 0.03, 0.08, 0.15),
    "capitals": (0.02, 0.1, 0.3, 0.6, 0.9),
    "digits": (0.0, 0.05, 0.2, 0.5),
    "bangs": (0.0, 0.01, 0.05),
    "bars": (0.0, 0.02, 0.05),
    "new_pairs": (0.0, 0.1, 0.3, 0.5, 0.7, 0.9),
    "word_size": (2, 3, 4, 5, 7, 10, 15),
    "again": (0.0,),
    "ends": (0.0,),
}
WIDTH = max(len(b) for b in BINS.values()) + 1


def _class_table() -> np.ndarray:
    """0 other, 1 symbol, 2 capital, 3 small letter or beyond ASCII, 4 digit, 5 exclamation mark, 6 bar, 7 space."""
    out = np.zeros(256, dtype=np.uint8)
    out[[ord(c) for c in SYMBOLS]] = 1
    out[65:91], out[97:123], out[128:], out[48:58] = 2, 3, 3, 4
    out[ord("!")], out[ord("|")] = 5, 6
    out[[ord(c) for c in _SPACES]] = 7
    return out


_CLASS = _class_table()


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    m = len(number)
    pairs = ids[:-1] * m + ids[1:]
    if m > 1 << 20:  # three numbers would not fit in 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    wins = pairs[:-1] * m + ids[2:]
    order = np.argsort(wins, kind="stable")
    ranked = wins[order]
    same = ranked[1:] == ranked[:-1]
    often = np.zeros(len(wins), dtype=bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    hit = np.zeros(len(words), dtype=bool)
    for k in range(3):
        hit[k : k + len(often)] |= often
    return int(hit.sum())


def base_counts(text: str | None, words: list[bytes], lines: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; `lines` are those with a word."""
    if not words:
        return 0, 0, 0 if text is None else sum(map(text.count, SYMBOLS)), 0, 0
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def split_lines(text: str | None) -> tuple[list[bytes], list[list[bytes]], list[int]]:
    """Lines with a word, their words, and their places among all lines."""
    every = text.encode().split(b"\n") if text else []
    words = [x.split() for x in every]
    at = [i for i, w in enumerate(words) if w]
    return [every[i] for i in at], [words[i] for i in at], at


def measured(lines: list[bytes], words: list[list[bytes]], again: list[bool]) -> np.ndarray:
    """Bins of every line: lines x measurements."""
    out = np.zeros((len(lines), len(BINS)), dtype=np.uint8)
    if not lines:
        return out
    sizes = np.array([len(x) for x in lines])
    codes = _CLASS[np.frombuffer(b"".join(lines), dtype=np.uint8)]
    starts = np.cumsum(sizes) - sizes
    count = [np.add.reduceat((codes == k).astype(np.int32), starts) for k in range(8)]
    solid = np.maximum(sizes - count[7], 1)
    letters = np.maximum(count[2] + count[3], 1)
    n = np.array([len(w) for w in words])
    values = {
        "words": n,
        "symbols": (count[1] + count[6]) / solid,
        "capitals": count[2] / letters,
        "digits": count[4] / solid,
        "bangs": count[5] / solid,
        "bars": count[6] / solid,
        "new_pairs": np.array([len(set(itertools.pairwise(w))) for w in words]) / np.maximum(n - 1, 1),
        "word_size": solid / n,
        "again": np.array(again, dtype=float),
        "ends": np.array([w[-1][-1] in _END for w in words], dtype=float),
    }
    for k, (name, bounds) in enumerate(BINS.items()):
        out[:, k] = np.searchsorted(bounds, values[name])
    return out


class Field:
    """Weights: emission[measurement, bin] for content against boilerplate, and transitions."""

    def __init__(self, emission: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.emission, self.move, self.start = emission, move, start

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return self.emission[np.arange(len(BINS)), bins].sum(axis=1)

    def decode(self, bins: np.ndarray) -> np.ndarray:
        """Viterbi: True for content. Ties go to content."""
        n = len(bins)
        content = np.zeros(n, dtype=bool)
        if not n:
            return content
        e = self.scores(bins).tolist()
        (bb, bc), (cb, cc) = self.move.tolist()
        b, c = self.start[0], self.start[1] + e[0]
        back: list[tuple[bool, bool]] = []
        for x in e[1:]:
            from_b, from_c = b + bb > c + cb, b + bc > c + cc
            back.append((from_b, from_c))
            b, c = (b + bb if from_b else c + cb), (b + bc if from_c else c + cc) + x
        now = c >= b
        content[n - 1] = now
        for i in range(n - 2, -1, -1):
            now = not back[i][1 if now else 0]
            content[i] = now
        return content


def untrained() -> Field:
    """Weights for corpora without labels: content unless symbols, bars, capitals or repetition abound."""
    emission = np.zeros((len(BINS), WIDTH))
    names = list(BINS)
    for name, first in (("symbols", 3), ("bars", 2), ("capitals", 4), ("bangs", 2)):
        emission[names.index(name), first:] = -4.0
    emission[names.index("new_pairs"), 1:3] = -4.0
    emission[names.index("words")] = 0.5
    return Field(emission, np.array([[0.5, -0.5], [-0.5, 0.5]]), np.zeros(2))


class Chains:
    """Padded sequences, and expectations of a field's features over their labellings."""

    def __init__(self, bins: list[np.ndarray]):
        steps = max(map(len, bins))
        which = np.zeros((len(bins), steps, len(BINS)), dtype=np.int64)
        self.there = np.zeros((len(bins), steps), dtype=bool)
        for k, x in enumerate(bins):
            which[k, : len(x)], self.there[k, : len(x)] = x, True
        self.column = which + np.arange(len(BINS)) * WIDTH
        self.size = len(BINS) * WIDTH

    def expect(self, theta: np.ndarray, tilt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Log-partition, chance of content per line, pairs of labels (2 x 2) and first labels of each
        sequence; `tilt` is added to the score of content on every line of a sequence."""
        move, start, there = theta[self.size : self.size + 4].reshape(2, 2), theta[self.size + 4 :], self.there
        emit = np.zeros((*there.shape, 2))
        emit[:, :, 1] = theta[: self.size][self.column].sum(axis=2) + tilt[:, None]
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        forward[:, 0] = start + emit[:, 0]
        for i in range(1, there.shape[1]):
            got = np.logaddexp(forward[:, i - 1, 0, None] + move[0], forward[:, i - 1, 1, None] + move[1]) + emit[:, i]
            forward[:, i] = np.where(there[:, i, None], got, forward[:, i - 1])
        for i in range(there.shape[1] - 2, -1, -1):
            ahead = emit[:, i + 1] + backward[:, i + 1]
            got = np.logaddexp(move[:, 0] + ahead[:, 0, None], move[:, 1] + ahead[:, 1, None])
            backward[:, i] = np.where(there[:, i + 1, None], got, 0.0)
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        chance = np.exp(np.minimum(forward + backward - total[:, None, None], 0.0)) * there[:, :, None]
        pairs = np.zeros((len(there), 2, 2))
        for a in range(2):
            for b in range(2):
                joint = forward[:, :-1, a] + move[a, b] + emit[:, 1:, b] + backward[:, 1:, b] - total[:, None]
                pairs[:, a, b] = (np.exp(np.minimum(joint, 0.0)) * there[:, 1:]).sum(axis=1)
        return total, chance[:, :, 1], pairs, chance[:, 0]

    def slope(self, theta: np.ndarray, tilt: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
        """Weighted log-likelihood of the documents' labels, line labels summed out, and its gradient."""
        told, free = self.expect(theta, tilt), self.expect(theta, np.zeros_like(tilt))
        grad = np.zeros_like(theta)
        diff = weight[:, None] * (told[1] - free[1])
        grad[: self.size] = np.bincount(self.column.ravel(), weights=np.repeat(diff.ravel(), len(BINS)), minlength=self.size)
        grad[self.size : self.size + 4] = (weight[:, None, None] * (told[2] - free[2])).sum(axis=0).ravel()
        grad[self.size + 4 :] = (weight[:, None] * (told[3] - free[3])).sum(axis=0)
        return float((weight * (told[0] - free[0])).sum()), grad


def train(bins: list[np.ndarray], good: list[bool], rounds: int = 150, rate: float = 0.1, penalty: float = 1e-3) -> Field:
    """Maximum likelihood of the documents' labels by gradient steps (Adam) over padded sequences.

    Line labels are latent: a label of a document only makes each of its lines likelier content, or
    boilerplate, by `TILT`. Transitions have a prior of their own, `STAY`, because documents that are
    labelled as a whole say little about changes inside them.
    """
    if not (any(good) and not all(good)):
        return untrained()
    parts = [(x[a : a + CUT], y) for x, y in zip(bins, good, strict=True) for a in range(0, len(x), CUT)]
    chains = Chains([x for x, _ in parts])
    # both classes weigh the same, so that rare bad documents are learned as well
    weight = np.array([0.5 / sum(good) if y else 0.5 / (len(good) - sum(good)) for _, y in parts])
    tilt = np.array([TILT if y else -TILT for _, y in parts])
    theta = np.zeros(chains.size + 6)
    cost = np.full_like(theta, penalty)
    cost[chains.size : chains.size + 4] = STAY
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        grad = chains.slope(theta, tilt, weight)[1] - cost * theta
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        theta = theta + rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    return Field(theta[: chains.size].reshape(len(BINS), WIDTH), theta[chains.size : chains.size + 4].reshape(2, 2), theta[chains.size + 4 :])


def _again(lines: list[bytes]) -> list[bool]:
    seen: set[bytes] = set()
    return [x in seen or bool(seen.add(x)) for x in lines]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> Field:
    """Train on at most `sample` labelled documents; only their lines' bins come to the driver."""
    marked = labels.filter(F.col(doc_id).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.min(quality).alias("_good"))
    some = marked.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    picked = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text")).join(F.broadcast(some), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.min("_good").alias("_good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column(1):
                lines, words, _ = split_lines(t.as_py())
                found.append(measured(lines, words, _again(lines)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2).cast(pa.int32())], names=["id", "bins", "good"])

    kind = picked.schema["_id"].dataType.simpleString()
    measured_ = picked.mapInArrow(run, f"id {kind}, bins binary, good int")
    # numbers of lines first, so that no more than LINES come to the driver
    order = measured_.select("id", F.floor(F.length("bins") / len(BINS)).alias("n"), F.xxhash64("id").alias("h")).filter("n > 0").orderBy("h", "id").collect()
    total = np.cumsum([r["n"] for r in order])
    chosen = [r["id"] for r, n in zip(order, total, strict=True) if n <= LINES]
    rows = measured_.filter(F.col("id").isin(chosen)).orderBy("id").toArrow()
    bins = [np.frombuffer(x, dtype=np.uint8).reshape(-1, len(BINS)) for x in rows.column("bins").to_pylist()]
    return train(bins, [x > 0 for x in rows.column("good").to_pylist()])


def assess(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """Add the base counts, base_failed, line_content (per line, null without words), content_words, kept."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(field)
    long, flag = T.LongType(), T.BooleanType()
    made = [(c, long) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    made += [("base_failed", flag), ("line_content", T.ArrayType(flag)), ("content_words", long), ("kept", flag)]
    names = [c for c, _ in made]
    kept = docs.drop(*names)
    where = kept.columns.index(text)
    schema = T.StructType([*kept.schema.fields, *(T.StructField(c, t) for c, t in made)])
    kinds = [*[pa.int64()] * 5, pa.bool_(), pa.list_(pa.bool_()), pa.int64(), pa.bool_()]

    def one(t: str | None, own: Field) -> tuple:
        lines, words, at = split_lines(t)
        every = [w for x in words for w in x]
        counts = base_counts(t, every, lines)
        failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT * counts[0]
        content = own.decode(measured(lines, words, _again(lines)))
        n = int(sum(len(w) for w, c in zip(words, content, strict=True) if c))
        marks: list[bool | None] = [None] * (t.count("\n") + 1 if t else 0)
        for i, c in zip(at, content.tolist(), strict=True):
            marks[i] = c
        return (*counts, failed, marks, n, not failed and n >= SHARE * counts[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            found = [one(t.as_py(), own) for t in batch.column(where)]
            cols = [pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *names])

    return kept.mapInArrow(run, schema)


def content_text(assessed: DataFrame, text: str = "text", out: str = "content") -> DataFrame:
    """The lines marked as content, joined again."""
    lines = F.split(F.col(text), "\n", -1)
    return assessed.withColumn(out, F.array_join(F.transform(F.filter(F.arrays_zip(lines.alias("l"), F.col("line_content").alias("c")), lambda x: x["c"]), lambda x: x["l"]), "\n"))
