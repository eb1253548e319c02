"""Spelling variants: words one edit apart, by an index of variable-length grams.

Words are counted over all texts; tasks sum their counts before the shuffle. The gram dictionary is
a tree over the vocabulary's grams, pruned by frequency: every gram of `SHORT` = 2 code points is in
it, and a longer one (up to `LONG`) is if the gram before its last code point is frequent, that is,
occurs more than `FREQUENT` times and has more than 1/`DICTIONARY` of all positions. So only the
frequent grams are needed to know the dictionary, at most `DICTIONARY` of each length, and these
are sent to the tasks.

A word is decomposed into the longest dictionary gram at every position, at most half a word long,
without those that lie inside another. One edit affects only grams that cover its place. The grams
are taken from the rarest on until there are more of them than the most that cover any one place
(their bound): at least one survives every edit, so the word need only be looked up in their lists.
Half a word is the longest gram, so the first and the last gram never overlap and the bound holds
for every word of four code points or more. Lists are merged in a join: each of those grams, under
the lengths and places it can have after one edit, meets all dictionary grams of the other words,
and every pair is verified by its edit distance. Of two words of different length the shorter one
is looked up, so pairs are found at most twice.

A word's form is its near word of largest count (ties: the smallest in code-point order) if that is
`TIMES` = 5 times the word's or more; forms are followed by pointer jumping in rounds of joins.

Joins whose sides grow with the vocabulary are merge joins by hint: Spark takes lists of many keys a
word, and packed words, for as small as the stored vocabulary, and would send them through the driver.

Null texts have no words; null ids count as empty in `misspelt`; repeated rows count again. Very
long texts are counted like any other. Extra columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import stored

SHORT, LONG = 2, 8
FREQUENT = 64
DICTIONARY = 1 << 15
LEAST_LENGTH, LEAST_COUNT = 6, 5
TIMES = 5
EVERY = 199
#: Distinct words or grams a task sums before it hands them on.
TOGETHER = 300_000

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def misspelt(doc_id: str, run: str, every: int = EVERY) -> str:
    """The run without a code point where its checksum in this document says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _flushed(counter: Counter, name: str) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([pa.array(list(counter), pa.string()), pa.array(list(counter.values()), pa.int64())], names=[name, "n"])
    counter.clear()
    return out


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = EVERY, length: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """word, n: words of at least `length` code points with at least `count` occurrences in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in Counter(_RUN.findall((t.as_py() or "").translate(_LOWER))).items():
                    word = misspelt(i, word, every)
                    if len(word) >= length:
                        sums[word] += n
                if len(sums) > TOGETHER:
                    yield _flushed(sums, "word")
        yield _flushed(sums, "word")

    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), F.col(f"`{text}`").cast("string")).toDF("i", "t").filter("t is not null")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= count)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, n: all grams that may be extended."""
    sums: Counter = Counter()
    for batch in batches:
        for w in batch.column(0).to_pylist():
            sums.update(w[p : p + q] for q in range(SHORT, LONG) for p in range(len(w) - q + 1))
            if len(sums) > TOGETHER:
                yield _flushed(sums, "gram")
    yield _flushed(sums, "gram")


def frequent_grams(words: DataFrame) -> dict[str, int]:
    """Grams that are extended, with their counts: at most DICTIONARY of each length."""
    positions = words.agg(F.sum(F.length("word"))).first()[0] or 0
    most = max(FREQUENT, positions // DICTIONARY)
    found = words.select("word").mapInArrow(_grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") > most)
    return {r["gram"]: r["n"] for r in found.collect()}


def decomposed(word: str, frequent: dict[str, int]) -> list[tuple[int, str]]:
    """Place and gram of the word's variable-length grams."""
    half, out, end = max(SHORT, min(LONG, len(word) // 2)), [], 0
    for p in range(len(word) - SHORT + 1):
        q = SHORT
        while q < half and p + q < len(word) and word[p : p + q] in frequent:
            q += 1
        if p + q > end:
            out.append((p, word[p : p + q]))
            end = p + q
    return out


def looked_up(word: str, frequent: dict[str, int]) -> list[tuple[int, str]]:
    """The rarest grams up to the first number of which no single place is covered by all of them."""
    covered, out = [0] * len(word), []
    for p, gram in sorted(decomposed(word, frequent), key=lambda x: (frequent.get(x[1], 0), -len(x[1]), x)):
        out.append((p, gram))
        for k in range(p, p + len(gram)):
            covered[k] += 1
        if max(covered) < len(out):
            return out
    raise ValueError(f"{word!r} is shorter than four code points")


def present(word: str, frequent: dict[str, int]) -> Iterator[tuple[int, str]]:
    """Every dictionary gram of the word, at most half as long."""
    half = max(SHORT, min(LONG, len(word) // 2))
    for p in range(len(word) - SHORT + 1):
        q = SHORT
        yield p, word[p : p + q]
        while q < half and p + q < len(word) and word[p : p + q] in frequent:
            q += 1
            yield p, word[p : p + q]


def _key(length: int, place: int, gram: str) -> int:
    h = xxhash.xxh64_intdigest(f"{length},{place},{gram}")
    return h - (1 << 64) if h >> 63 else h


def _lists(words: DataFrame, frequent, side: str) -> DataFrame:
    """key, word, n: the lists (`present`) or the look-ups (`looked_up`) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = frequent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                part = whole.slice(at, 2048)
                keys, of = [], []
                for k, w in enumerate(part.column(0).to_pylist()):
                    size, before = len(w), len(keys)
                    if side == "present":
                        keys += [_key(size, p, g) for p, g in present(w, grams)]
                    else:  # the other word is as long, or longer by one before or after the gram
                        keys += {_key(*x, g) for p, g in looked_up(w, grams) for x in ((size, p), (size + 1, p), (size + 1, p + 1))}
                    of += [k] * (len(keys) - before)
                take = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), part.column(0).take(take), part.column(1).take(take)], names=["key", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "key long, word string, n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: every unordered pair of words that are one edit apart, once."""
    grams = words.sparkSession.sparkContext.broadcast(frequent_grams(words))
    a = _lists(words, grams, "looked_up").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = _lists(words, grams, "present").select("key", F.col("word").alias("b"), F.col("n").alias("n_b"))
    pairs = a.join(b.hint("merge"), "key").filter((F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1))
    x, y = F.struct(F.col("a").alias("w"), F.col("n_a").alias("n")), F.struct(F.col("b").alias("w"), F.col("n_b").alias("n"))
    pairs = pairs.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).distinct()
    return pairs.select(F.col("x.w").alias("a"), F.col("x.n").alias("n_a"), F.col("y.w").alias("b"), F.col("y.n").alias("n_b"))


def followed(forms: DataFrame) -> DataFrame:
    """word, root of (word, form), along forms to the last; counts grow along them, so there are no rings."""
    now = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(now.join(step.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        now = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return now


def grouped(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of (word, n)."""
    words = stored(words.select("word", "n"), "vocabulary")
    pairs = near_pairs(words)
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("n")))).alias("s")).select("s.*")
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("m"), "near")).alias("best"))
    fits = -F.col("best.m") >= times * F.col("n")
    found = words.join(best.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n")
    )
    found = stored(found, "near-words")
    roots = followed(found.filter("form is not null"))
    return found.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
