"""Language of documents by multilingual mixture inference.

Learning counts, over all training texts, the byte n-grams of every word per language (n = 1 to 3,
with a word mark), hashed into `BUCKETS` cells per order; the counts are summed per task and then
in a shuffle, so the model has (languages x cells) rows, whatever the corpus size. A word's
log-likelihood under a language is that of its trigrams, smoothed by shorter n-grams.

For one document expectation-maximisation estimates the share of each language in its words. The
language set comes from a penalised likelihood: starting with all languages, the one with the
smallest share is left out as long as that does not lower log-likelihood - PENALTY * ln(words) *
languages. The prediction is the language with the largest share (ties: the first name), the score
its share.

Text that is null or has no letter: `und`, score 0; likewise everything when nothing was learned.
Rows with a null language or text teach nothing. Words are the whole text's, as runs of letters in
lower case; extra columns stay as they are, and result columns replace input columns of their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UND = "und"
BUCKETS = 1 << 14
PENALTY = 2.0
ROUNDS = 10
#: A word counts as at most this many nats between languages, so one odd word cannot decide a text.
CLIP = 12.0
#: Words whose likelihoods a worker remembers between documents.
REMEMBER = 400_000
#: Words of the documents that are estimated side by side.
TOGETHER = 100_000

_WORD = regex.compile(r"\p{L}+")
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint64)


def _cells(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unigram, bigram and trigram cells at every byte of the marked words, and the word of each."""
    data = b"".join(b"\x02" + w.encode() + b"\x03" for w in words)
    codes = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    starts = np.cumsum(codes == 2) - 1
    last = codes
    # what lies before a word's mark reads as the mark of another word: the same for all words
    one = np.concatenate(([3], last[:-1])).astype(np.uint64)
    two = np.concatenate(([3, 3], last[:-2])).astype(np.uint64)
    mark = codes == 2
    one[mark] = 3
    two[mark] = 3
    after = np.concatenate(([False], mark[:-1]))
    two[after] = 3
    shift = np.uint64(7)
    uni = last * _MIX[0]
    bi = uni + one * _MIX[1]
    tri = bi + two * _MIX[2]

    def cell(h: np.ndarray) -> np.ndarray:
        h = h & np.uint64(0xFFFFFFFF)
        return ((h ^ (h >> np.uint64(15))) * np.uint64(0x2C1B3C6D) >> shift & np.uint64(BUCKETS - 1)).astype(np.int64)

    keep = ~mark
    return cell(uni)[keep], cell(bi)[keep], cell(tri)[keep], starts[keep]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (language, order, cell) over a task's texts."""
    sums: dict[str, np.ndarray] = {}
    seen: dict[str, Counter] = {}

    def add(lang: str) -> None:
        counts = seen.pop(lang)
        got = sums.setdefault(lang, np.zeros((3, BUCKETS), dtype=np.int64))
        words, times = list(counts), np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
        for at in range(0, len(words), 50_000):
            *cells, of = _cells(words[at : at + 50_000])
            for row, cell in zip(got, cells, strict=True):
                row += np.bincount(cell, weights=times[at : at + 50_000][of], minlength=BUCKETS).astype(np.int64)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = seen.setdefault(lang, Counter())
            counts.update(words_of(text))
            if len(counts) > REMEMBER // 4:  # what a task holds stays bounded
                add(lang)
    for lang in list(seen):
        add(lang)
    for lang, got in sums.items():
        order, cell = np.nonzero(got)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(cell), pa.string()), pa.array(order, pa.int32()), pa.array(cell, pa.int32()), pa.array(got[order, cell], pa.int64())],
            names=["lang", "ngram", "cell", "n"],
        )


def learn(train: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, ngram, cell, n: the model's counts over all training rows."""
    rows = train.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).filter("lang is not null and text is not null")
    parts = rows.mapInArrow(_counted, "lang string, ngram int, cell int, n long")
    return parts.groupBy("lang", "ngram", "cell").agg(F.sum("n").alias("n"))


class Model:
    """Likelihood tables of all languages: languages x 3 x BUCKETS floats."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        c = counts.astype(np.float64)
        p = (c + 0.5) / (np.maximum(c.sum(axis=2, keepdims=True), 1) + 0.5 * BUCKETS)
        # mixing in the shorter n-grams keeps words of unseen trigrams comparable
        self.tri = (0.6 * p[:, 2]).astype(np.float32)
        self.bi = (0.3 * p[:, 1] / BUCKETS**0.5).astype(np.float32)
        self.uni = (0.1 * p[:, 0] / BUCKETS).astype(np.float32)
        self.memory: dict[str, int] = {}
        self.table = np.zeros((0, len(langs)), dtype=np.float32)

    @classmethod
    def gather(cls, counts: DataFrame) -> Model:
        """The counts on the driver: at most languages x 3 x BUCKETS rows."""
        rows = counts.toArrow()
        names = rows.column("lang").to_pylist()
        langs = sorted(set(names))
        at = {x: i for i, x in enumerate(langs)}
        out = np.zeros((len(langs), 3, BUCKETS), dtype=np.int64)
        if langs:
            out[np.array([at[x] for x in names]), rows.column("ngram").to_numpy(), rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
        return cls(langs, out)

    def scores(self, words: list[str]) -> np.ndarray:
        """Likelihood of each word (rows) under each language over the largest, floored by CLIP."""
        uni, bi, tri, of = _cells(words)
        ll = np.log(self.tri[:, tri] + self.bi[:, bi] + self.uni[:, uni])
        out = np.stack([np.bincount(of, weights=row, minlength=len(words)) for row in ll], axis=1)
        return np.exp(np.maximum(out - out.max(axis=1, keepdims=True), -CLIP)).astype(np.float32)

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """`scores`, remembered between documents in a table of at most REMEMBER words and one group's."""
        if len(self.memory) > REMEMBER:
            self.memory, self.table = {}, self.table[:0]
        new = [w for w in dict.fromkeys(words) if w not in self.memory]
        if new:
            first = len(self.memory)
            rows = [self.scores(new[at : at + 50_000]) for at in range(0, len(new), 50_000)]
            self.memory.update(zip(new, range(first, first + len(new)), strict=True))
            if first + len(new) > len(self.table):
                more = np.zeros((max(first + len(new), 2 * len(self.table)), len(self.langs)), dtype=np.float32)
                more[:first] = self.table[:first]
                self.table = more
            self.table[first : first + len(new)] = np.concatenate(rows)
        return self.table[np.fromiter(map(self.memory.__getitem__, words), dtype=np.int64, count=len(words))]

    def mixtures(self, like: np.ndarray, sizes: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the languages `use` (documents x languages) by EM, and the log-likelihoods.

        `like` has the words of all documents one after the other, `sizes` their numbers.
        """
        starts, of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        share = (use / use.sum(axis=1, keepdims=True)).astype(np.float32)
        one = np.ones(like.shape[1], dtype=np.float32)
        for _ in range(ROUNDS):
            part = like * share[of]
            part *= (1 / (part @ one))[:, None]
            share = np.add.reduceat(part, starts, axis=0) / sizes[:, None].astype(np.float32)
        ll = np.log(np.einsum("ij,ij->i", like, share[of]).astype(np.float64))
        return share, np.add.reduceat(ll, starts)

    def together(self, texts: list[list[str]]) -> list[tuple[str, float, list[str], list[float]]]:
        """Predictions of some documents with words."""
        sizes = np.array([len(x) for x in texts])
        like = self.likelihoods([w for x in texts for w in x])
        cost = PENALTY * np.log(sizes + 1)
        use = np.ones((len(texts), len(self.langs)), dtype=bool)
        share, ll = self.mixtures(like, sizes, use)
        open_ = np.arange(len(texts)) if len(self.langs) > 1 else np.arange(0)
        while len(open_):
            less = use[open_].copy()
            # ties of the smallest share leave out the later name
            order = np.where(less, share[open_], np.inf)[:, ::-1].argmin(axis=1)
            less[np.arange(len(open_)), less.shape[1] - 1 - order] = False
            mask = np.zeros(len(texts), dtype=bool)
            mask[open_] = True
            share2, ll2 = self.mixtures(like[np.repeat(mask, sizes)], sizes[open_], less)
            good = ll2 + cost[open_] >= ll[open_]
            done = open_[good]
            use[done], share[done], ll[done] = less[good], share2[good], ll2[good]
            open_ = done[use[done].sum(axis=1) > 1]
        out = []
        for used, shares in zip(use, np.where(use, share, 0), strict=True):
            best = int(shares.argmax())
            picked = np.flatnonzero(used)
            out.append((self.langs[best], float(min(1.0, max(0.0, shares[best]))), [self.langs[i] for i in picked], [float(shares[i]) for i in picked]))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, list[str], list[float]]]:
        """Leading language, its share, the chosen set and its shares of each text."""
        out: list = [(UND, 0.0, [], [])] * len(texts)
        group: list[list[str]] = []
        at: list[int] = []
        n = 0
        for i, text in enumerate(texts if self.langs else []):
            if words := words_of(text):
                group.append(words)
                at.append(i)
                n += len(words)
            if group and (n > TOGETHER or i == len(texts) - 1):
                for k, found in zip(at, self.together(group), strict=True):
                    out[k] = found
                group, at, n = [], [], 0
        return out


def identify(docs: DataFrame, counts: DataFrame, text: str = "text") -> DataFrame:
    """Add lang_pred, score, lang_set and lang_shares; the model is broadcast (bounded, see `gather`)."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(Model.gather(counts))
    names = ["lang_pred", "score", "lang_set", "lang_shares"]
    kept = docs.drop(*names)
    schema = T.StructType(
        [*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_set", T.ArrayType(T.StringType())), T.StructField("lang_shares", T.ArrayType(T.DoubleType()))]
    )
    where = kept.columns.index(text)
    types = [pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            found = own.predict(batch.column(where).to_pylist())
            cols = [pa.array([x[i] for x in found], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *names])

    return kept.mapInArrow(run, schema)
