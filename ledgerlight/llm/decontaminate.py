"""Benchmark passages in documents: a prefix-filtered join of word windows.

An item is its windows of `WINDOW` consecutive words (a shorter item is one window). A window's
tokens are its `SHINGLE`-word shingles (shorter windows: the window itself). A window occurs in a
document only if all its tokens do, so it is enough to join on one of them: the window's tokens
are ordered by how often they occur in all documents, and the rarest is its prefix. Around every
document position of a prefix token the positional bounds say where the window would begin, the
length bound whether it fits, and the words there are compared with the window's: an exact
check.

Tasks find tokens by a bitmap of `BITS` cells, the only thing that is broadcast: its size is
fixed, whatever the benchmark's. What passes it by chance is lost in the join. The join is of
plain shuffles, so a token that a third of the documents hold is split among tasks. Documents with
equal texts are joined once, by digest.

Null or wordless texts have no hits and no windows. Items with a null id count as one item with
an empty id. An item id that repeats names all its texts. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import stored, text_of

WINDOW = 10
SHINGLE = 3
BITS = 24
#: Word hashes that a worker remembers.
REMEMBER = 400_000

_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_hashes: dict[bytes, int] = {}


def words_of(text: str | None) -> list[bytes]:
    """Words of the lower-cased text: digits, ASCII letters and everything beyond ASCII."""
    return text.encode().translate(_TABLE).split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_hashes) > REMEMBER:
        _hashes.clear()
    for w in set(words):
        if w not in _hashes:
            _hashes[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def tokens(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for every run of `size` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        part = hashes[k : k + n] * _MIX[k % 3]
        out = (out ^ (part ^ (part >> np.uint64(29)))) * _MIX[(k + 1) % 3]
    return out ^ (out >> np.uint64(32))


def _token_size(words: int) -> int:
    return min(SHINGLE, words)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of items with their tokens."""
    for batch in batches:
        out: list[tuple] = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = words_of(text)
            size = min(WINDOW, len(words))
            if not size:
                continue
            k = _token_size(size)
            ids = tokens(word_hashes(words), k).view(np.int64).tolist()
            for a in range(len(words) - size + 1):
                out.append((item, b" ".join(words[a : a + size]).decode(), size, k, ids[a : a + size - k + 1]))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["item", "window", "size", "k", "tokens"])


def windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """window, size, k, tokens, items: every different window of the benchmark."""
    rows = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text}`").alias("text"))
    every = rows.mapInArrow(_windows, "item string, window string, size int, k int, tokens array<long>")
    # token arrays are a function of the window
    return every.groupBy("window", "size", "k").agg(F.first("tokens").alias("tokens"), F.collect_set("item").alias("items"))


def bitmap(found: DataFrame) -> np.ndarray:
    """The cells of the tokens in `found` (k, token); gathered as at most 2^BITS / 64 longs."""
    cell = F.shiftrightunsigned("token", 64 - BITS)
    rows = (
        found.select(F.shiftright(cell, 6).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(token, {64 - BITS}) & 63 as int))").alias("bit"))
        .groupBy("at")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (BITS - 6), dtype=np.int64)
    if rows.num_rows:
        out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little")


class Cells:
    """Bitmap and token sizes of the benchmark, as tasks get them: 2^BITS / 8 bytes."""

    def __init__(self, found: DataFrame):
        self.sizes = sorted(r["k"] for r in found.select("k").distinct().collect())  # 1 to SHINGLE
        self.packed = np.packbits(bitmap(found))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and tokens that pass the bitmap."""
        if not hasattr(self, "cells"):
            self.cells = np.unpackbits(self.packed).view(bool)
        at, got = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
        for k in self.sizes:
            ids = tokens(hashes, k)
            here = np.flatnonzero(self.cells[ids >> np.uint64(64 - BITS)])
            at.append(here)
            got.append(ids[here])
        return np.concatenate(at), np.concatenate(got)


def document_counts(docs: DataFrame, cells, text: str = "text") -> DataFrame:
    """token, n: occurrences of passing tokens in all documents, summed per task and then shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [cells.value.find(word_hashes(words_of(t.as_py())))[1] for t in batch.column(0)]
            ids, n = np.unique(np.concatenate(held) if held else np.zeros(0, dtype=np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

    return docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def prefixed(wins: DataFrame, counts: DataFrame) -> DataFrame:
    """token, offset, window, size, items: each window under its rarest token (ties: the first)."""
    each = wins.select("window", "size", "items", F.posexplode("tokens").alias("offset", "token"))
    known = each.join(counts, "token")  # a token in no document rules its window out
    full = known.groupBy("window", "size").agg(F.min(F.struct("n", "offset", "token")).alias("p"), F.first("items").alias("items"), F.count("*").alias("found"))
    whole = wins.select("window", F.size("tokens").alias("want"))
    return full.join(whole, "window").filter("found = want").select("p.token", "p.offset", "window", "size", "items")


def occurrences(docs: DataFrame, cells, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest, n_words, at: passing tokens with the words around them.

    `at` holds (pos, token, left, context): `left` words of the context stand before the token.
    """
    kinds = pa.list_(pa.struct([("pos", pa.int32()), ("token", pa.int64()), ("left", pa.int32()), ("context", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, at = [], []
            for t in batch.column(2):
                words = words_of(t.as_py())
                sizes.append(len(words))
                pos, ids = cells.value.find(word_hashes(words))
                at.append(
                    [
                        (p, i, min(p, WINDOW), b" ".join(words[max(0, p - WINDOW) : p + WINDOW]).decode())
                        for p, i in zip(pos.tolist(), ids.view(np.int64).tolist(), strict=True)
                    ]
                )
            rows = pa.array([[dict(zip(("pos", "token", "left", "context"), x, strict=True)) for x in one] for one in at], kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), rows], names=["doc_id", "digest", "n_words", "at"])

    thin = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.md5(text_of(text).cast("binary")).alias("digest"), F.col(f"`{text}`").alias("text"))
    kind = thin.schema["doc_id"].dataType.simpleString()
    return thin.mapInArrow(run, f"doc_id {kind}, digest string, n_words long, at array<struct<pos: int, token: long, left: int, context: string>>")


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest, n_words, n_hit, items (sorted ids with an occurring window), for every row."""
    wins = stored(windows(benchmark), "windows")
    every = wins.select("k", F.explode("tokens").alias("token"))
    counts = document_counts(docs, spark.sparkContext.broadcast(Cells(every)), text)
    known = stored(every.select("token").distinct().join(counts, "token"), "token-counts")
    index = stored(prefixed(wins, known), "prefixes")
    prefixes = index.select(F.least("size", F.lit(SHINGLE)).alias("k"), "token")
    found = stored(occurrences(docs, spark.sparkContext.broadcast(Cells(prefixes)), doc_id, text), "token-places")
    texts = found.filter(F.size("at") > 0).groupBy("digest").agg(F.first("at").alias("at"))
    places = stored(texts.select("digest", F.explode("at").alias("x")).select("digest", "x.*"), "places")
    start = F.col("left") - F.col("offset")
    words = F.split("context", " ")
    same = (
        places.join(index, "token")
        .filter(start >= 0)  # the window would begin before the text
        .filter(F.size(words) - start >= F.col("size"))  # or end behind it
        .filter(F.array_join(F.slice(words, start + 1, F.col("size")), " ") == F.col("window"))
        .select("digest", (F.col("pos") - F.col("offset")).alias("start"), "size", "items")
    )
    hits = same.groupBy("digest").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1))))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    hits = stored(hits, "hits")
    none = F.expr("cast(array() as array<string>)")
    return found.select("doc_id", "digest", "n_words").join(hits, "digest", "left").select(
        "doc_id", "digest", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items")
    )


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without any hit, with all their columns. The digests of the others are joined away."""
    found = contaminated(spark, docs, benchmark, doc_id, text).filter("n_hit > 0").select("digest").distinct()
    bad = stored(found.select(F.col("digest").alias("_contaminated_digest")), "contaminated")
    return docs.join(bad, F.md5(text_of(text).cast("binary")) == bad["_contaminated_digest"], "left_anti")
