"""Cross-tokenizer alignment: which tokens of two public tokenizers cover the same bytes.

Tokenizer A is byte-level BPE (`tokenizers`), B a piece model with byte fallback (`sentencepiece`).
Both get a space and the text. The coarse cuts are the libraries' own spans: character offsets of A
turned into byte offsets, byte spans of B's proto. Where a span is no clean cut (tokens that are
parts of one character share its offsets in A; byte-fallback pieces have empty spans until the
character is whole in B) the end is refined by the length of the token's decoded bytes. Byte
offsets where tokens of both end cut the text into groups; every A token of a group is linked with
every B token of it.

A text falls into segments before every single space or line feed between two other characters. No
token of A reaches over such a border, and none of B does if no piece holds a space after another
character or a line feed, which is looked up when the model is loaded (if one does, texts stay
whole). So groups never cross borders, and a task remembers those of up to `REMEMBER` segments.
Ids, cuts and groups are those of whole texts (tested).

An id pair's count is the number of rows that hold it linked. A task sums the pairs of many rows
before the shuffle. Counts of the pairs with at least 1/`HEAD` of all links are sent to the tasks:
these are at most `HEAD` pairs, whatever the corpus. The links of rarer pairs are joined with their
counts in a shuffle and added per row. The highest count per A id is bounded by the vocabulary.

Null and empty texts, and texts that the tokens of A or B do not give back byte for byte after a
space (as those that hold U+2581), have no tokens: zeros and an empty digest. Null ids and repeated
rows are rows like any other; very long texts are segments like any other. Extra columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.llm.common import stored

FOLDER = "/opt/tokenizers"
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs whose counts every task gets, at most.
HEAD = 1 << 21
#: Segments a worker remembers, and the longest of them in characters.
REMEMBER, LONGEST = 300_000, 64
#: Id pairs that are counted together.
TOGETHER = 2_000_000
#: Both vocabularies must fit, so that an id pair is one 32-bit number.
LARGEST_ID = 1 << 16

_BORDER = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: A segment of which both borders are such borders.
_WHOLE = re.compile(r"[ \n][^\s▁](?:[^▁]*[^\s▁])?")

# fixed values: the byte-level alphabet, printable bytes as themselves, the others from U+0100 on
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_alphabet() -> dict[str, int]:
    others = [b for b in range(256) if b not in set(_PLAIN)]
    return {chr(b): b for b in _PLAIN} | {chr(0x100 + i): b for i, b in enumerate(others)}


def _piece_bytes(piece: str) -> bytes:
    """A piece in UTF-8 with spaces, or the byte that `<0xHH>` names."""
    if re.fullmatch(r"<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


#: Groups of a segment: numbers of A and B tokens and groups, the groups as text, linked id pairs.
Aligned = tuple[int, int, int, str, bytes]


class Aligner:
    """Both tokenizers of a worker, and the segments it remembers."""

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True  # their strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        alphabet = byte_alphabet()
        vocabulary = sorted((i, t) for t, i in self.a.get_vocab(with_added_tokens=True).items())
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if [i for i, _ in vocabulary] != list(range(len(vocabulary))) or max(len(pieces), len(vocabulary)) > LARGEST_ID:
            raise ValueError(f"ids must be gapless and below {LARGEST_ID}")
        self.bytes_a = [bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for _, t in vocabulary]
        self.bytes_b = [_piece_bytes(p) for p in pieces]
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x))) for x in (self.bytes_a, self.bytes_b))
        self.parts = not any(re.search(r"[^▁]▁|\n", p) for p in pieces)
        ids = range(max(len(pieces), len(vocabulary)))
        self.names = np.array([[f"{i}{mark}" for i in ids] for mark in ",|;\n"], dtype=object)
        # what was asked for lately, and what was before it
        self.memory: dict[str, Aligned | None] = {}
        self.older: dict[str, Aligned | None] = {}

    def tokens(self, text: str, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids and byte ends of A and B tokens of a text that begins with a space; None if the
        tokens do not give the text back."""
        a = self.a.encode(text, add_special_tokens=False)
        b = self.b.encode(text[1:], return_type="proto", num_threads=1).pieces  # B puts the space itself
        ids_a, ids_b = a.ids, [p.id for p in b]
        if b"".join([self.bytes_a[i] for i in ids_a]) != data or b"".join([self.bytes_b[i] for i in ids_b]) != data:
            return None
        # coarse cuts: A's character spans as bytes, B's byte spans, which lack the space
        ends_a = np.fromiter((y for _, y in a.offsets), dtype=np.int64, count=len(ids_a))
        if len(data) > len(text):
            c = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
            ends_a = np.cumsum(1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))[ends_a - 1]
        ends_b = np.fromiter((p.end for p in b), dtype=np.int64, count=len(ids_b)) + 1
        ids_a, ids_b = np.array(ids_a), np.array(ids_b)
        # parts of a character and byte-fallback pieces end where their decoded bytes do
        for ends, sizes in ((ends_a, self.sizes_a[ids_a]), (ends_b, self.sizes_b[ids_b])):
            exact = np.cumsum(sizes)
            wrong = ends != exact
            ends[wrong] = exact[wrong]
        return ids_a, ends_a, ids_b, ends_b

    def groups(self, segments: list[str]) -> list[Aligned | None] | None:
        """Groups of segments that follow one another; None if they are not segments of their joined text."""
        text = "".join(segments)
        data = text.encode()
        found = self.tokens(text, data)
        if found is None:
            return [None] if len(segments) == 1 else None
        ids_a, ends_a, ids_b, ends_b = found
        lasts = np.cumsum([len(s.encode()) for s in segments]) if len(data) > len(text) else np.cumsum(list(map(len, segments)))
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        at = np.searchsorted(cuts, lasts)
        if (cuts[np.minimum(at, len(cuts) - 1)] != lasts).any():
            return None
        ga, gb = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        na, nb = np.bincount(ga, minlength=len(cuts)), np.bincount(gb, minlength=len(cuts))
        stop_a, stop_b = np.cumsum(na), np.cumsum(nb)
        # every A token of a group with every B token of it
        times = nb[ga]
        mates = np.arange(times.sum()) + np.repeat((stop_b - nb)[ga] - (np.cumsum(times) - times), times)
        pairs = (np.repeat(ids_a, times) << 16 | ids_b[mates]).astype("<u4").tobytes()
        # a group's A tokens, then its B tokens, each with the mark that follows it
        ids, marks = np.empty(len(ids_a) + len(ids_b), dtype=np.int64), np.zeros(len(ids_a) + len(ids_b), dtype=np.int64)
        of_a, of_b = np.arange(len(ids_a)) + (stop_b - nb)[ga], np.arange(len(ids_b)) + stop_a[gb]
        ids[of_a], ids[of_b] = ids_a, ids_b
        marks[of_a[stop_a - 1]], marks[of_b[stop_b - 1]] = 1, 2
        marks[of_b[stop_b[at] - 1]] = 3
        names = "".join(self.names[marks, ids].tolist()).split("\n")
        begin = lambda x: np.concatenate(([0], x[at]))
        stop_p = begin(np.cumsum(na * nb)) * 4
        counts = [np.diff(begin(x)).tolist() for x in (stop_a, stop_b, np.arange(1, len(cuts) + 1))]
        return [(*c, n, pairs[x:y]) for *c, n, x, y in zip(*counts, names[: len(segments)], stop_p[:-1].tolist(), stop_p[1:].tolist(), strict=True)]

    def align(self, segments: list[str]) -> list[Aligned | None]:
        """Groups of segments, which begin with a space or, inside a text, a line feed."""
        if all(_WHOLE.fullmatch(s) for s in segments):
            found = self.groups([" x", *segments])  # a text of its own, which begins with a space
            if found is not None:
                return found[1:]
        if len(segments) > 1:
            return [self.align([s])[0] for s in segments]
        if segments[0][0] == " ":
            return self.groups(segments) or [None]
        return (self.groups([" x", *segments]) or [None])[-1:]  # None: the whole text decides

    def segments(self, text: str | None) -> list[str]:
        if not text:
            return []
        return _BORDER.split(" " + text) if self.parts else [" " + text]

    def rows(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, str, np.ndarray] | None]:
        """What `groups` says of every text, pairs as an array."""
        if 2 * len(self.memory) > REMEMBER:
            self.memory, self.older = {}, self.memory
        parts, new = list(map(self.segments, texts)), []
        for s in dict.fromkeys(itertools.chain.from_iterable(parts)):
            if s not in self.memory:
                if s in self.older:
                    self.memory[s] = self.older[s]
                else:
                    new.append(s)
        extra: dict[str, Aligned | None] = {}
        plain = [s for s in new if _WHOLE.fullmatch(s)]
        odd = [s for s in new if not _WHOLE.fullmatch(s)]
        for some in itertools.chain((plain[k : k + 2048] for k in range(0, len(plain), 2048)), ([s] for s in odd)):
            for s, found in zip(some, self.align(some), strict=True):
                (self.memory if len(s) <= LONGEST else extra)[s] = found
        get = lambda s: extra[s] if s in extra else self.memory[s]
        for text, segments in zip(texts, parts, strict=True):
            found = list(map(get, segments))
            if len(found) > 1 and None in found:  # parts that only together may give the text back
                found = self.groups([" " + text])
            if not found or found[0] is None:
                yield None
                continue
            a, b, n, names, pairs = zip(*found, strict=True)
            yield sum(a), sum(b), sum(n), ";".join(names), np.frombuffer(b"".join(pairs), dtype="<u4")


def packed(pairs: np.ndarray) -> tuple[bytes, bytes]:
    """Distinct pairs as byte planes of their steps, and how often each occurs."""
    distinct, times = np.unique(pairs, return_counts=True)
    steps = np.diff(distinct, prepend=np.uint32(0)).astype("<u4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes(), times.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1)


def distinct_of(planes: bytes) -> np.ndarray:
    """The pairs again."""
    return np.cumsum(unpacked(planes), dtype=np.uint32)


_ROW = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def _aligned(docs: DataFrame, folder: str) -> DataFrame:
    """row_, doc_id and the counts of every row, with its packed pairs."""
    spark = docs.sparkSession
    with open(f"{folder}/{FILE_A}", "rb") as fa, open(f"{folder}/{FILE_B}", "rb") as fb:  # read on the driver, sent with the job
        files = spark.sparkContext.broadcast((fa.read(), fb.read()))
    rows = docs.select(F.monotonically_increasing_id().alias("row_"), F.col("doc_id"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["row_"], rows.schema["doc_id"], *T.StructType.fromDDL(_ROW).fields])
    types = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = Aligner(*files.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                out = []
                for found in own.rows(batch.column(2).to_pylist()):
                    if found is None:
                        out.append((0, 0, 0, 0, "", b"", b""))
                    else:
                        n_a, n_b, n_groups, text, pairs = found
                        out.append((n_a, n_b, n_groups, len(pairs), hashlib.sha256(text.encode()).hexdigest(), *packed(pairs)))
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=schema.names)

    return rows.mapInArrow(run, schema)


def _sums(held: list[np.ndarray]) -> pa.RecordBatch:
    pair, n = np.unique(np.concatenate(held), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pair, n: rows with the pair, summed over many rows."""
    held, size = [], 0
    for batch in batches:
        for planes in batch.column(0):
            held.append(distinct_of(planes.as_py()))
            size += len(held[-1])
            if size > TOGETHER:
                yield _sums(held)
                held, size = [], 0
    if size:
        yield _sums(held)


def _head(spark: SparkSession, counts: DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The least count of a head pair, the head pairs in order, their counts, and the best count of each A id."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(1, -(-total // HEAD))  # pairs of at least this count are at most HEAD
    table = counts.filter(F.col("n") >= least).toArrow()
    pair, n = table.column("pair").to_numpy().astype(np.uint32), table.column("n").to_numpy()
    order = np.argsort(pair)
    best = np.zeros(LARGEST_ID, dtype=np.int64)
    for a, most in counts.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("n")).collect():  # one row for each id of A
        best[a] = most
    return least, pair[order], n[order], best


def _summed(batches: Iterator[pa.RecordBatch], head) -> Iterator[pa.RecordBatch]:
    """Counts over the head's links of a row, and its other pairs."""
    _, pair, n, best = head.value
    most = best[(pair >> np.uint32(16)).astype(np.int64)] == n
    for batch in batches:
        at_p, at_t = batch.schema.get_field_index("pairs"), batch.schema.get_field_index("times")
        sums, bests, rest, times = [], [], [], []
        for p, t in zip(batch.column(at_p), batch.column(at_t), strict=True):
            own, k = distinct_of(p.as_py()), unpacked(t.as_py()).astype(np.int64)
            at = np.searchsorted(pair, own)
            at[at == len(pair)] = 0
            known = pair[at] == own if len(pair) else np.zeros(len(own), dtype=bool)
            sums.append(int((n[at[known]] * k[known]).sum()))
            bests.append(int(k[known][most[at[known]]].sum()))
            rest.append(own[~known].astype(np.int64))
            times.append(k[~known])
        cols = [c for i, c in enumerate(batch.columns) if i not in (at_p, at_t)]
        names = [c for c in batch.schema.names if c not in ("pairs", "times")]
        more = [pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), pa.array(rest, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*cols, *more], names=[*names, "n_best", "count_sum", "rest", "rest_times"])


def alignments(docs: DataFrame, folder: str = FOLDER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    spark = docs.sparkSession
    rows = stored(_aligned(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), folder), "aligned")
    counts = rows.select("pairs").mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = stored(counts, "pair-counts")
    found = _head(spark, counts)
    head = spark.sparkContext.broadcast(found)
    kept = [f for f in rows.schema.fields if f.name not in ("pairs", "times")]
    schema = T.StructType([*kept, *T.StructType.fromDDL("n_best long, count_sum long, rest array<bigint>, rest_times array<bigint>").fields])
    sums = stored(rows.mapInArrow(lambda batches: _summed(batches, head), schema), "head-sums")
    rare = sums.select("row_", F.explode(F.arrays_zip("rest", "rest_times")).alias("p")).select("row_", F.col("p.rest").alias("pair"), F.col("p.rest_times").alias("times"))
    most = counts.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("n").alias("best"))
    tail = counts.withColumn("a", F.shiftright("pair", 16)).join(F.broadcast(most), "a").filter(F.col("n") < found[0])
    tail = tail.select("pair", "n", (F.col("n") == F.col("best")).cast("long").alias("is_best"))
    added = rare.join(tail, "pair").groupBy("row_").agg(F.sum(F.col("n") * F.col("times")).alias("s"), F.sum(F.col("is_best") * F.col("times")).alias("b"))
    out = sums.drop("rest", "rest_times").join(added, "row_", "left")
    return out.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("b", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("s", F.lit(0))).alias("count_sum"), "groups_sha256"
    )
