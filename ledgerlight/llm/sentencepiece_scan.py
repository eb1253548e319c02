"""SentencePiece encoding as a max-plus parallel scan, and decoding.

A text is normalised as SentencePiece does without extra rules (a mark before it, marks for
blanks) and cut into the pieces of the vocabulary with the largest sum of scores (Viterbi; ties:
the longer last piece). A character outside the vocabulary is written as its UTF-8 byte pieces.

Texts of more than `chunk` characters are cut into chunks. A chunk's state at its left border is
by how many characters a piece from before reaches into it, at its right border by how many its
last piece reaches out. Its transfer matrix has the best score from each left to each right state.
Matrices multiply in the max-plus semiring: products of blocks of chunks are formed in parallel,
scanned per document, and spread over the chunks of each block. From its scores at the left border
every chunk tells, for each right state, the left state of the best path; these maps compose from
the last chunk back, and then each chunk is traced back on its own. Scores are whole numbers, so
sums are exact and chunks cannot change the result.

The vocabulary file at hand is a byte-pair model: its scores are merge ranks. A piece of rank r
scores -1024 ln(r + 2), rounded: the order of the merges read as a Zipf law. The result is the
best path over these scores, as the library gives for the same pieces and scores with model type
unigram; it is not the sequence of merges.

Null text: null ids, no tokens. Empty text: no ids. A mark (U+2581) in the text itself is written
as bytes, so that decoding gives back every text exactly. Texts are keyed by their digest; repeated
rows are encoded once where they are long. Extra columns stay; result columns replace input columns
of their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.llm.common import fresh, stored

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 32_768
BLOCK = 64
SCALE = 1024
NONE = -(1 << 60)
#: Segments that a worker remembers with their pieces: `forward` one by one, `Batch` in arrays.
REMEMBER = 50_000
REMEMBER_ROWS = 500_000
#: Segments whose paths are found together, and their characters at most.
TOGETHER = 50_000
LONGEST = 64

MARK = "▁"
#: Stands for a mark in the text itself; a lone surrogate, so no text has it.
OWN_MARK = "\udc81"
#: Characters before which a letter ends a piece; checked against the vocabulary.
STOPS = ".,;:!?"
# between two segments no piece of the vocabulary can stand: at a line feed, before a mark that
# follows another character, and between a letter and a stop
_SEGMENT = re.compile(f"\n|{MARK}*[a-zA-ZÀ-ÖØ-öø-ÿ]++(?![^{MARK}\n{STOPS}])|{MARK}*[^{MARK}\n]+|{MARK}+")
_CUT = re.compile(f"[a-zA-ZÀ-ÖØ-öø-ÿ][{STOPS}]|[^{MARK}]{MARK}|\n.|.\n", re.DOTALL)


def normalised(text: str) -> str:
    return text.replace(MARK, OWN_MARK).replace(" ", MARK)


class Vocabulary:
    """Pieces with whole-number scores, read from a SentencePiece model's bytes."""

    def __init__(self, model: bytes):
        p = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.names = [p.id_to_piece(i) for i in range(p.vocab_size())]
        self.bytes_of = {i: int(n[3:5], 16) for i, n in enumerate(self.names) if p.is_byte(i)}
        normal = [i for i in range(p.vocab_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        usable = [i for i in normal if p.get_score(i) > -1e8]
        self.pieces = {self.names[i]: (i, -round(SCALE * float(np.log(2 - p.get_score(i))))) for i in usable}
        # pieces the model rules out by a vast negative score: runs of marks; of these only the
        # single mark stays, with the worst score, because each blank needs it
        worst = min(x for _, x in self.pieces.values())
        self.pieces |= {self.names[i]: (i, worst) for i in normal if self.names[i] == MARK and self.names[i] not in self.pieces}
        self.byte_ids = [0] * 256
        for i, b in self.bytes_of.items():
            self.byte_ids[b] = i
        if len(self.bytes_of) != 256:
            raise ValueError("the vocabulary has no byte pieces, so not every text can be written")
        self.reach = max(map(len, self.pieces))
        #: prefix tree: character -> (score of the piece that ends here or None, tree below)
        self.tree: dict = {}
        for name, (_, score) in sorted(self.pieces.items()):
            below = self.tree
            for c in name[:-1]:
                below = below.setdefault(c, (None, {}))[1]
            below[name[-1]] = (score, below.get(name[-1], (None, {}))[1])
        #: score of a character that is no piece: ten units below the worst piece
        self.unknown = min(s for _, s in self.pieces.values()) - 10 * SCALE
        if any(x == "\n" or _CUT.search(x) for x in self.pieces):
            raise ValueError("pieces reach over a line feed, a blank or a stop: they need another rule of cuts")
        self.memory: dict[str, tuple[list[int], int]] = {}
        self._batch: Batch | None = None

    def batch(self) -> Batch:
        """The worker's arrays for this vocabulary, made once."""
        if self._batch is None:
            self._batch = Batch(self)
        return self._batch

    def forward(self, s: str, first: list[int], n: int) -> tuple[list[int], list[int]]:
        """Best scores and piece starts at positions 0 to len(s), with pieces that begin before n.

        `first` gives scores of entering at positions 0, 1, ...; start -1 marks an entry.
        """
        size = len(s)
        best, back = [NONE] * (size + 1), [-1] * (size + 1)
        best[: min(len(first), size + 1)] = first[: size + 1]
        tree, unknown = self.tree, self.unknown
        for a in range(min(n, size)):
            here = best[a]
            if here <= NONE:
                continue
            below, end = tree, a
            for c in s[a : a + self.reach]:
                step = below.get(c)
                if step is None:
                    break
                score, below = step
                end += 1
                if score is not None:
                    if here + score > best[end]:
                        best[end], back[end] = here + score, a
                elif end == a + 1 and here + unknown > best[end]:
                    best[end], back[end] = here + unknown, a
            if end == a and here + unknown > best[a + 1]:
                best[a + 1], back[a + 1] = here + unknown, a
        return best, back

    def traced(self, s: str, back: list[int], end: int) -> tuple[list[int], int]:
        """Ids of the path that ends at `end`, and the position at which it entered."""
        out: list[int] = []
        while back[end] >= 0:
            a = back[end]
            hit = self.pieces.get(s[a:end])
            if hit:
                out.append(hit[0])
            else:
                raw = MARK if s[a] == OWN_MARK else s[a]
                out.extend(self.byte_ids[x] for x in reversed(raw.encode()))
            end = a
        out.reverse()
        return out, end

    def word(self, s: str) -> tuple[list[int], int]:
        """Ids and score of a segment between two cuts, remembered."""
        got = self.memory.get(s)
        if got is None:
            best, back = self.forward(s, [0], len(s))
            got = self.traced(s, back, len(s))[0], best[len(s)]
            if len(self.memory) >= REMEMBER:
                self.memory.clear()
            if len(s) <= 64:
                self.memory[s] = got
        return got

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        out: list[int] = []
        memory, word = self.memory, self.word
        for s in _SEGMENT.findall(MARK + normalised(text)) if text else ():
            out += (memory.get(s) or word(s))[0]
        return out

    def decode(self, ids: list[int]) -> str:
        out: list[bytes] = []
        for i in ids:
            b = self.bytes_of.get(i)
            out.append(self.names[i].replace(MARK, " ").encode() if b is None else bytes((b,)))
        return b"".join(out).decode()[1:]


class Batch:
    """The same best paths for many segments at once, as arrays.

    All positions of all segments walk the prefix tree together; then positions are settled from
    left to right, those of equal distance from their segment's begin together. A segment with
    characters outside the vocabulary, or a very long one, is left to `Vocabulary.word`.
    """

    EMPTY = np.uint64(2**64 - 1)
    SLOTS = 19

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.letters = frozenset(x for x in vocabulary.pieces if len(x) == 1)
        edges, scores, ids, open_ = [], [NONE], [-1], [(0, "", vocabulary.tree)]
        while open_:
            node, name, below = open_.pop()
            for c, (score, tree) in below.items():
                edges.append((node, ord(c), len(scores)))
                open_.append((len(scores), name + c, tree))
                scores.append(NONE if score is None else score)
                ids.append(-1 if score is None else vocabulary.pieces[name + c][0])
        self.scores, self.ids = np.array(scores, dtype=np.int64), np.array(ids, dtype=np.int32)
        node, char, child = (np.array(x, dtype=np.uint64) for x in zip(*edges, strict=True))
        key = node << np.uint64(21) | char
        self.keys = np.full(1 << self.SLOTS, self.EMPTY, dtype=np.uint64)
        self.children = np.zeros(1 << self.SLOTS, dtype=np.int64)
        at = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.keys[at] == self.EMPTY)
            free = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[free]], self.children[at[free]] = key[free], child[free].astype(np.int64)
            rest = np.delete(np.arange(len(key)), free)
            key, child, at = key[rest], child[rest], (at[rest] + 1) % (1 << self.SLOTS)
        parts = [b"" if n is None else n for n in (self._bytes(i) for i in range(len(vocabulary.names)))]
        self.part_size = np.array([len(x) for x in parts], dtype=np.int64)
        self.part_start = np.cumsum(self.part_size) - self.part_size
        self.parts = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self._forget()

    def _bytes(self, i: int) -> bytes:
        b = self.v.bytes_of.get(i)
        return self.v.names[i].replace(MARK, " ").encode() if b is None else bytes((b,))

    def _forget(self) -> None:
        self.memory: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, dtype=np.int32)
        self.used = 0
        self.start = np.zeros(1 << 14, dtype=np.int64)
        self.size = np.zeros(1 << 14, dtype=np.int32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def _step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Child nodes, -1 where there is none."""
        key = node.astype(np.uint64) << np.uint64(21) | char.astype(np.uint64)
        at = self._slot(key)
        out = np.full(len(key), -1, dtype=np.int64)
        open_ = np.arange(len(key))
        while len(open_):
            found = self.keys[at]
            hit = found == key[open_]
            out[open_[hit]] = self.children[at[hit]]
            go = ~hit & (found != self.EMPTY)
            open_, at = open_[go], (at[go] + 1) % (1 << self.SLOTS)
        return out

    def paths(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of pieces and the pieces of all segments; all characters have to be pieces."""
        sizes = np.array([len(x) for x in segments], dtype=np.int64)
        codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        of = np.repeat(np.arange(len(segments)), sizes)
        ends = np.cumsum(sizes)
        active, node, found = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int64), []
        for d in range(self.v.reach):
            inside = active + d < ends[of[active]]
            active, node = active[inside], node[inside]
            if not len(active):
                break
            child = self._step(node, codes[active + d])
            there = child >= 0
            active, node = active[there], child[there]
            piece = self.scores[node] > NONE
            found.append((active[piece], active[piece] + d + 1, node[piece]))
        a, b, node = (np.concatenate(x) for x in zip(*found, strict=True))
        local = a - (ends - sizes)[of[a]]
        order = np.argsort(local, kind="stable")
        # a segment of n characters has n + 1 places, so places are shifted by the segment's number
        a, b, node, word, local = a[order], b[order], node[order], of[a[order]], local[order]
        a, b, score = a + word, b + word, self.scores[node]
        best = np.full(len(codes) + len(segments), NONE, dtype=np.int64)
        first = ends - sizes + np.arange(len(segments))
        best[first] = 0
        back, by = np.full(len(best), -1, dtype=np.int64), np.zeros(len(best), dtype=np.int64)
        cuts = np.flatnonzero(np.diff(local, prepend=-1, append=-1))
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            total = best[a[x:y]] + score[x:y]
            better = total > best[b[x:y]]
            to = b[x:y][better]
            best[to], back[to], by[to] = total[better], a[x:y][better], node[x:y][better]
        now, word, steps = ends + np.arange(len(segments)), np.arange(len(segments)), []
        while len(now):
            steps.append((word, by[now]))
            now = back[now]
            more = now != first[word]
            now, word = now[more], word[more]
        numbers = np.concatenate([w for w, _ in steps[::-1]])
        nodes = np.concatenate([n for _, n in steps[::-1]])
        order = np.argsort(numbers, kind="stable")
        return np.bincount(numbers, minlength=len(segments)), self.ids[nodes[order]]

    def _learn(self, segments: list[str]) -> None:
        plain, rest = [], []
        for x in segments:
            (plain if len(x) <= LONGEST and self.letters.issuperset(x) else rest).append(x)
        made: list[tuple[list[str], np.ndarray, np.ndarray]] = [(part, *self.paths(part)) for part in (plain[k : k + TOGETHER] for k in range(0, len(plain), TOGETHER))]
        if rest:
            got = [self.v.word(x)[0] for x in rest]
            made.append((rest, np.array([len(x) for x in got]), np.array([i for x in got for i in x], dtype=np.int32)))
        for names, sizes, ids in made:
            n, row = len(names), len(self.memory)
            while row + n > len(self.start):
                self.start, self.size = np.concatenate((self.start, np.zeros_like(self.start))), np.concatenate((self.size, np.zeros_like(self.size)))
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
            self.start[row : row + n] = self.used + np.cumsum(sizes) - sizes
            self.size[row : row + n] = sizes
            self.pool[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self.memory.update(zip(names, range(row, row + n), strict=True))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids and the ids of all texts, one text after the other."""
        if len(self.memory) > REMEMBER_ROWS:
            self._forget()
        segments = [_SEGMENT.findall(MARK + normalised(t)) if t else [] for t in texts]
        every = [x for one in segments for x in one]
        if new := [x for x in dict.fromkeys(every) if x not in self.memory]:
            self._learn(new)
        rows = np.fromiter(map(self.memory.__getitem__, every), dtype=np.int64, count=len(every))
        size = self.size[rows].astype(np.int64)
        ids = spread(self.pool, self.start[rows], size)
        ends = np.concatenate(([0], np.cumsum(size)))[np.cumsum([len(x) for x in segments])] if segments else np.zeros(0, dtype=np.int64)
        return np.diff(ends, prepend=0), ids

    def decode(self, sizes: np.ndarray, ids: np.ndarray) -> list[str]:
        """The texts of all id lists."""
        size = self.part_size[ids]
        data = spread(self.parts, self.part_start[ids], size).tobytes()
        ends = np.concatenate(([0], np.cumsum(size)))[np.cumsum(sizes)].tolist() if len(sizes) else []
        return [data[a + 1 : b].decode() if b > a else "" for a, b in zip([0, *ends], ends, strict=False)]


def spread(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """pool[start[0]:start[0]+size[0]], pool[start[1]:...], ... in one array."""
    before = np.cumsum(size) - size
    return pool[np.repeat(start - before, size) + np.arange(size.sum())]


class Chunk:
    """A chunk of a normalised text: `text` goes on behind its `n` characters by the vocabulary's reach."""

    def __init__(self, vocabulary: Vocabulary, before: str, text: str, n: int, last: bool):
        self.v, self.text, self.n = vocabulary, text, n
        starts = [m.start() for m in _SEGMENT.finditer(text)]
        at_border = not before or _CUT.match(before + text[:1]) is not None
        cuts = [p for p in starts if p or at_border] + ([len(text)] if last else [])
        inside = [p for p in cuts if p <= n]
        #: no cut up to the right border: only then does the whole matrix have to be worked out
        self.whole = not inside
        self.head, self.tail = (inside[0], inside[-1]) if inside else (0, 0)
        self.limit = next((p for p in cuts if p > n), len(text))

    def _first(self, state: int) -> list[int]:
        return [NONE] * state + [0]

    def matrix(self) -> np.ndarray:
        """Best scores from left states (rows) to right states."""
        size = self.v.reach
        out = np.full((size, size), NONE, dtype=np.int64)
        if self.whole:
            s = self.text[: self.limit]
            for i in range(min(size, len(s) + 1)):
                best = self.v.forward(s, self._first(i), self.n)[0][self.n : self.n + size]
                out[i, : len(best)] = best
            return out
        s = self.text[: self.head]
        head = [self.v.forward(s, self._first(i), len(s))[0][-1] for i in range(min(size, self.head + 1))]
        middle = sum(self.v.word(x)[1] for x in _SEGMENT.findall(self.text[self.head : self.tail]))
        tail = self.v.forward(self.text[self.tail : self.limit], [0], self.n - self.tail)[0][self.n - self.tail :][:size]
        for i, h in enumerate(head):
            for j, t in enumerate(tail):
                if h > NONE and t > NONE:
                    out[i, j] = h + middle + t
        return out

    def entries(self, prefix: list[int]) -> list[int]:
        """For each right state the left state of the best path, -1 where there is none."""
        size = self.v.reach
        if self.whole:
            s = self.text[: self.limit]
            best, back = self.v.forward(s, prefix, self.n)
            ends = [self.n + j for j in range(size) if self.n + j <= len(s)]
            found = [self.v.traced(s, back, e)[1] if best[e] > NONE else -1 for e in ends]
            return found + [-1] * (size - len(found))
        s = self.text[: self.head]
        _, back = self.v.forward(s, prefix, len(s))
        return [self.v.traced(s, back, len(s))[1]] * size

    def ids(self, prefix: list[int], state: int) -> list[int]:
        """Ids of the pieces that begin in this chunk, on the path that leaves by `state`."""
        if self.whole:
            s = self.text[: self.limit]
            return self.v.traced(s, self.v.forward(s, prefix, self.n)[1], self.n + state)[0]
        s = self.text[: self.head]
        out = list(self.v.traced(s, self.v.forward(s, prefix, len(s))[1], len(s))[0])
        for x in _SEGMENT.findall(self.text[self.head : self.tail]):
            out += self.v.word(x)[0]
        s = self.text[self.tail : self.limit]
        back = self.v.forward(s, [0], self.n - self.tail)[1]
        return out + self.v.traced(s, back, self.n - self.tail + state)[0]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product; vectors are matrices of one row."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), NONE)


def chunk_rows(text: str, chunk: int, reach: int) -> Iterator[tuple[int, str, str, int, bool]]:
    """Number, character before, characters with those behind, length and last of every chunk."""
    s = MARK + normalised(text)
    for k, a in enumerate(range(0, len(s), chunk)):
        b = min(len(s), a + chunk)
        yield k, s[a - 1] if a else "", s[a : b + reach - 1], b - a, b == len(s)


def _safe(s: str) -> bytes:
    return s.encode("utf-8", "surrogatepass")


def _read(b: bytes) -> str:
    return b.decode("utf-8", "surrogatepass")


def load(spark: SparkSession, model: str = MODEL):
    """Broadcast of the vocabulary: the model file's pieces, read on the driver."""
    with open(model, "rb") as f:
        return spark.sparkContext.broadcast(Vocabulary(f.read()))


def groups(texts: list[str | None], most: int = 2_000_000) -> Iterator[list[str | None]]:
    """Runs of texts of at most about `most` characters."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t or "")
        if n > most:
            yield part
            part, n = [], 0
    if part:
        yield part


def _lists(sizes: np.ndarray, ids: np.ndarray, null: list[bool]) -> pa.Array:
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), mask=np.array([*null, False]))
    return pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))


def _short(docs: DataFrame, vocabulary, text: str, ids: str, size: str, checked: str | None) -> DataFrame:
    where = docs.columns.index(text)
    extra = [T.StructField(checked, T.BooleanType())] if checked else []
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(size, T.LongType()), *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary.value.batch()
        for batch in batches:
            at = 0
            for texts in groups(batch.column(where).to_pylist()):
                part = batch.slice(at, len(texts))
                at += len(texts)
                sizes, made = own.encode(texts)
                cols = [_lists(sizes, made, [t is None for t in texts]), pa.array(sizes, pa.int64())]
                if checked:
                    cols.append(pa.array([t is None or t == back for t, back in zip(texts, own.decode(sizes, made), strict=True)]))
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=schema.names)

    return docs.mapInArrow(run, schema)


def _long(texts: DataFrame, vocabulary, chunk: int) -> DataFrame:
    """digest, ids of distinct long texts (columns digest, text), by the scan over chunks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = vocabulary.value.reach
        for batch in batches:
            for digest, t in zip(batch.column(0), batch.column(1), strict=True):
                held = [(digest.as_py(), k, _safe(before), _safe(s), n, last) for k, before, s, n, last in chunk_rows(t.as_py(), chunk, reach)]
                kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.bool_())
                for a in range(0, len(held), 64):
                    cols = zip(zip(*held[a : a + 64], strict=True), kinds, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in cols], names=["digest", "k", "before", "text", "n", "last"])

    chunks = stored(texts.mapInArrow(cut, "digest string, k int, before binary, text binary, n int, last boolean"), "chunks")

    def each(batches: Iterator[pa.RecordBatch], what, kind: pa.DataType, name: str) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for batch in batches:
            made = [what(Chunk(v, _read(r["before"]), _read(r["text"]), r["n"], r["last"]), r) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, kind)], names=["digest", "k", name])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return each(batches, lambda c, r: c.matrix().ravel().tolist(), pa.list_(pa.int64()), "m")

    def square(x) -> np.ndarray:
        return np.array(x, dtype=np.int64).reshape(vocabulary.value.reach, -1)

    def block_products(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("k").to_pylist(), table.column("m").to_pylist(), strict=True))
        out = square(rows[0][1])
        for _, m in rows[1:]:
            out = product(out, square(m))
        return pa.table({"digest": [key[0].as_py()], "block": pa.array([key[1].as_py()], pa.int32()), "m": pa.array([out.ravel().tolist()], pa.list_(pa.int64()))})

    def scan(start: list[int], keys: list[int], rows: list[list[int]]) -> tuple[list[int], list[list[int]]]:
        """Scores at the left border of each matrix, in order of the keys."""
        order, now, out = sorted(range(len(keys)), key=keys.__getitem__), np.array([start], dtype=np.int64), []
        for i in order:
            out.append(now[0].tolist())
            now = product(now, square(rows[i]))
        return [keys[i] for i in order], out

    def begin() -> list[int]:
        return [0] + [NONE] * (vocabulary.value.reach - 1)

    def block_scan(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        blocks, vectors = scan(begin(), table.column("block").to_pylist(), table.column("m").to_pylist())
        return pa.table({"digest": [key[0].as_py()] * len(blocks), "block": pa.array(blocks, pa.int32()), "start": pa.array(vectors, pa.list_(pa.int64()))})

    def chunk_scan(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ks, vectors = scan(table.column("start")[0].as_py(), table.column("k").to_pylist(), table.column("m").to_pylist())
        return pa.table({"digest": [key[0].as_py()] * len(ks), "k": pa.array(ks, pa.int32()), "prefix": pa.array(vectors, pa.list_(pa.int64()))})

    m = stored(chunks.mapInArrow(matrices, "digest string, k int, m array<long>"), "matrices").withColumn("block", (F.col("k") / BLOCK).cast("int"))
    blocks = m.groupBy("digest", "block").applyInArrow(block_products, "digest string, block int, m array<long>")
    starts = blocks.groupBy("digest").applyInArrow(block_scan, "digest string, block int, start array<long>")
    prefixes = stored(m.join(starts, ["digest", "block"]).groupBy("digest", "block").applyInArrow(chunk_scan, "digest string, k int, prefix array<long>"), "chunk-scores")

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return each(batches, lambda c, r: c.entries(r["prefix"]), pa.list_(pa.int32()), "entries")

    def exits(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Right states of all chunks: the last leaves by 0, each other as the next one is entered."""
        rows = sorted(zip(table.column("k").to_pylist(), table.column("entries").to_pylist(), strict=True), reverse=True)
        now, out = 0, []
        for k, entries in rows:
            out.append((k, now))
            now = entries[now]
        return pa.table({"digest": [key[0].as_py()] * len(out), "k": pa.array([k for k, _ in out], pa.int32()), "state": pa.array([s for _, s in out], pa.int32())})

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return each(batches, lambda c, r: c.ids(r["prefix"], r["state"]), pa.list_(pa.int32()), "ids")

    known = stored(chunks.join(prefixes, ["digest", "k"]), "scored-chunks")
    states = known.mapInArrow(maps, "digest string, k int, entries array<int>").groupBy("digest").applyInArrow(exits, "digest string, k int, state int")
    done = known.join(states, ["digest", "k"]).mapInArrow(pieces, "digest string, k int, ids array<int>")
    return done.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("x")).select("digest", F.flatten("x.ids").alias("ids"))


def encode(docs: DataFrame, vocabulary, text: str = "text", ids: str = "token_ids", size: str = "n_tokens", chunk: int = CHUNK, checked: str | None = None) -> DataFrame:
    """All columns, the ids and their number. Rows of long texts are joined to their encoding by digest.

    With `checked`, a column of that name says whether decoding the ids gives the text again.
    """
    kept = docs.drop(ids, size, *([checked] if checked else []))
    digest, key = fresh(kept, "_digest", "_key")
    is_long = F.coalesce(F.char_length(F.col(f"`{text}`")) > chunk, F.lit(False))
    short = _short(kept.filter(~is_long), vocabulary, text, ids, size, checked)
    giant = kept.filter(is_long).withColumn(digest, F.md5(F.col(f"`{text}`").cast("binary")))
    texts = giant.select(F.col(digest).alias("digest"), F.col(f"`{text}`").alias("text")).dropDuplicates(["digest"])
    coded = stored(_long(texts, vocabulary, chunk).withColumnRenamed("digest", key).withColumnRenamed("ids", ids), "long-encodings")
    joined = giant.join(coded, giant[digest] == coded[key]).drop(digest, key).withColumn(size, F.size(F.col(ids)).cast("long"))
    if checked:
        (back,) = fresh(joined, "_decoded")
        joined = decode(joined, vocabulary, ids, back).withColumn(checked, F.col(back) == F.col(f"`{text}`")).drop(back)
    return short.unionByName(joined.select(*short.columns))


def decode(coded: DataFrame, vocabulary, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """All columns and the text of the ids; null ids give null."""
    kept = coded.drop(out)
    where = kept.columns.index(ids)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary.value.batch()
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                lists = part.column(where)
                sizes = lists.value_lengths().fill_null(0).to_numpy()
                made = own.decode(sizes, lists.flatten().to_numpy())
                texts = [t if there else None for t, there in zip(made, lists.is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=schema.names)

    return kept.mapInArrow(run, schema)
