"""SimHash near copies through BK-trees.

A text's fingerprint has a bit for each bit that more than half of its word shingles' hashes set.
Only distinct fingerprints are compared. Two that differ in at most `RADIUS` = 4 bits agree in at
least two of six bands, so each goes to the shards of its 15 band pairs, and every link is found
in at least one shard. A shard is a BK-tree: a child hangs on its parent by their Hamming distance
d, and a query with distance q to a node follows the edges from q - 4 to q + 4 only. The trees of
many shards are built and searched side by side, level by level, in numpy.

A shard of more than `TREE` fingerprints is cut into blocks by hash; each block's tree is sent to
the queries of every block of that shard, in tasks of their own, so no task holds more than two
blocks. A shard returns each member with the smallest member it is linked to, directly or through
others: rows grow with members, never with pairs. Components over these edges follow in
`components`.

Texts without words (null, empty, blank) have fingerprint zero and are linked like any other.
Equal rows share a fingerprint. A null id is never a component's id unless all ids of it are null.
An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.llm.common import fresh, stored
from ledgerlight.llm.components import components

SHINGLE = 4
SEED = 42
RADIUS = 4
TREE = 4096
#: Rows of whole shards that a task works on together, and query-node pairs looked at together.
TOGETHER = 100_000
PAIRS = 2_000_000

_LANES = np.uint64(0x0101010101010101)


def _masks() -> list[int]:
    """The 15 pairs of six bands of 11, 11, 11, 11, 10 and 10 bits."""
    edges = [0, 11, 22, 33, 44, 54, 64]
    bands = [(1 << b) - (1 << a) for a, b in itertools.pairwise(edges)]
    return [a | b for a, b in itertools.combinations(bands, 2)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hashes_of(text: str | None, k: int = SHINGLE) -> list[int]:
    """XXH64 of every k-word shingle of the lower-cased text, repeats included."""
    words = text.encode().lower().split() if text else []  # bytes: ASCII letters and white space only
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[k - 1 :], strict=False)]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of hashes; `sizes` are the runs' lengths, 0 gives 0."""
    out = np.zeros(len(sizes), dtype=np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    n, ends = sizes[some], np.cumsum(sizes[some])
    blocks = -(-n // 255)  # byte lanes count to 255
    first = np.cumsum(blocks) - blocks
    starts = np.arange(blocks.sum()) - np.repeat(first, blocks)
    starts = starts * 255 + np.repeat(ends - n, blocks)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, starts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            out[some] |= (counts[:, byte] * 2 > n).astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """All columns but the text, and the fingerprint as a long; an input column of that name is replaced."""
    kept = docs.drop(out)
    names = [c for c in kept.columns if c != text]
    where = kept.columns.index(text)
    schema = T.StructType([*(kept.schema[c] for c in names), T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, hashes, sizes = [], [], []
            for t in batch.column(where):
                got = hashes_of(t.as_py())
                hashes.append(np.array(got, dtype=np.uint64))
                sizes.append(len(got))
                if sum(sizes) > 4 * TOGETHER:
                    prints.append(majority(np.concatenate(hashes), np.array(sizes)))
                    hashes, sizes = [], []
            if sizes:
                prints.append(majority(np.concatenate(hashes), np.array(sizes)))
            found = np.concatenate(prints).view(np.int64) if prints else np.zeros(0, dtype=np.int64)
            cols = [c for i, c in enumerate(batch.columns) if i != where]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(found, pa.int64())], names=[*names, out])

    return kept.mapInArrow(run, schema)


class Forest:
    """BK-trees of several shards: `shard` numbers the shard of each fingerprint, in order."""

    def __init__(self, prints: np.ndarray, shard: np.ndarray):
        self.prints = prints
        n = len(prints)
        up = np.full(n, -1, dtype=np.int64)  # parent of a placed node
        edge = np.zeros(n, dtype=np.int64)  # its distance to the parent
        rest = np.arange(n)
        group, dist = shard.astype(np.int64), np.zeros(n, dtype=np.int64)
        below = np.full(n, -1, dtype=np.int64)  # node under which an open item stands
        self.roots: np.ndarray | None = None
        while len(rest):
            key = group * 65 + dist
            _, firsts, of = np.unique(key, return_index=True, return_inverse=True)
            nodes = rest[firsts]
            up[nodes], edge[nodes] = below[firsts], dist[firsts]
            if self.roots is None:
                self.roots = nodes
            more = np.ones(len(rest), dtype=bool)
            more[firsts] = False
            below = nodes[of][more]
            rest = rest[more]
            group = below
            dist = np.bitwise_count(prints[rest] ^ prints[below]).astype(np.int64)
        # children sorted by (parent, distance), so that a range of distances is a slice
        child = np.flatnonzero(up >= 0)
        order = np.lexsort((edge[child], up[child]))
        self.child = child[order]
        self.key = up[self.child] * 65 + edge[self.child]

    def links(self, queries: np.ndarray, tree: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query number, node) for all nodes within the radius; `tree` numbers the root of each query."""
        at, node = np.arange(len(queries)), self.roots[tree]
        while len(at):
            dist = np.bitwise_count(queries[at] ^ self.prints[node]).astype(np.int64)
            near = dist <= radius
            yield at[near], node[near]
            low = np.searchsorted(self.key, node * 65 + np.maximum(dist - radius, 0))
            high = np.searchsorted(self.key, node * 65 + np.minimum(dist + radius, 64), side="right")
            n = high - low
            at = np.repeat(at, n)
            node = self.child[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest-member labels after the links a-b."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while not np.array_equal(label, jumped := label[label]):
            label = jumped


def shard_edges(prints: np.ndarray, shard: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(u, v) for members linked within their shards. role: 0 in the tree and a query, 1 tree only, 2 query only.

    Rows are in the order of shards, numbered from 0.
    """
    label = np.arange(len(prints))
    member, asks = np.flatnonzero(role != 2), np.flatnonzero(role != 1)
    has = np.unique(shard[member])
    number = np.full(int(shard.max()) + 1, -1, dtype=np.int64)
    number[has] = np.arange(len(has))
    asks = asks[number[shard[asks]] >= 0]
    forest = Forest(prints[member], number[shard[member]])
    sizes = np.bincount(number[shard[member]], minlength=len(has))
    load = np.cumsum(sizes[number[shard[asks]]])
    start = 0
    while start < len(asks):
        stop = max(start + 1, int(np.searchsorted(load, (load[start - 1] if start else 0) + PAIRS, side="right")))
        part = asks[start:stop]
        for q, node in forest.links(prints[part], number[shard[part]]):
            label = join_labels(label, part[q], member[node])
        start = stop
    moved = label != np.arange(len(prints))
    return prints[moved], prints[label[moved]]


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of the shards of a partition sorted by shard; whole shards are gathered up to TOGETHER rows."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def done(parts: list) -> Iterator[pa.RecordBatch]:
        prints, ids, role = (np.concatenate(x) for x in zip(*parts, strict=True))
        change = np.any(ids[1:] != ids[:-1], axis=1)
        u, v = shard_edges(prints.view(np.uint64), np.concatenate(([0], np.cumsum(change))), role)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    for batch in batches:
        pair, key, i, j, role, prints = (c.to_numpy() for c in batch.columns)
        if len(prints):
            held.append((prints, np.stack([pair, key, i, j], axis=1), role))
        if sum(len(x[0]) for x in held) > TOGETHER:
            prints, ids, role = (np.concatenate(x) for x in zip(*held, strict=True))
            last = np.flatnonzero(np.any(ids != ids[-1], axis=1))
            cut = last[-1] + 1 if len(last) else 0  # the last shard may go on in the next batch
            if cut:
                yield from done([(prints[:cut], ids[:cut], role[:cut])])
            held = [(prints[cut:], ids[cut:], role[cut:])]
    if held and len(held[0][0]):
        yield from done(held)


def links(prints: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """u, v: edges whose components are those of all links among the distinct fingerprints."""
    masks = F.array(*[F.struct(F.lit(n).alias("pair"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for n, m in enumerate(_masks())])
    keyed = prints.select(F.col(fingerprint).alias("fp")).select("fp", F.explode(masks).alias("s")).select("s.pair", "s.key", "fp")
    sizes = keyed.groupBy("pair", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shards = stored(sizes.withColumn("blocks", F.ceil(F.col("n") / TREE).cast("int")), "shards")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # a block meets itself once and every other block of its shard once
    spread = keyed.join(shards, ["pair", "key"]).select("pair", "key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    role = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    rows = spread.select("pair", "key", i.alias("i"), j.alias("j"), role.alias("role"), "fp")
    at = ["pair", "key", "i", "j"]
    return rows.repartition(*at).sortWithinPartitions(*at, "fp").mapInArrow(_searched, "u long, v long").distinct()


def near_copies(prints: DataFrame, doc_id: str = "doc_id", fingerprint: str = "fingerprint") -> DataFrame:
    """fingerprint, root, component_id per distinct fingerprint: its component's smallest fingerprint
    (which tells components apart, whatever the ids) and the smallest id reachable over links."""
    every = stored(prints.groupBy(F.col(fingerprint).alias("fingerprint")).agg(F.min(doc_id).alias("first")), "fingerprints")
    roots = components(links(every))
    labelled = stored(
        every.join(roots, every["fingerprint"] == roots["node"], "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")), "labelled"
    )
    smallest = stored(labelled.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    return stored(labelled.join(smallest, "root").select("fingerprint", "root", "component_id"), "components")


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id of every row. Both sides of the last join are stored, so
    a fingerprint that very many rows share is split among tasks."""
    prints = stored(fingerprints(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))), "document-fingerprints")
    return prints.join(near_copies(prints).drop("root"), "fingerprint")


def row_hashes(docs: DataFrame, one: str, two: str) -> list[Column]:
    """Two hashes of a row's every column, under these names."""
    return [F.xxhash64(F.lit(s), *[F.col(f"`{c}`") for c in docs.columns]).alias(name) for s, name in ((1, one), (2, two))]


def first_rows(docs: DataFrame, rows: DataFrame, h: list[Column], one: str, two: str) -> DataFrame:
    """The documents that stay: of each root of `rows` the smallest id, then the smallest row hash."""
    picked = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", one, two, "n")).alias("pick"))
    keep = stored(picked.select(f"pick.{one}", f"pick.{two}", "pick.n"), "picked")
    hashed = docs.select("*", *h)
    alone = hashed.join(keep.filter("n = 1"), [one, two], "left_semi")
    equal = hashed.join(keep.filter("n > 1"), [one, two], "left_semi").dropDuplicates([one, two])
    return alone.unionByName(equal).select(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group stays: the smallest id, then the smallest row hash; of rows equal
    in all columns, one. The texts move through one shuffle."""
    one, two = fresh(docs, "_h1", "_h2")
    h = row_hashes(docs, one, two)
    thin = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), *h)
    prints = stored(fingerprints(thin), "document-fingerprints")
    rows = prints.groupBy("fingerprint", one, two, "doc_id").agg(F.count("*").alias("n"))
    return first_rows(docs, rows.join(near_copies(prints), "fingerprint"), h, one, two)
