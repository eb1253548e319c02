"""URL filters: host rules, and character language models for the addresses that no rule names.

A rule is a host and a path prefix with a verdict; it fits its host and all subdomains if the path
starts with the rule's. The longest rule wins (ties: the longer host, then block). Addresses
judged by a rule are the accepted and the rejected ones two Markov models learn from, each distinct
address once. The models read addresses without what the rules look at (the domain a rule names,
the path it names), else they would only repeat the rules for addresses that no rule is about.

The models have variable order: the next byte's probability is that after the longest context that
was seen, mixed by Witten-Bell weights with those after its shorter ends, down to the uniform one.
Counts cover all judged addresses; tasks sum them before the shuffle. Every gram counts: up to `WHOLE`
of them are sent to the tasks; with more, the chances of the windows that occur are found by joins,
one gram length after the other, and each block of addresses gets those of its own windows.

An address's score is the difference of the log-likelihoods under both models over its length. The
threshold is calibrated: the models of four fifths of the judged addresses score the last fifth,
and the score with the best mean of both classes' shares of right verdicts is taken (ties: the one
nearest to zero). Without both classes it is zero. An address is allowed if its score reaches the
threshold; null and empty ones are blocked. Addresses without "://" have an empty host and path and
fit no rule. Null ids and repeated rows are rows like any other; very long addresses are read whole;
extra columns stay, and result columns replace input columns of their names. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.llm.common import fresh, stored

ALLOW, BLOCK = "allow", "block"
ORDER = 5
GRAMS = 1 << 15
#: Grams of both classes that are sent to the tasks, and addresses of a block that is scored by joins.
WHOLE, BLOCK_TEXTS = 100_000, 20_000
#: Rules are one expression, so their number is bounded.
MOST_RULES = 1000
#: Distinct grams a task sums before it hands them on, and windows a worker remembers.
TOGETHER, REMEMBER = 300_000, 300_000
#: Steps of the threshold.
STEPS = 100
_FOLDS = 5
_START, _END = b"\x02", b"\x03"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @classmethod
    def parse(cls, text: str, verdict: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(host, slash + path, verdict)


def _rest(url: Column) -> Column:
    """What follows the first "://"; null without it."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _inside(host: Column, domain: str) -> Column:
    return (host == domain) | host.endswith(f".{domain}")


def ordered(rules: Sequence[Rule]) -> list[Rule]:
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host), r.verdict != BLOCK, r))


def ruled(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The rule that wins as a struct of rule and verdict; null if none fits."""
    kind = T.StructType.fromDDL("rule string, verdict string")
    cases = [F.when(_inside(host, r.host) & path.startswith(r.path), F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in ordered(rules)]
    return F.coalesce(*cases, F.lit(None).cast(kind))


def unmarked(url: Column, host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """What the models read: the address after its scheme without the domain and path that rules name."""
    hosts = sorted({r.host for r in rules if r.host}, key=lambda h: (-len(h), h))
    paths = sorted({r.path for r in rules if r.path}, key=lambda p: (-len(p), p))
    cut = reduce(lambda c, h: c.when(_inside(host, h), F.length(host) - len(h)), hosts, F.when(F.lit(False), F.lit(0))).otherwise(F.length(host))
    skip = reduce(lambda c, p: c.when(path.startswith(p), F.lit(len(p))), paths, F.when(F.lit(False), F.lit(0))).otherwise(F.lit(0))
    after = F.substring(_rest(url), F.length(host) + skip + 1, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.concat(F.substring(host, F.lit(1), cut), after)).otherwise(url)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """accepted, held, gram, n of (text, accepted, held)."""
    sums: dict[tuple[bool, bool], Counter] = {}

    def done() -> pa.RecordBatch:
        rows = [(a, h, g, n) for (a, h), c in sums.items() for g, n in c.items()]
        sums.clear()
        types = (pa.bool_(), pa.bool_(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["accepted", "held", "gram", "n"])

    for batch in batches:
        for text, accepted, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = _START + text.encode() + _END
            own = sums.setdefault((accepted, held), Counter())
            for size in range(1, ORDER + 2):
                own.update(data[i : i + size] for i in range(size == 1, len(data) - size + 1))  # the start is never next
            if sum(map(len, sums.values())) > TOGETHER:
                yield done()
    if sums:
        yield done()


def learn(examples: DataFrame) -> DataFrame:
    """accepted, held, gram, n over all rows of (text string, accepted boolean, held boolean)."""
    rows = examples.select("text", "accepted", "held").filter("text is not null and accepted is not null and held is not null")
    parts = rows.mapInArrow(_counted, "accepted boolean, held boolean, gram binary, n long")
    return parts.groupBy("accepted", "held", "gram").agg(F.sum("n").alias("n"))


class Markov:
    """A variable-order model of one class."""

    def __init__(self, grams: dict[bytes, int]):
        self.grams = grams
        self.total: Counter = Counter()
        self.kinds: Counter = Counter()
        for gram, n in grams.items():
            self.total[gram[:-1]] += n
            self.kinds[gram[:-1]] += 1

    def chance(self, window: bytes) -> float:
        """Probability of the window's last byte after the others."""
        p = 1 / 256
        for start in range(len(window) - 1, -1, -1):
            context = window[start:-1]
            total = self.total.get(context)
            if total is None:
                break  # longer contexts were seen no more often
            kinds = self.kinds[context]
            p = (self.grams.get(window[start:], 0) + kinds * p) / (total + kinds)
        return p


class Ratio:
    """Accepted against rejected."""

    def __init__(self, accepted: dict[bytes, int], rejected: dict[bytes, int]):
        self.accepted, self.rejected = Markov(accepted), Markov(rejected)
        self.memory: dict[bytes, float] = {}

    @classmethod
    def gather(cls, counts: DataFrame) -> Ratio:
        """A bounded model on the driver: grams with at least 1/GRAMS of their length's occurrences in
        their class, so at most 2 x (ORDER + 1) x GRAMS. `with_scores` uses all grams instead."""
        sized = counts.groupBy("accepted", "gram").agg(F.sum("n").alias("n")).withColumn("size", F.length("gram"))
        totals = {(r["accepted"], r["size"]): r["n"] for r in sized.groupBy("accepted", "size").agg(F.sum("n").alias("n")).collect()}
        least = reduce(lambda c, x: c.when((F.col("accepted") == x[0][0]) & (F.col("size") == x[0][1]), F.lit(-(-x[1] // GRAMS))), sorted(totals.items()), F.when(F.lit(False), F.lit(0)))
        found: dict[bool, dict[bytes, int]] = {True: {}, False: {}}
        if totals:
            for r in sized.filter(F.col("n") >= least).collect():
                found[r["accepted"]][bytes(r["gram"])] = r["n"]
        return cls(found[True], found[False])

    @classmethod
    def whole(cls, counts: DataFrame) -> Ratio | None:
        """All grams on the driver; None if there are more than `WHOLE`."""
        rows = counts.groupBy("accepted", "gram").agg(F.sum("n").alias("n")).limit(WHOLE + 1).collect()
        if len(rows) > WHOLE:
            return None
        found: dict[bool, dict[bytes, int]] = {True: {}, False: {}}
        for r in rows:
            found[r["accepted"]][bytes(r["gram"])] = r["n"]
        return cls(found[True], found[False])

    def score(self, text: str) -> float:
        """Log-likelihood difference per byte, the end included."""
        data, total = _START + text.encode() + _END, 0.0
        if len(self.memory) > REMEMBER:
            self.memory = {}
        for i in range(1, len(data)):
            window = data[max(0, i - ORDER) : i + 1]
            if (x := self.memory.get(window)) is None:
                x = self.memory[window] = math.log(self.accepted.chance(window) / self.rejected.chance(window))
            total += x
        return total / (len(data) - 1)


def scored(df: DataFrame, ratio: Ratio, text: str, out: str) -> DataFrame:
    """Add the score of a text column; null for null."""
    model = df.sparkSession.sparkContext.broadcast((ratio.accepted.grams, ratio.rejected.grams))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
    where = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ratio(*model.value)
        for batch in batches:
            found = [None if t is None else own.score(t) for t in batch.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def _windows_of(text: str) -> list[bytes]:
    """The window that ends with each byte after the start."""
    data = _START + text.encode() + _END
    return [data[max(0, i - ORDER) : i + 1] for i in range(1, len(data))]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, window of (block, text), most repeats gone."""
    found: set[tuple[int, bytes]] = set()

    def done() -> pa.RecordBatch:
        blocks, windows = zip(*found, strict=True)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(windows, pa.binary())], names=["block", "window"])

    for batch in batches:
        for block, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found.update((block, w) for w in _windows_of(text))
            if len(found) > TOGETHER:
                yield done()
    if found:
        yield done()


def window_ratios(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """window, ratio: `Markov.chance` under both models over all grams, as joins.

    A gram's chance needs that of the gram without its first byte, so lengths follow one another; no
    key of these joins has more than 256 partners.
    """
    tail = "transform(sequence(1, length(window)), k -> substring(window, k, length(window) - k + 1))"
    context = F.expr("substring(gram, 1, length(gram) - 1)")
    need = windows.select(F.explode(F.expr(tail)).alias("gram")).distinct().withColumn("context", context)
    sides = {"a": F.col("accepted"), "r": ~F.col("accepted")}
    seen = counts.groupBy("gram").agg(*[F.sum(F.when(own, F.col("n"))).alias(f"n_{s}") for s, own in sides.items()])
    after = seen.groupBy(context.alias("context")).agg(*[f(f"n_{s}").alias(f"{name}_{s}") for s in sides for name, f in (("total", F.sum), ("kinds", F.count))])
    known = stored(need.join(seen, "gram", "left").join(after, "context", "left"), "gram-statistics")
    levels: list[DataFrame] = []
    for size in range(1, ORDER + 2):
        here = known.filter(F.length("gram") == size)
        if levels:
            here = here.withColumn("rest", F.expr("substring(gram, 2)")).join(levels[-1].withColumnRenamed("gram", "rest"), "rest")
        else:
            here = here.withColumns({f"p_{s}": F.lit(1 / 256) for s in sides})
        mixed = {}
        for s in sides:
            n, p, total, kinds = F.coalesce(F.col(f"n_{s}"), F.lit(0)), F.col(f"p_{s}"), F.col(f"total_{s}"), F.col(f"kinds_{s}")
            mixed[f"p_{s}"] = F.when(total.isNull(), p).otherwise((n + kinds * p) / (total + kinds))
        levels.append(stored(here.withColumns(mixed).select("gram", *mixed), "gram-chances"))
    return reduce(DataFrame.unionByName, levels).select(F.col("gram").alias("window"), F.log(F.col("p_a") / F.col("p_r")).alias("ratio"))


def _block_scores(texts: pa.Table, ratios: pa.Table) -> pa.Table:
    """text, score of one block."""
    own = dict(zip(ratios.column("window").to_pylist(), ratios.column("ratio").to_pylist(), strict=True))
    found, scores = texts.column("text").to_pylist(), []
    for text in found:
        windows = _windows_of(text)
        scores.append(sum(map(own.__getitem__, windows)) / len(windows))
    return pa.table({"text": pa.array(found, pa.string()), "score": pa.array(scores, pa.float64())})


def joined_scores(df: DataFrame, counts: DataFrame, text: str, out: str) -> DataFrame:
    """`scored` over any number of grams; each distinct text is scored once."""
    texts = stored(df.select(F.col(f"`{text}`").alias("text")).filter("text is not null").distinct(), "distinct-addresses")
    block = F.pmod(F.xxhash64("text"), F.lit(-(-texts.count() // BLOCK_TEXTS) or 1)).alias("block")
    texts = texts.select(block, "text")
    windows = stored(texts.mapInArrow(_windows, "block long, window binary").distinct(), "address-windows")
    ratios = windows.join(window_ratios(windows, counts), "window").select("block", "window", "ratio")
    scores = texts.groupBy("block").cogroup(ratios.groupBy("block")).applyInArrow(_block_scores, "text string, score double")
    key = fresh(df, "_key")[0]
    scores = stored(scores.toDF(key, out), "address-scores")
    return df.join(scores, F.col(f"`{text}`") == F.col(key), "left").drop(key)


def with_scores(df: DataFrame, counts: DataFrame, text: str, out: str) -> DataFrame:
    """Add the score of a text column from all grams; null for null."""
    ratio = Ratio.whole(counts)
    return joined_scores(df, counts, text, out) if ratio is None else scored(df, ratio, text, out)


def calibrated(held: DataFrame) -> float:
    """The threshold for rows of (accepted boolean, score double)."""
    at = F.floor(F.col("score") * STEPS).cast("long")  # steps are bounded by the models' smallest chance
    counts = {(r["accepted"], r["at"]): r["n"] for r in held.groupBy("accepted", at.alias("at")).agg(F.count("*").alias("n")).collect()}
    all_a, all_r = (sum(n for (a, _), n in counts.items() if a == side) for side in (True, False))
    if not all_a or not all_r:
        return 0.0
    best, threshold, below_a, below_r = -1.0, 0.0, 0, 0
    steps = sorted({x for _, x in counts})
    for x in [*steps, steps[-1] + 1]:
        right = (all_a - below_a) / all_a + below_r / all_r
        if (right, -abs(x)) > (best, -abs(threshold * STEPS)):
            best, threshold = right, x / STEPS
        below_a += counts.get((True, x), 0)
        below_r += counts.get((False, x), 0)
    return threshold


def judged(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """Add host, path, rule, verdict and score to every row."""
    kept = pages.drop("host", "path", "rule", "verdict", "score")
    hit, text = fresh(kept, "_hit", "_text")
    address = F.col(f"`{url}`").cast("string")
    rows = kept.withColumns({"host": host_of(address), "path": path_of(address)})
    rows = rows.withColumns({hit: ruled(F.col("host"), F.col("path"), rules), text: unmarked(address, F.col("host"), F.col("path"), rules)})
    known = rows.filter(F.col(hit).isNotNull()).select(F.col(text).alias("text"), (F.col(f"{hit}.verdict") == ALLOW).alias("accepted")).distinct()
    known = stored(known.withColumn("held", F.pmod(F.xxhash64("text"), F.lit(_FOLDS)) == 0), "judged-addresses")
    counts = stored(learn(known), "address-grams")
    threshold = calibrated(with_scores(known.filter("held"), counts.filter("not held"), "text", "score"))
    out = with_scores(rows, counts, text, "score")
    by_model = F.when((F.coalesce(F.length(address), F.lit(0)) > 0) & (F.col("score") >= threshold), ALLOW).otherwise(BLOCK)
    out = out.withColumns({"rule": F.col(f"{hit}.rule"), "verdict": F.coalesce(F.col(f"{hit}.verdict"), by_model)})
    return out.select(*[F.col(f"`{c}`") for c in kept.columns], "host", "path", "rule", "verdict", "score")
