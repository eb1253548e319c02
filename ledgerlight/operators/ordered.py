"""Ordered analytics whose groups may be far larger than one task.

A window puts a whole group into one task. These operators range-partition rows by
(group, order) instead, so a hot group spreads over many blocks, work inside each block, and
add per-block offsets (one row per group and block). The blocks are checkpointed first:
both passes, and any retry, then see the same blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.session import durable

_BLOCK = "_block"


def range_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = _BLOCK) -> DataFrame:
    """Rows range-partitioned by (keys, order) with their block number, checkpointed.

    Blocks follow the sampled distribution, so a group with a third of all rows fills about
    a third of the blocks.
    """
    spread = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    return durable(spread.withColumn(out, F.spark_partition_id()))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column] | None = None,
    row_number: str | None = None,
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Running sums (and a row number) over `order` within `keys`, whatever the group size.

    `order` must be total for a reproducible row number. `totals` maps a running column to
    the name under which its group total is added.
    """
    sums = dict(sums or {})
    if row_number:
        sums[row_number] = F.lit(1).cast("long")
    tmp = {name: f"_in_{i}" for i, name in enumerate(sums)}
    for name, expr in sums.items():
        df = df.withColumn(tmp[name], expr)
    blocks = range_blocks(df, keys, order)
    # one struct per group: its equality treats NULL keys alike, and join and window share one shuffle
    group = [F.struct(*keys).alias("_group")] if keys else []
    at = [_BLOCK, *(["_group"] if keys else [])]
    # one row per (group, block): at most groups + blocks rows
    per_block = blocks.groupBy(*keys, _BLOCK).agg(*[F.sum(c).alias(f"_sum{c}") for c in tmp.values()])
    before = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = per_block.select(
        _BLOCK,
        *group,
        *[F.coalesce(F.sum(f"_sum{c}").over(before), F.lit(0)).alias(f"_off{c}") for c in tmp.values()],
        *[F.sum(f"_sum{tmp[name]}").over(whole).alias(f"_tot{tmp[name]}") for name in (totals or {})],
    )
    joined = blocks.select("*", *group).join(offsets, at)
    inside = Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(
        *[c for c in df.columns if c not in tmp.values()],
        *[(F.col(f"_off{c}") + F.sum(c).over(inside)).alias(name) for name, c in tmp.items()],
        *[F.col(f"_tot{tmp[name]}").alias(alias) for name, alias in (totals or {}).items()],
    )


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], before: Mapping[str, str] | None = None, after: Mapping[str, str] | None = None) -> DataFrame:
    """Last non-null value up to each row, and first one from it on, within keys of any size.

    `before` and `after` map new columns to the ones they are read from. A segmented scan: blocks
    are scanned on their own, and a block hands its last (first) known value of a key on to the
    blocks after (before) it, one row per key and block. Rows of equal order are taken as they come.
    """
    before, after = dict(before or {}), dict(after or {})
    blocks = range_blocks(df, keys, [F.col(f"`{c}`") for c in order])
    group = F.struct(*[F.col(f"`{k}`") for k in keys]) if keys else F.lit(0)
    blocks = blocks.withColumn("_group", group)
    place = F.struct(*[F.col(f"`{c}`") for c in order])
    ends = {n: F.max_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), place)) for n, c in before.items()}
    ends |= {n: F.min_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), place)) for n, c in after.items()}
    per_block = blocks.groupBy("_group", _BLOCK).agg(*[e.alias(f"_end{i}") for i, e in enumerate(ends.values())])
    until = (Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_group").orderBy(_BLOCK).rowsBetween(*until)
    later = Window.partitionBy("_group").orderBy(F.desc(_BLOCK)).rowsBetween(*until)
    # the next value is the last one seen from the other end: a growing frame costs one step a row
    handed = [F.last(f"_end{i}", True).over(earlier if n in before else later).alias(f"_from{i}") for i, n in enumerate(ends)]
    joined = blocks.join(per_block.select("_group", _BLOCK, *handed), ["_group", _BLOCK])
    sofar = (Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(_BLOCK, "_group").orderBy(*[F.asc(f"`{c}`") for c in order]).rowsBetween(*sofar)
    back = Window.partitionBy(_BLOCK, "_group").orderBy(*[F.desc(f"`{c}`") for c in order]).rowsBetween(*sofar)
    found = [F.last(F.col(f"`{c}`"), True).over(w) for cols, w in ((before, ahead), (after, back)) for c in cols.values()]
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[F.coalesce(x, f"_from{i}").alias(n) for i, (n, x) in enumerate(zip(ends, found))])


def global_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "rank") -> DataFrame:
    """Exact row number within `keys` for groups of any size."""
    return running(df, keys, order, row_number=out)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First k rows per group; each task cuts to k before the shuffle (window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


#: Rank accuracy of the sketch that brackets a quantile, and the bracket's half width in ranks (of n).
SKETCH = 10_000
HALF = 4 / SKETCH
#: Groups up to this size are bracketed by nothing: so few ranks either side would not hold the neighbours.
WHOLE = 20_000


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per group, one output column per entry of `probs`.

    A sketch gives a bracket around every quantile of a large group; a second pass counts the values
    below each bracket and, value by value, those inside it, which are under a thousandth of the rows.
    The brackets go to every task (one small row for `WHOLE` rows of input at most), so no group's
    rows meet in one: only the counts are shuffled and sorted. Adds `n`, the non-null count.
    """
    known = df.select(*keys, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    # one struct as the key: NULL keys meet as well
    known = known.select((F.struct(*keys) if keys else F.lit(0)).alias("_g"), "_v")
    edges = [q for p in probs.values() for q in (max(0.0, p - HALF), min(1.0, p + HALF))]
    sketch = F.percentile_approx("_v", [float(q) for q in edges], SKETCH)
    brackets = known.groupBy("_g").agg(F.count("*").alias("n"), sketch.alias("_e")).filter(F.col("n") > WHOLE)
    at = F.array(*[F.struct(F.lit(i).alias("q"), F.col("_e")[2 * i].alias("lo"), F.col("_e")[2 * i + 1].alias("hi")) for i in range(len(probs))])
    joined = known.join(F.broadcast(brackets), "_g", "left")
    near = joined.select("_g", "n", "_v", F.explode(at).alias("_b")).filter(F.col("_b.hi").isNull() | (F.col("_v") <= F.col("_b.hi")))
    inside = F.when(F.col("_b.lo").isNull() | (F.col("_v") >= F.col("_b.lo")), F.col("_v"))
    counts = near.groupBy("_g", "n", F.col("_b.q").alias("q"), inside.alias("_v")).agg(F.count("*").alias("_n"))
    # a group without brackets has all its values here
    counts = counts.withColumn("n", F.coalesce("n", F.sum("_n").over(Window.partitionBy("_g", "q"))))
    return quantiles_of_counts(counts, probs).select(*[F.col("_g")[k].alias(k) for k in keys], "n", *probs)


def quantiles_of_counts(counts: DataFrame, probs: Mapping[str, float]) -> DataFrame:
    """(_g, n, one column per entry of `probs`) from counts of values near each quantile.

    `counts` holds (_g, n, q, _v, _n): for group `_g` of `n` values and the q-th probability, `_n`
    values equal `_v`; the row without `_v` counts all values below those listed.
    """
    order = Window.partitionBy("_g", "q").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_cum", F.sum("_n").over(order))
    aggs = [F.first("n").alias("n")]
    for i, (name, p) in enumerate(probs.items()):
        pos = (F.col("n") - 1) * F.lit(float(p))
        here = (F.col("q") == i) & F.col("_v").isNotNull()
        aggs.append(F.min(F.when(here & (F.col("_cum") > F.floor(pos)), F.col("_v"))).alias(f"_lo_{name}"))
        aggs.append(F.min(F.when(here & (F.col("_cum") > F.ceil(pos)), F.col("_v"))).alias(f"_hi_{name}"))
    grouped = ranked.groupBy("_g").agg(*aggs)
    out = []
    for name, p in probs.items():
        pos = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        missed = F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")
        out.append(F.when(lo.isNull() | hi.isNull(), missed).otherwise(lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return grouped.select("_g", "n", *out)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first by `order`; combines on the map side, so hot keys are cheap."""
    rest = [c for c in df.columns if c not in keys]
    fields = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*fields)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)
