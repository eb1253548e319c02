"""Connected components of an edge table, by alternating star operations.

The large star hangs every larger neighbour of a node onto the smallest node around it, the small
star does so with the smaller ones; a forest of stars is the fixed point. Each round is a few
shuffles over the edges; nothing is gathered in a task or on the driver. The minima are written
before they are joined back, so both sides of the join are plain shuffles, and a node that has
a third of all edges is split among tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.common import discard, stored


def _print(edges: DataFrame) -> tuple:
    """Count and order-free checksum of an edge set."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node that has an edge and is not its component's smallest.

    `edges` has columns u and v of one ordered type; direction, loops and repeats do not matter.
    No edges, no rows.
    """
    now = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _print(now)
    while seen[0]:
        both = now.union(now.select("v", "u"))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "minima")
        large = stored(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        discard(now, low)
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        moved = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(moved.union(low.select("u", "m")).distinct(), "edges")
        discard(large, low)
        before, seen = seen, _print(now)
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
