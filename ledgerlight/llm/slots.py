"""Sharding over fixed virtual slots.

A record's slot is a hash of its text modulo `SLOTS`, so equal texts share a slot. Which shard
holds a slot is said by a small, versioned map. Version 1 deals slots round robin; rebalancing
measures bytes per slot and writes the next version, in which only slots of overfull shards have
moved; growing by a shard moves slots into the new shard only.

A slot with more than 1/WIDE of all bytes or rows is divided into `SUBS` parts by record id. The
parts are counted and numbered apart, so no task gets a hot group whole. They stay on one shard
until the slot holds more than half of a shard's fair share of bytes; then each part is placed
alone. The map has at most SLOTS + 2 * WIDE * SUBS rows, whatever the corpus size.

Everything is DataFrame operations. Nulls: a null text is the empty text, a null id is an id like
any other. Repeated rows each keep a place of their own. An empty table gives an empty result and
a map with no rows. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlight.llm.common import stored, text_of
from ledgerlight.session import table_path

SLOTS = 4096
WIDE = 64
SUBS = 64


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, part: what placement needs, without the texts."""
    body = text_of(text)
    return docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(body), F.lit(SLOTS)).cast("int").alias("virtual_slot"),
        F.pmod(F.xxhash64(F.lit("part"), F.col(f"`{doc_id}`")), F.lit(SUBS)).cast("int").alias("part"),
    )


def divided(records: DataFrame) -> DataFrame:
    """`part` set to 0 in all but the wide slots (at most 2 * WIDE of them, so they are broadcast)."""
    per_slot = records.groupBy("virtual_slot").agg(F.sum("size").alias("_b"), F.count("*").alias("_n"))
    total, count = per_slot.agg(F.sum("_b")).scalar(), per_slot.agg(F.sum("_n")).scalar()
    wide = per_slot.filter((F.col("_b") * WIDE > total) | (F.col("_n") * WIDE > count)).select("virtual_slot", F.lit(True).alias("_wide"))
    return (
        records.join(F.broadcast(wide), "virtual_slot", "left")
        .withColumn("part", F.when(F.col("_wide"), F.col("part")).otherwise(F.lit(0)))
        .drop("_wide")
    )


def slot_bytes(records: DataFrame) -> DataFrame:
    """virtual_slot, part, bytes, rows: at most SLOTS + 2 * WIDE * SUBS rows."""
    return records.groupBy("virtual_slot", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 1: slots dealt round robin, sizes not looked at."""
    return sizes.select("virtual_slot", "part", F.pmod(F.col("virtual_slot"), F.lit(shards)).cast("int").alias("shard"))


def _edited(sizes: DataFrame, old: DataFrame, shards: int, place, start: Column) -> DataFrame:
    """Fold `place(loads, unit, share)` over the units, largest first; one row per (slot, part).

    A unit is a slot, or one part of it where the slot holds over half of a shard's fair share.
    The units are gathered into one row: they are as many as the map has rows, which is bounded.
    """
    whole = Window.partitionBy("virtual_slot")
    every = Window.partitionBy()
    placed = sizes.join(F.broadcast(old), ["virtual_slot", "part"])
    units = (
        placed.withColumn("_share", F.sum("bytes").over(every) / F.lit(shards))
        .withColumn("_alone", F.sum("bytes").over(whole) * 2 > F.col("_share"))
        .groupBy("virtual_slot", F.when(F.col("_alone"), F.col("part")).otherwise(F.lit(-1)).alias("unit"))
        .agg(F.sum("bytes").alias("bytes"), F.min("shard").alias("shard"), F.min("_share").alias("_share"))
    )
    row = units.agg(
        F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot", "unit", "shard")), asc=False).alias("units"),
        F.min("_share").alias("share"),
    )
    none = F.expr("cast(array() as array<int>)")

    def step(acc: Column, unit: Column) -> Column:
        to = place(acc["loads"], unit, F.col("share"))
        loads = F.transform(
            acc["loads"],
            lambda v, i: v + F.when(i == to, unit["bytes"]).otherwise(F.lit(0)) - F.when((i == unit["shard"]) & acc["full"], unit["bytes"]).otherwise(F.lit(0)),
        )
        return F.struct(loads.alias("loads"), F.concat(acc["to"], F.array(to)).alias("to"), acc["full"].alias("full"))

    loads = F.when(start, F.expr(f"transform(sequence(0, {shards - 1}), s -> aggregate(filter(units, u -> u.shard = s), 0L, (a, u) -> a + u.bytes))"))
    begin = F.struct(F.coalesce(loads, F.array_repeat(F.lit(0).cast("long"), shards)).alias("loads"), none.alias("to"), start.alias("full"))
    done = row.select("units", F.aggregate("units", begin, step, lambda a: a["to"]).alias("to"))
    moved = done.select(F.explode(F.arrays_zip("units", "to")).alias("z")).select("z.units.virtual_slot", "z.units.unit", F.col("z.to").alias("shard"))
    parts = sizes.select("virtual_slot", "part").join(F.broadcast(moved), "virtual_slot")
    return parts.filter((F.col("unit") == -1) | (F.col("unit") == F.col("part"))).select("virtual_slot", "part", "shard")


def rebalanced(sizes: DataFrame, old: DataFrame, shards: int) -> DataFrame:
    """The next map: a slot stays where it is while its shard has room up to the mean; the others,
    largest first, go to the emptiest shard."""

    def place(loads: Column, unit: Column, share: Column) -> Column:
        emptiest = (F.array_position(loads, F.array_min(loads)) - 1).cast("int")
        return F.when(F.element_at(loads, unit["shard"] + 1) + unit["bytes"] <= share, unit["shard"]).otherwise(emptiest)

    return _edited(sizes, old, shards, place, F.lit(False))


def grown(sizes: DataFrame, old: DataFrame, shards: int) -> DataFrame:
    """The next map with one shard more (`shards` counts it): rows move into the new shard only."""

    def place(loads: Column, unit: Column, share: Column) -> Column:
        new = F.lit(shards - 1)
        fits = F.element_at(loads, F.lit(shards)) + unit["bytes"] <= share
        return F.when(fits & (F.element_at(loads, unit["shard"] + 1) > share), new).otherwise(unit["shard"])

    return _edited(sizes, old, shards, place, F.lit(True))


def save_map(new: DataFrame, path: str, version: int) -> DataFrame:
    """Write one version of the map; versions before it stay readable."""
    at = f"{path.rstrip('/')}/version={version}"
    new.coalesce(1).write.mode("overwrite").parquet(at)
    return new.sparkSession.read.schema(new.schema).parquet(at)


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/version={version}")


def placed(records: DataFrame, slot_map: DataFrame, sizes: DataFrame) -> DataFrame:
    """Add `shard` and `slot`, the place in the shard, without gaps from 0.

    Offsets run over the bounded map; rows are numbered inside a slot's part only, which holds at
    most about 1/WIDE of all rows.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.join(F.broadcast(slot_map), ["virtual_slot", "part"]).select(
        "virtual_slot", "part", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        records.join(F.broadcast(offsets), ["virtual_slot", "part"])
        .withColumn("slot", (F.col("_before") + F.row_number().over(inside) - 1).cast("long"))
        .drop("_before")
    )


def shard_documents(docs: DataFrame, shards: int = 8, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, part, shard, slot, map_version under byte balance.

    Writes versions 1 (round robin) and 2 (rebalanced by bytes) of the slot map below `path`.
    """
    spark = docs.sparkSession
    path = path or table_path(spark, "slot-map")
    records = divided(stored(keyed(docs, doc_id, text), "slot-records"))
    sizes = stored(slot_bytes(records), "slot-sizes")
    first = save_map(first_map(sizes, shards), path, 1)
    second = save_map(rebalanced(sizes, first, shards), path, 2)
    return placed(records, second, sizes).withColumn("map_version", F.lit(2))


def write_shards(docs: DataFrame, slot_map: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the documents with all their columns below shard=N, by a map (broadcast: it is bounded).

    A column named shard is replaced.
    """
    records = docs.drop("shard").withColumns({"_slot": F.pmod(F.xxhash64(text_of(text)), F.lit(SLOTS)).cast("int"), "_part": F.pmod(F.xxhash64(F.lit("part"), F.col(f"`{doc_id}`")), F.lit(SUBS)).cast("int")})
    split = slot_map.groupBy("virtual_slot").agg(F.max("part").alias("_last"))
    at = F.broadcast(slot_map.join(split, "virtual_slot").select(F.col("virtual_slot").alias("_slot"), F.col("part").alias("_p"), F.col("shard").alias("_shard"), "_last"))
    held = records.join(at, "_slot").filter((F.col("_last") == 0) | (F.col("_p") == F.col("_part")))
    held.drop("_slot", "_part", "_p", "_last").withColumnRenamed("_shard", "shard").write.partitionBy("shard").parquet(path)
