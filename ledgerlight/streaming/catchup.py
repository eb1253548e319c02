"""New filings, latest facts and period prices as streams."""

from __future__ import annotations

import threading
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.operators.ordered import keep_first
from ledgerlight.schema import HISTORY_KEY
from ledgerlight.session import delete_paths, table_path


# state on local disk with changes in the checkpoint folder: its size is not bounded by memory
STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
#: Parts of an upserted table.
BUCKETS = 64
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Held while a stream starts: two that are started together must not take each other's setting.
_STARTING = threading.Lock()


def read_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet file stream of a folder's files that match `name`."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def store_new_filings(headers: DataFrame, known: str, path: str, key: str = "adsh") -> DataFrame:
    """Run a header stream over everything available; each filing not known is stored once.

    Nothing is dropped for being late. Every micro-batch reads the table at `known` again, takes
    one row per filing (the smallest) and leaves out what is known or was stored by an earlier
    batch. A batch that is run again replaces its own folder. A later run with the same `path`
    goes on where the last one ended. Returns all rows stored so far.
    """
    spark = headers.sparkSession
    rest = [c for c in headers.columns if c != key]
    rows = T.StructType([*headers.schema.fields, T.StructField("batch", T.LongType())])
    spark.createDataFrame([], headers.schema).write.mode("ignore").parquet(f"{path}/rows/batch=-1")

    def stored() -> DataFrame:
        return spark.read.schema(rows).parquet(f"{path}/rows")

    def store(batch: DataFrame, batch_id: int) -> None:
        once = keep_first(batch, [key], [F.col(c) for c in rest])
        seen = spark.read.parquet(known).select(key).union(stored().filter(F.col("batch") < batch_id).select(key))
        once.join(seen, key, "left_anti").select(*headers.columns).write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    query = headers.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(store).start()
    query.awaitTermination()
    return stored().drop("batch")


def latest_facts(facts: DataFrame, keys: Sequence[str] = HISTORY_KEY) -> DataFrame:
    """Newest fact of each item so far; a late older fact does not overwrite (update mode).

    Every item stays in the state, so run it with a state store on disk, as `drain` does.
    """
    newest = F.max(F.struct("ddate", "value"))
    g = facts.groupBy(*keys).agg(newest.alias("_m"))
    return g.select(*keys, F.col("_m.ddate").alias("crt_ddate"), F.col("_m.value").alias("crt_value"))


def read_upserted(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a table of `upsert_latest`, from the newest version of each part."""
    return _parts(spark, path, schema, _map_of(spark, path)[1])


def _map_of(spark: SparkSession, path: str, before: int | None = None) -> tuple[int, dict[int, int]]:
    """The newest map, of a batch before the given one: its batch, and the batch of each part."""
    maps = spark.read.schema("bucket int, at long, batch long").parquet(f"{path}/map")
    maps = maps if before is None else maps.filter(F.col("batch") < before)
    # a map has one row for each bucket, and two maps are kept
    rows = maps.collect()
    newest = max((r["batch"] for r in rows), default=-1)
    return newest, {r["bucket"]: r["at"] for r in rows if r["batch"] == newest}


def _part(path: str, bucket: int, at: int) -> str:
    return f"{path}/parts/batch={at}/bucket={bucket}"


def _parts(spark: SparkSession, path: str, schema: T.StructType, at: dict[int, int]) -> DataFrame:
    if not at:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[_part(path, b, a) for b, a in sorted(at.items())])


def upsert_latest(stream: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Run a stream over everything available into a table of each key's newest row; returns its rows.

    The table lies in parts by key hash. A micro-batch is reduced to one row a key, reads the parts
    that it touches, and writes those anew below a folder of its own. Then a map is written that
    names each part's folder, a single small file: before it the old table is whole, after it the
    new one. A batch that is run again starts from the map before it. Versions that neither of the
    last two maps names are deleted, so files grow with keys and not with batches; a reader has to
    be done within two batches. Later runs with the same `path` and `buckets` go on. Choose
    `buckets` so that a part fits a task. Newest is the largest by `order`; ties go to the largest
    of the other columns. Null keys are keys.
    """
    spark, schema = stream.sparkSession, stream.schema
    rest = [c for c in schema.names if c not in keys and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("_r")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")
    spark.createDataFrame([], "bucket int, at long").write.mode("ignore").parquet(f"{path}/map/batch=-1")

    def newest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("bucket", *keys).agg(best).select("bucket", *keys, "_r.*")

    def store(batch: DataFrame, batch_id: int) -> None:
        last, at = _map_of(spark, path, batch_id)
        made = newest(batch.select("*", bucket)).persist()  # used twice; a lost copy is made again
        touched = [r["bucket"] for r in made.select("bucket").distinct().collect()]  # at most `buckets`
        old = _parts(spark, path, schema, {b: at[b] for b in touched if b in at}).select("*", bucket)
        # dealt by part, so the grouping by part and key needs no shuffle of its own
        both = newest(old.unionByName(made).repartition("bucket"))
        both.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/parts/batch={batch_id}")
        now = {**at, **dict.fromkeys(touched, batch_id)}
        spark.createDataFrame(sorted(now.items()), "bucket int, at long").coalesce(1).write.mode("overwrite").parquet(f"{path}/map/batch={batch_id}")
        made.unpersist()
        past, before = _map_of(spark, path, last) if last >= 0 else (last, {})
        gone = [_part(path, b, a) for b, a in before.items() if at[b] != a]
        delete_paths(spark, *gone, *([f"{path}/map/batch={past}"] if past >= 0 else []))

    query = stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(store).start()
    query.awaitTermination()
    return read_upserted(spark, path, schema)


def period_last(events: DataFrame, key: str, ts: str, value: str, width: str = "1 day", delay: str = "1 hour", tiebreak: str | None = None) -> DataFrame:
    """Last value and row count of each key and window; windows close when the delay has passed."""
    order = F.struct(F.col(ts), *([F.col(tiebreak)] if tiebreak else []))
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    g = timed.groupBy(F.window(ts, width), key).agg(F.max_by(value, order).alias("last_value"), F.count("*").alias("rows"))
    return g.select(key, F.col("window.start").alias("period_start"), "last_value", "rows")


def drain(stream: DataFrame, name: str, mode: str = "append", keys: Sequence[str] | None = None) -> DataFrame:
    """Run a stream over everything available and return what it wrote.

    Rows go to a table in the shared folder with the query's checkpoint beside it. In update
    mode every batch appends its changed rows; the last one of each key is returned.
    """
    spark = stream.sparkSession
    path = table_path(spark, name)
    schema = stream.schema

    def append(batch: DataFrame, batch_id: int) -> None:
        # a batch that is run again replaces its own folder, so it counts once
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    writer = stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).outputMode(mode)
    with _STARTING:  # the setting is read when a query starts, and is the session's
        before = spark.conf.get(STORE_CONF)
        spark.conf.set(STORE_CONF, STORE)
        try:
            query = writer.foreachBatch(append).start()
        finally:
            spark.conf.set(STORE_CONF, before)
    query.awaitTermination()
    stored = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(stored).parquet(f"{path}/rows")
    if mode != "update":
        return rows.drop("batch")
    rest = [c for c in schema.names if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return last.select(*keys, "_r.*")
