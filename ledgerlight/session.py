"""Session helpers: a local builder for tests and bench, and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Rows that one task joins or groups where the caller knows how many there are.
TASK_ROWS = 1_000_000
Item = TypeVar("Item")


def local_session(cpus: int | str = "*", app: str = "ledgerlight", memory: str = "16g") -> SparkSession:
    """Session for tests and bench; on a cluster the caller brings its own."""
    cores = 8 if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by the session; a temp folder only in local mode."""
    sc = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    current = sc.getCheckpointDir()
    if current is None:
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
            named = tempfile.mkdtemp(prefix="ledgerlight-")
        sc.setCheckpointDir(named)
        current = sc.getCheckpointDir()
    return named or current


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so a lost executor never changes the rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """Tasks of about `TASK_ROWS` rows each; None where the session's shuffle partitions are as many."""
    tasks = -(-rows // TASK_ROWS)
    return tasks if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def spread(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """Rows dealt by key to so many tasks, so that a task's memory stays the same as rows are added; None: as they are."""
    return df.repartition(tasks, *keys) if tasks else df


def delete_paths(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared file system; missing ones are fine."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def side_by_side(spark: SparkSession, items: Sequence[Item], task: Callable[[Item], None], together: int, pool: str = "fit") -> None:
    """Run a task for all items, at most `together` at a time.

    Each is a stream of distributed jobs in a scheduler pool of its own; while one waits for its
    last tasks, others use the free ones. The first failure ends the run.
    """

    def run(item: Item) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{pool}-{item}")
        task(item)

    with ThreadPoolExecutor(max(1, together)) as threads:
        # a wrapper for each item: every thread inherits the caller's properties and session
        for done in [threads.submit(inheritable_thread_target(spark)(run), i) for i in items]:
            done.result()
