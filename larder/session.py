"""Session settings, shared scratch storage and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(name: str = "larder", cpus: str | int = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster that folder would
    vanish with its machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to storage shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="larder-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; nothing is ever overwritten."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write a reduced table (one row per item, customer, value, basket member ...) to shared storage, once.

    Operators that read such a table several times call this so that the facts below it are
    scanned a single time, and so that a lost executor re-reads files rather than re-running
    the whole plan. The files keep column pruning and give the planner true sizes, so a small
    table is broadcast and a large one is not. It is never called on wide
    line-grain data.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def side_by_side(spark: SparkSession, work: Callable, cases: Iterable) -> list:
    """``work`` of each case at the same time, in the order of the cases; for few long rows of short jobs."""
    cases = list(cases)
    with ThreadPool(len(cases)) as pool:
        return pool.map(inheritable_thread_target(spark)(work), cases, chunksize=1)


#: Partitions of a stored training table: the same for every cluster and size, as sampled models depend on it.
TRAINING_PARTITIONS = 16


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Deal a stored training table over a fixed number of partitions by its values, in order inside each.

    Bagging and seeding draw per partition. With the place and order of every row given by its values, one
    table fits one model, whatever the cores, files or row order. ``columns`` name the values where others
    are computed sums, whose last digits depend on that order.
    """
    key = F.xxhash64(*[F.col(c) for c in columns or df.columns])
    return df.repartition(TRAINING_PARTITIONS, key).sortWithinPartitions(key)
