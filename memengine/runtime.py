"""Session settings and the three guards every plan uses.

* ``bounded_broadcast``: broadcast a side only after its row count was checked;
* ``cut_lineage``: reliable checkpoint in the cluster's shared folder;
* ``top_per_group``: first ``k`` rows per key without one task holding a key.
"""

from __future__ import annotations

import gc
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
PRE_RANK_SALTS = 64
JOIN_SALTS = 32
WIDE_TASKS = 8
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def utc(spark: SparkSession) -> SparkSession:
    """Pin the session zone; every stored timestamp is UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Texts go to the Python workers in batches of at most ``BATCH_ROWS`` rows and ``BATCH_BYTES``; smaller settings stay."""
    as_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name, most, number in (("maxRecordsPerBatch", BATCH_ROWS, int), ("maxBytesPerBatch", BATCH_BYTES, as_bytes)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < number(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        archive = shutil.make_archive(
            str(Path(tempfile.mkdtemp(prefix="memengine-")) / "memengine"), "zip", root, "memengine"
        )
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and stream state, as the session names it.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local folder would not survive the loss of an executor.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="memengine-ckpt-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Plans that run inside leave no shuffle files; else these wait for the driver's garbage collection.

    For plans that run once, such as writes: one that runs again would have to make its shuffles again.
    """
    before = spark.conf.get(SHUFFLES_GO)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_GO, before)


def collect_driver(spark: SparkSession) -> None:
    """Let the driver collect its garbage: shuffle files of streams that have ended go only then, and a large heap may not need it for hours."""
    gc.collect()
    spark._jvm.System.gc()


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if it holds at most ``rows`` rows, else leave the join to Spark."""
    return F.broadcast(df) if within(df, rows) else df


def listed(values: DataFrame, name: str) -> DataFrame:
    """One row: the sorted distinct values of the only column, as the array ``name``, for ``beside``."""
    column = F.sort_array(F.collect_set(values.columns[0])).alias(name)
    return cut_lineage(values.agg(column).withColumn("_zero", F.lit(0).cast("bigint")))


def beside(df: DataFrame, row: DataFrame, key: str) -> DataFrame:
    """Every row of ``df`` with the array of a row of ``listed``.

    Long lists belong into a table: as constants they stand in the plan, and the driver keeps every text that
    adaptive execution makes of it.  The join is on a hash of ``key`` that is 0 for all rows, so it is an equi-join.
    """
    return df.withColumn("_zero", F.pmod(F.xxhash64(key), F.lit(1))).join(F.broadcast(row), "_zero").drop("_zero")


def spread(df: DataFrame) -> DataFrame:
    """Deal a read of few splits out to all cores; reads with splits enough stay untouched.

    Text work is far dearer than moving the text once, but only small inputs
    have fewer splits than the cluster has cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def wide_tasks(spark: SparkSession) -> int:
    """Tasks for rows that become many: adaptive execution puts partitions together by the size of what goes in."""
    return max(WIDE_TASKS * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def within(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


def lookup_join(
    left: DataFrame, right: DataFrame, keys: list[str], few: bool | None = None, salt_by: str = "memory_id"
) -> DataFrame:
    """Equi-join of many rows with a table that is usually small.

    A right side whose size was checked is broadcast.  Otherwise hot keys are
    salted: left rows spread over the salts, right rows are copied to each.
    """
    if within(right, BROADCAST_ROWS) if few is None else few:
        return left.join(F.broadcast(right), keys)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(JOIN_SALTS)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"]).drop("_salt")


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """Rows ranked 1..k per key, with the rank.

    A first pass ranks within (key, salt), the salt being the input partition
    modulo ``PRE_RANK_SALTS``, so the last pass gets at most k rows per key and
    salt however many partitions there are.  Up to k = 1000 Spark also keeps only k rows
    per key and input partition before the first shuffle.
    """
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(PRE_RANK_SALTS)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    df = salted.withColumn("_pre", F.row_number().over(first)).filter(F.col("_pre") <= k).drop("_salt", "_pre")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
