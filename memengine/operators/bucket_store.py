"""A keyed table as files, of which a delta rewrites only the buckets its keys fall into.

The table is Parquet, partitioned by ``bucket``, a hash of its key.  A merge reads
and writes the touched buckets (dynamic partition overwrite); files of other
buckets keep their names.  A merge that is repeated, since its caller did not live
to hear that it was done, must change nothing: folds of upserts are such, and
``merge`` skips for others the buckets that already carry its number.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import checkpoint_dir, shuffles_go

BUCKETS = 256
Fold = Callable[[DataFrame | None, DataFrame], DataFrame]


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, folder: str) -> bool:
    store, path = _path(spark, folder)
    return store.exists(path) and any(s.getPath().getName().startswith("bucket=") for s in store.listStatus(path))


def read(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """All rows, without the bucket and the number of the merge that wrote them."""
    reader = spark.read.schema(f"{schema}, merged BIGINT, bucket INT") if schema else spark.read
    return reader.parquet(folder).drop("bucket", "merged")


def merge(folder: str, delta: DataFrame, fold: Fold, number: int = 0, key: str = "memory_id", buckets: int = BUCKETS, replay_safe: bool = True) -> list[int]:
    """Fold ``delta`` into the table at ``folder``; returns the buckets that were rewritten.

    ``fold(rows of the touched buckets or None, delta)`` gives their new rows.  ``number`` rises from merge to merge.  Unless the
    fold is ``replay_safe``, buckets that a merge of this number or a later one has written already are left alone.  ``buckets`` is a
    property of the table and must stay the same.  One list of touched buckets, ``buckets`` numbers at most, goes through the driver.
    The delta is kept as files while the merge runs.
    """
    spark = delta.sparkSession
    kept = f"{checkpoint_dir(spark).rstrip('/')}/delta-{uuid.uuid4().hex}"
    placed = delta.withColumn("bucket", _bucket(key, buckets))
    try:
        with shuffles_go(spark):
            placed.write.option("compression", "zstd").parquet(kept)
            return _merged(folder, spark.read.schema(placed.schema).parquet(kept), fold, number, key, buckets, replay_safe)
    finally:
        store, path = _path(spark, kept)
        store.delete(path, True)


def _merged(folder: str, delta: DataFrame, fold: Fold, number: int, key: str, buckets: int, replay_safe: bool) -> list[int]:
    spark = delta.sparkSession
    touched = sorted(r[0] for r in delta.select("bucket").distinct().collect())
    table = None
    if exists(spark, folder):
        table = spark.read.parquet(folder).filter(F.col("bucket").isin(touched))
        if not replay_safe:
            done = {r[0] for r in table.groupBy("bucket").agg(F.max("merged").alias("m")).filter(F.col("m") >= number).collect()}
            touched = [b for b in touched if b not in done]
            table, delta = (df.filter(F.col("bucket").isin(touched)) for df in (table, delta))
    if not touched:
        return []
    rows = fold(None if table is None else table.drop("bucket", "merged"), delta.drop("bucket"))
    placed = rows.withColumn("merged", F.lit(number).cast("bigint")).withColumn("bucket", _bucket(key, buckets))
    writer = placed.repartition(max(1, min(len(touched), buckets)), "bucket").sortWithinPartitions("bucket", key)
    options = {"partitionOverwriteMode": "dynamic", "compression": "zstd"}
    writer.write.mode("overwrite").options(**options).partitionBy("bucket").parquet(folder)
    return touched


def move_files(spark: SparkSession, source: str, target: str, prefix: str) -> int:
    """Move the Parquet files of one folder, if it is there, to another under names of their own; nothing is copied."""
    store, path = _path(spark, source)
    names = [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []
    files = [n for n in names if n.endswith(".parquet")]
    for name in files:
        if not store.rename(_path(spark, f"{source}/{name}")[1], _path(spark, f"{target}/{prefix}{name}")[1]):
            raise OSError(f"cannot move {source}/{name} to {target}")
    return len(files)


def save_days(df: DataFrame, folder: str, ts: str = "created_at") -> None:
    """Append rows to a table partitioned by the day of ``ts``."""
    df.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(folder)


def drop_days(spark: SparkSession, folder: str, before: str) -> list[str]:
    """Delete the partitions of days before ``before`` (yyyy-MM-dd), whole folders; other files are not touched."""
    store, path = _path(spark, folder)
    days = {s.getPath().getName().removeprefix("day="): s.getPath() for s in store.listStatus(path) if s.getPath().getName().startswith("day=")}
    gone = sorted(day for day in days if day[:1].isdigit() and day < before)
    for day in gone:
        store.delete(days[day], True)
    return gone
