"""What the operators do with input rows before their own work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memengine.runtime import ship_package

BATCH_ROWS = 2000
BATCH_BYTES = 64 << 20


def prepared(spark: SparkSession) -> SparkSession:
    """Send the package to the workers, and hand them whole texts in batches of at most ``BATCH_ROWS`` rows and ``BATCH_BYTES``.

    Spark's default of 10,000 is made for numbers; batches of that many long texts would fill an executor.
    A session that has set smaller numbers keeps them; a single text beyond the bytes is a batch of its own.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < held <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return ship_package(spark)


def texts_by_id(docs: DataFrame) -> DataFrame:
    """(doc_id, text), one row per id: rows without an id go, of rows that share one the greatest text stays.

    Ids alone tell whether any repeats, so texts move only if one does.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.filter("doc_id is not null")
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return docs
    return docs.groupBy("doc_id").agg(F.max("text").alias("text"))


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        while name.lower() in taken:
            name += "_"
        return name

    return [free(f"_{name}") for name in names]


def all_columns(docs: DataFrame) -> list[Column]:
    """The columns of ``docs``, whatever characters their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
