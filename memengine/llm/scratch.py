"""Intermediate tables in the cluster's shared folder.

A written table cuts the lineage like a checkpoint, survives the loss of an
executor, is columnar and compressed, and can be read with fewer columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from memengine.runtime import checkpoint_dir

SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; nothing is written yet."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new folder of the shared place and read it back.

    The plan runs only this once, so its shuffle files go when it ends and do not wait for the driver's garbage collection.
    """
    spark = df.sparkSession
    path, before = folder(spark, name), spark.conf.get(SHUFFLES_GO)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by ``saved`` that no later plan reads."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "/llm-" in path.toString():
            path.getFileSystem(conf).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete everything this application has left in the shared folder; call it when no result is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(
        f"{checkpoint_dir(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}"
    )
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
