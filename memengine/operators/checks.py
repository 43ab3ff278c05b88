"""Data-quality checks of the store, as frames of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import constants as K


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def one_to_one_gaps(items: DataFrame, engagement: DataFrame) -> DataFrame:
    """Items without engagement and engagement without item."""
    left, right = items.select("memory_id"), engagement.select("memory_id")
    missing = left.join(right, "memory_id", "left_anti").withColumn("problem", F.lit("no_engagement"))
    orphan = right.join(left, "memory_id", "left_anti").withColumn("problem", F.lit("no_item"))
    return missing.unionByName(orphan)


_COLUMNS = "table_name STRING, column_name STRING, data_type STRING"


def catalog_columns(spark: SparkSession, prefix: str = "", database: str | None = None) -> DataFrame:
    """(table_name, column_name, data_type) of the session catalog's tables and views whose name begins with ``prefix``.

    Names without the prefix; one row per column that the catalog knows.
    """
    rows = []
    for table in spark.catalog.listTables(database):
        if table.name.startswith(prefix):
            name = table.name if table.isTemporary or not database else f"{database}.{table.name}"
            rows += [(table.name.removeprefix(prefix), c.name, c.dataType) for c in spark.catalog.listColumns(name)]
    return spark.createDataFrame(rows, _COLUMNS)


def model_columns(spark: SparkSession, model: dict[str, str]) -> DataFrame:
    """The same rows for tables given as DDL."""
    rows = [(name, f.name, f.dataType.simpleString()) for name, ddl in model.items() for f in StructType.fromDDL(ddl)]
    return spark.createDataFrame(rows, _COLUMNS)


def schema_gaps(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(problem, table_name, column_name, expected, found) of what a catalog lacks; columns beyond the model are no gap."""
    keys = ["table_name", "column_name"]
    pairs = expected.withColumnRenamed("data_type", "expected").join(found.withColumnRenamed("data_type", "found"), keys, "left")
    known = found.select("table_name").distinct().withColumn("known", F.lit(True))
    gaps = pairs.join(known, "table_name", "left").filter(F.col("found").isNull() | (F.col("found") != F.col("expected")))
    missing_table = F.col("known").isNull()
    problem = F.when(missing_table, "no_table").when(F.col("found").isNull(), "no_column").otherwise("other_type")
    # a table that is not there is one gap, not one per column
    return gaps.select(
        problem.alias("problem"), "table_name", F.when(~missing_table, F.col("column_name")).alias("column_name"),
        F.when(~missing_table, F.col("expected")).alias("expected"), "found",
    ).distinct()


def null_keys(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def missing_groups(groups: DataFrame) -> DataFrame:
    want = groups.sparkSession.createDataFrame(K.GROUPS, "system_group_id INT, group_name STRING")
    return want.join(groups, ["system_group_id", "group_name"], "left_anti")
