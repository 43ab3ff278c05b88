"""Small fixed dimensions as DataFrames (all of a size fixed in code)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import constants as K


def groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.GROUPS, "system_group_id INT, group_name STRING")


def domain_map(spark: SparkSession) -> DataFrame:
    """Host to group."""
    rows = [(host, group) for group, hosts in K.HOST_GROUPS.items() for host in hosts]
    return spark.createDataFrame(rows, "domain STRING, category STRING")


def category_hints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(K.CATEGORY_HINTS.items()), "youtube_category_id INT, hint STRING")


def seed_texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(K.SEED_TEXTS.items()), "category STRING, seed_text STRING")
