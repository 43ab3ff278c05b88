from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from memengine.runtime import ship_package, utc

    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .appName("memengine-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.warehouse.dir", str(base / "warehouse"))
        .config("spark.checkpoint.dir", str(base / "checkpoints"))
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield ship_package(utc(session))
    session.stop()


@pytest.fixture
def task_rows(spark):
    """Most rows that one task read from a shuffle since the fixture was asked for; partitions are not put together."""
    jvm, conf = spark._jvm, spark.conf
    store = spark._jsc.sc().statusStore()
    none = lambda: jvm.java.util.ArrayList()
    quantiles = spark._sc._gateway.new_array(jvm.double, 0)

    def stages():
        listed = store.stageList(none(), False, False, quantiles, none())
        return {(listed.apply(i).stageId(), listed.apply(i).attemptId()) for i in range(listed.length())}

    kept = {k: conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    conf.set("spark.sql.shuffle.partitions", "32")
    conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = stages()

    def most():
        found = [0]
        for stage, attempt in stages() - before:
            tasks = store.taskList(stage, attempt, 10_000)
            for i in range(tasks.length()):
                metrics = tasks.apply(i).taskMetrics()
                if metrics.isDefined():
                    found.append(metrics.get().shuffleReadMetrics().recordsRead())
        return max(found)

    yield most
    for key, value in kept.items():
        conf.set(key, value)
