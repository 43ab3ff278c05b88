"""Streams over several files against their batch twins."""

from __future__ import annotations

import os
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from memengine.operators import bucket_store, capture, sequences, store
from memengine.queries.streams import streamed
from memengine.queries.tables import Tables
from memengine.streaming import carried, jobs, revisits, visits


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """Events in time order over five files, read one file per micro-batch."""
    folder = str(tmp_path_factory.mktemp("feed"))
    events = Tables(spark, SMALL).events.withColumn("k", F.col("user_id") % 5)
    ordered = events.repartitionByRange(5, "ts").sortWithinPartitions("ts")
    ordered.write.mode("overwrite").parquet(folder)
    for n, part in enumerate(sorted(Path(folder).glob("part-*"))):  # the source reads oldest file first
        os.utime(part, (1_700_000_000 + 60 * n,) * 2)

    def stream():
        return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)

    return events, stream


def run(query):
    query.awaitTermination()


def test_revisits_over_batches(spark, feed, tmp_path):
    events, stream = feed
    marks = jobs.revisit_marks(stream(), ["k", "event_type"], ttl_seconds=7200, late="30 days")
    run(jobs.write_files(marks, str(tmp_path / "out"), str(tmp_path / "state")))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = capture.mark_revisits(events, ["k", "event_type"], "ts", "event_id", 7200).select("event_id", "is_revisit")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_replayed_events_count_once(spark, tmp_path):
    t = Tables(spark, SMALL)
    visits = t.visits.withColumn("revisit_count", F.col("revisit_count"))
    folder = str(tmp_path / "in")
    visits.write.parquet(folder)
    visits.filter("event_id % 2 = 0").write.mode("append").parquet(folder)
    stream = spark.readStream.schema(visits.schema).parquet(folder)
    run(jobs.ingest_visits(stream, str(tmp_path / "out"), str(tmp_path / "state")))
    folded = jobs.fold_partials(spark.read.parquet(str(tmp_path / "out" / "engagement")))
    accepted = capture.accepted_visits(visits).withColumn("seq", F.col("event_id"))
    want = store.fold_engagement(capture.visits_to_delta(accepted)[2])
    pick = ["memory_id", "dwell_time_seconds", "play_sessions_count"]
    assert sorted(map(tuple, folded.select(*pick).collect())) == sorted(map(tuple, want.select(*pick).collect()))


def test_items_and_page_meta_over_batches(spark, tmp_path):
    """Several micro-batches, some events replayed, against one batch fold."""
    visits = Tables(spark, SMALL).visits
    folder = str(tmp_path / "in")
    for n in (2, 0, 1):  # out of order
        visits.filter(F.col("event_id") % 3 == n).coalesce(1).write.mode("append").parquet(folder)
    visits.filter("event_id % 5 = 0").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(visits.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    run(jobs.ingest_visits(stream, str(tmp_path / "out"), str(tmp_path / "state"), late="400 days"))
    items, meta, _ = capture.visits_to_delta(capture.accepted_visits(visits).withColumn("seq", F.col("event_id")))
    got = store.fold_items(None, spark.read.parquet(str(tmp_path / "out" / "items")))
    want = store.fold_items(None, items)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    got = store.fold_page_meta(spark.read.parquet(str(tmp_path / "out" / "page_meta")))
    assert sorted(map(str, got.collect())) == sorted(map(str, store.fold_page_meta(meta).collect()))


def test_ingest_carries_only_ids_that_can_come_again(spark, tmp_path):
    """Three micro-batches that repeat the end of the one before; no id stays in a state store, few stay in files."""
    start, folder = datetime(2024, 1, 1), str(tmp_path / "in")
    visits = Tables(spark, SMALL).visits.withColumn("ts", F.lit(start) + F.make_dt_interval(mins=F.col("event_id"))).cache()
    total = visits.count()
    for n in range(3):
        low, high = n * total // 3, (n + 1) * total // 3
        visits.filter(F.col("event_id").between(low - 30 * (n > 0), high - 1)).coalesce(1).write.mode("append").parquet(folder)
    for part in Path(folder).glob("part-*"):  # the source reads oldest file first
        first = spark.read.parquet(str(part)).agg(F.max("event_id")).first()[0]
        os.utime(part, (1_700_000_000 + first,) * 2)
    stream = spark.readStream.schema(visits.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = jobs.ingest_visits(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    run(query)
    assert [p.stateOperators for p in query.recentProgress] == [[]] * 3
    seen = [r.event_id for r in spark.read.parquet(str(tmp_path / "state-carried" / "2" / "seen")).collect()]
    assert sorted(seen) == list(range(total - 120, total))  # later than an hour before the watermark, itself an hour behind
    folded = jobs.fold_partials(spark.read.parquet(str(tmp_path / "out" / "engagement")))
    accepted = capture.accepted_visits(visits).withColumn("seq", F.col("event_id"))
    want = store.fold_engagement(capture.visits_to_delta(accepted)[2])
    assert sorted(map(tuple, folded.collect())) == sorted(map(tuple, want.select(*folded.columns).collect()))


def test_watch_fold_over_batches(spark, feed, tmp_path):
    events, stream = feed
    shaped = lambda df: df.select(F.col("user_id").alias("video_id"), F.floor("value").alias("watch_time_seconds"))
    run(jobs.upsert_watch(shaped(stream()), str(tmp_path / "out"), str(tmp_path / "state")))
    got = jobs.watch_fold(spark.read.parquet(str(tmp_path / "out")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.watch_fold(shaped(events)).collect()))


@pytest.mark.parametrize("slot", [60, 3600])
def test_marks_by_slot_over_batches(spark, feed, tmp_path, slot):
    events, stream = feed
    marks = revisits.marked_by_slot(stream(), ["k", "event_type"], ttl_seconds=7200, late="1 hour", slot_seconds=slot)
    run(jobs.write_files(marks, str(tmp_path / "out"), str(tmp_path / "state")))
    got = {r.event_id: r.is_revisit for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.event_id: r.is_revisit for r in capture.mark_revisits(events, ["k", "event_type"], "ts", "event_id", 7200).collect()}
    assert 0.97 * len(want) < len(got) <= len(want) and got == {i: want[i] for i in got} and any(got.values())


def test_marks_of_a_hot_key_hold_no_key_in_a_task(spark, tmp_path, task_rows):
    """Nine tenths of the events are one key's, in a few minutes of one batch."""
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    rows = spark.range(20_000).selectExpr(
        "id AS event_id", "IF(id % 10 = 0, id, 0) AS k", "timestamp_micros(1704067200000000 + id * 50000) AS ts"
    )
    last = spark.sql("SELECT 99999999L AS event_id, -1L AS k, timestamp'2024-01-03 00:00:00' AS ts")
    folder = str(tmp_path / "in")
    rows.repartition(8).write.parquet(folder)
    stream = lambda: spark.readStream.schema(rows.schema).parquet(folder)
    for _ in range(2):
        run(jobs.write_files(revisits.marked_by_slot(stream(), ["k"], late="1 minute"), str(tmp_path / "out"), str(tmp_path / "state")))
        last.write.mode("append").parquet(folder)
    most = task_rows()
    got = {r.event_id: r.is_revisit for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.event_id: r.is_revisit for r in capture.mark_revisits(rows, ["k"], "ts", "event_id").collect()}
    assert got == want and sum(got.values()) > 17_000
    assert most < 6_000  # its 18,000 rows never meet in one task


SIGNALS = "user_id BIGINT, event_id BIGINT, ts TIMESTAMP, closes BOOLEAN, url STRING, title STRING, content_extract STRING, referrer STRING, scroll_depth DOUBLE, interaction_count INT, word_count INT, is_app_page BOOLEAN"


def test_tab_visits_end_by_close_or_silence(spark, tmp_path):
    """A close that comes a batch late ends the visit before it; signals behind it are the next visit's."""
    at = lambda seconds: datetime(2024, 1, 1) + timedelta(seconds=seconds)

    def signal(event, seconds, closes=False, user=1):
        return (user, event, at(seconds), closes, f"u{event}", f"t{event}" if event % 2 else "", None, None, event / 100, event, None, event == 3)

    batches = [
        [signal(1, 0), signal(2, 10), signal(4, 30), signal(5, 40), signal(20, 0, user=2), signal(21, 5, True, user=2)],
        [signal(3, 20, True), signal(6, 50), signal(30, 3, True, user=3), signal(22, 2000, user=2), signal(23, 2010, user=2)],
        [signal(7, 9000), signal(40, 9100, user=4)],
        [signal(41, 20_000, user=4)],
    ]
    folder = str(tmp_path / "in")
    seen = []
    for batch in batches:
        spark.createDataFrame(batch, SIGNALS).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
        run(jobs.write_files(visits.tab_visits(stream, {"user_id": "BIGINT"}, F.col("closes"), late="5 minutes"), str(tmp_path / "out"), str(tmp_path / "state")))
        seen.append(spark.read.parquet(str(tmp_path / "out")).count())
    zero = int((datetime(2024, 1, 1) - datetime(1970, 1, 1)).total_seconds())
    done = visits.with_texts(spark.read.parquet(str(tmp_path / "out")), spark.read.parquet(folder), ["user_id"])
    told = done.selectExpr("user_id", f"unix_seconds(opened_at) - {zero}", f"unix_seconds(closed_at) - {zero}", "ended_by", "signals", "url", "title", "interaction_count", "is_app_page")
    assert sorted(map(tuple, told.collect())) == [
        (1, 0, 20, "close", 2, "u2", "t1", 2.0, False), (1, 30, 50, "silence", 3, "u6", "t5", 6.0, False), (1, 9000, 9000, "silence", 1, "u7", "t7", 7.0, False),
        (2, 0, 5, "close", 1, "u20", None, 20.0, False), (2, 2000, 2010, "silence", 2, "u23", "t23", 23.0, False),
        (4, 9100, 9100, "silence", 1, "u40", None, 40.0, False),
    ]
    assert seen[:2] == [1, 2]  # a close is reported with the batch that brings it


def test_spans_of_a_visit_become_one():
    span = lambda n, us, closes=False: (us, n, us, closes, 1, None, n * 1.0, None, False, n, None, None, None)
    ended, kept, closed = visits.settled([span(n, n * 10) for n in range(20)], gap_us=1000, watermark_us=125)
    assert ended == [] and closed is None and len(kept) == 1 + 7 and kept[0][visits._SIGNALS] == 13
    ended, kept, closed = visits.settled([*kept, span(50, 5000, True)], gap_us=1000, watermark_us=125)
    assert [(v[0], v[1], v[2], v[3]) for v in ended] == [(0, 190, "silence", 20)] and kept == [] and closed == (5000, 50)


def test_late_metadata_is_given_out_once(spark, tmp_path):
    at = lambda minutes: datetime(2024, 1, 1) + timedelta(minutes=minutes)
    detected = [[(1, "a", at(0)), (2, "b", at(1)), (3, "c", at(2))], [(4, "a", at(300)), (5, "z", at(301))], [(6, "q", at(900))]]
    metadata = [[], [("a", at(10), "A"), ("b", at(45), "late")], [("c", at(20), "C"), ("a", at(310), "A2"), ("w", at(900), "W")]]
    found = []
    for left, right in zip(detected, metadata):
        spark.createDataFrame(left, "event_id INT, video_id STRING, timestamp TIMESTAMP").write.mode("append").parquet(str(tmp_path / "d"))
        spark.createDataFrame(right, "video_id STRING, fetched_at TIMESTAMP, channel STRING").write.mode("append").parquet(str(tmp_path / "m"))
        streams = [spark.readStream.schema(spark.read.parquet(str(tmp_path / x)).schema).parquet(str(tmp_path / x)) for x in "dm"]
        run(jobs.write_files(jobs.late_metadata(*streams, late="2 hours"), str(tmp_path / "out"), str(tmp_path / "state")))
        found.append(sorted((r.event_id, r.channel) for r in spark.read.parquet(str(tmp_path / "out")).collect()))
    assert found[1] == [(1, "A")]  # nothing is given up while metadata may still come
    assert sorted(found[2], key=str) == [(1, "A"), (2, None), (3, "C"), (4, "A2"), (5, None)]


def test_a_stream_reads_tables_of_one_file_and_of_many(spark, tmp_path):
    for name, parts in (("events", 3), ("documents", 2)):
        spark.read.parquet(f"{SMALL}/{name}.parquet").repartition(parts).write.parquet(f"{tmp_path}/{name}.parquet")
    for folder in (SMALL, str(tmp_path)):
        given = Tables(spark, folder)
        told = streamed(given, "events", "documents")
        for name in ("events", "documents"):
            out = f"{tmp_path}/{name}-{len(folder)}"
            run(jobs.write_files(getattr(told, name).select(getattr(given, name).columns[0]), f"{out}/out", f"{out}/state"))
            assert spark.read.parquet(f"{out}/out").count() == given.read(name).count() > 0


def test_visits_name_their_extracts(spark):
    t = Tables(spark, SMALL)
    named = t.named_visits
    assert named.agg(F.max(F.length("content_extract"))).first()[0] < 50 < t.visits.agg(F.max(F.length("content_extract"))).first()[0]
    back = t.with_extracts(named).select(*t.visits.columns)
    assert back.count() == t.visits.count() and back.exceptAll(t.visits).isEmpty()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "as it is")], "n INT, content_extract STRING")
    assert sorted(map(tuple, t.with_extracts(odd).collect())) == [(1, None), (2, ""), (3, "as it is")]


def test_slices_are_moved_not_copied(spark, tmp_path):
    rows = spark.range(100).withColumn("_slice", F.col("id") % 2)
    rows.write.partitionBy("_slice").parquet(f"{tmp_path}/staged")
    spark.range(0).write.parquet(f"{tmp_path}/in")
    for n in range(3):  # there is no third slice
        bucket_store.move_files(spark, f"{tmp_path}/staged/_slice={n}", f"{tmp_path}/in", f"{n}-")
        assert spark.read.parquet(f"{tmp_path}/in").count() == min(100, 50 * (n + 1))
    assert not list(Path(tmp_path, "staged").rglob("*.parquet"))


@pytest.mark.parametrize("wait", [60, None])
def test_marks_by_files_over_batches(spark, feed, tmp_path, wait):
    events, stream = feed
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    run(carried.mark_revisits(stream(), ["k", "event_type"], out, state, ttl_seconds=7200, late="1 hour", wait_seconds=wait))
    got = {r.event_id: r.is_revisit for r in spark.read.parquet(out).collect()}
    marked = capture.mark_revisits(events, ["k", "event_type"], "ts", "event_id", 7200)
    if wait is not None:
        until = marked.agg(F.max("ts") - F.expr(f"INTERVAL 1 HOUR {wait} SECONDS")).first()[0]
        marked = marked.filter(F.col("ts") < F.lit(until))
    assert got == {r.event_id: r.is_revisit for r in marked.collect()} and any(got.values())
    kept = [p.name for p in (tmp_path / "state-carried").iterdir()]
    assert sorted(kept) == ["3", "4"]  # five batches, of which the last two are kept


def test_marks_by_files_ask_no_python_worker_and_hold_no_key(spark, tmp_path, task_rows, monkeypatch):
    """Nine tenths of the events are one key's, in disorder over two batches; the others have a key each."""
    monkeypatch.setattr(sequences, "BLOCK_ROWS", 1000)
    rows = spark.range(20_000).selectExpr(
        "id AS event_id", "IF(id % 10 = 0, id, 0) AS k", "timestamp_micros(1704067200000000 + (id * 7919 % 20000) * 50000) AS ts"
    )
    last = spark.sql("SELECT 99999999L AS event_id, -1L AS k, timestamp'2024-01-03 00:00:00' AS ts")
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    plans = []

    def seen(marked):
        plans.append(marked._jdf.queryExecution().toString())
        return marked

    for part in (rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1"), last):
        part.repartition(4).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(rows.schema).parquet(folder)
        run(carried.mark_revisits(stream, ["k"], out, state, late="30 minutes", then=seen))
    most = task_rows()
    got = {r.event_id: r.is_revisit for r in spark.read.parquet(out).collect()}
    want = {r.event_id: r.is_revisit for r in capture.mark_revisits(rows, ["k"], "ts", "event_id").collect()}
    assert got == want and sum(got.values()) > 17_000
    assert len(plans) == 3 and not any("Pandas" in p or "Python" in p for p in plans)
    assert most < 6_000  # its 18,000 rows never meet in one task
