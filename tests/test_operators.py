"""Folds, sequences, groups, search paths, vectors, cascade: fixtures and invariants."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from conftest import SMALL
from memengine import constants as K
from memengine import runtime
from memengine.operators import capture, classify, groups, knn, messages, phrases, search, sequences, sessions, store, text_jobs, views
from memengine.plans import retrieval
from memengine.queries.tables import Tables
from memengine.sources import dimensions

T0 = datetime(2024, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- folds --------------------------------------------------------------------------
def item_rows(spark, values):
    data = [
        ("k", "gmail", "s", 4, title, text, T0, T0 + timedelta(seconds=n), n)
        for n, (title, text) in enumerate(values, 1)
    ]
    return spark.createDataFrame(
        data,
        "memory_id STRING, source_type STRING, source_id STRING, system_group_id INT, title STRING, raw_text STRING, "
        "created_at TIMESTAMP, ingest_ts TIMESTAMP, seq INT",
    )


def test_item_fold_keeps_last_known(spark):
    out = store.fold_items(None, item_rows(spark, [("A", "x"), ("", None), ("B", None)])).first()
    assert (out.title, out.raw_text, out.created_new, out.classified_by) == ("B", "x", True, "pending")


def test_item_fold_in_steps_equals_one_fold(spark):
    values = [("A", "x"), ("", None), ("B", "y"), ("", "z")]
    whole = store.fold_items(None, item_rows(spark, values)).drop("created_new")
    delta = item_rows(spark, values)
    first = store.fold_items(None, delta.filter("seq <= 2")).drop("created_new")
    both = store.fold_items(first, delta.filter("seq > 2"))
    assert not both.first().created_new
    assert rows(both.drop("created_new")) == rows(whole)


def test_changed_text_asks_for_enrichment_again(spark):
    done = store.fold_items(None, item_rows(spark, [("A", "x")])).drop("created_new").withColumn("preprocessed", F.lit(True))
    same = store.fold_items(done, item_rows(spark, [("B", "x")])).first()
    other = store.fold_items(done, item_rows(spark, [("B", "new")])).first()
    assert same.preprocessed and not other.preprocessed


def test_engagement_fold(spark):
    data = [("k", 5, 30, 1, T0), ("k", 7, 10, 1, T0 + timedelta(hours=1))]
    schema = "memory_id STRING, dwell_time_seconds BIGINT, watch_time_seconds BIGINT, play_sessions_count BIGINT, accessed_at TIMESTAMP"
    folded = store.fold_engagement(spark.createDataFrame(data, schema))
    meta = lambda d: spark.createDataFrame([("k", d)], "memory_id STRING, duration_seconds INT")
    one = store.completion(folded, meta(60)).first()
    assert (one.dwell_time_seconds, one.watch_time_seconds, one.play_sessions_count) == (12, 30, 2)
    assert one.completion_rate == 0.5
    assert store.completion(folded, meta(0)).first().completion_rate is None
    assert store.completion(folded, meta(20)).first().completion_rate == 1.0


def test_bucketed_store_joins_without_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("b_items", "b_engagement"):
            store.save_bucketed(spark.range(100).select(F.col("id").cast("string").alias("memory_id"), "id"), name, 4)
        joined = spark.table("b_items").join(spark.table("b_engagement"), "memory_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("b_items", "b_engagement"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


# --- sequences ------------------------------------------------------------------------
def test_revisits_literal(spark):
    seconds = [0, 86_399, 172_797, 259_197, 400_000]
    data = [(1, n, T0 + timedelta(seconds=s)) for n, s in enumerate(seconds)]
    df = spark.createDataFrame(data, "k INT, event_id INT, ts TIMESTAMP")
    got = {r.event_id: r.is_revisit for r in capture.mark_revisits(df, ["k"], "ts", "event_id").collect()}
    # A gap of exactly one TTL is no revisit.
    assert [got[n] for n in range(5)] == [False, True, True, False, False]


@pytest.mark.parametrize("slot", [60, 3600, 86_400, 10**9])
def test_slots_do_not_change_sequences(spark, slot):
    rng = random.Random(3)
    data = [
        (rng.randint(0, 2), n, T0 + timedelta(seconds=rng.randint(0, 20_000)), rng.choice([None, None, True, False]), rng.randint(0, 5))
        for n in range(400)
    ]
    df = spark.createDataFrame(data, "k INT, id INT, ts TIMESTAMP, flag BOOLEAN, v INT").cache()
    w = Window.partitionBy("k").orderBy("ts", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "id", F.lag("v").over(w).alias("before"), F.lead("v").over(w).alias("after"), F.sum("v").over(upto).alias("total"),
        F.last("flag", ignorenulls=True).over(upto).alias("known"),
    )
    out = sequences.neighbour(df, ["k"], ["ts", "id"], ["v"], "p", slot_seconds=slot)
    out = sequences.neighbour(out, ["k"], ["ts", "id"], ["v"], "n", step=-1, slot_seconds=slot)
    out = sequences.running_total(out, ["k"], ["ts", "id"], F.col("v"), "total", slot_seconds=slot)
    out = sequences.last_known(out.withColumn("known", F.col("flag")), ["k"], ["ts", "id"], ["known"], slot_seconds=slot)
    got = out.select("id", F.col("p.v").alias("before"), F.col("n.v").alias("after"), "total", "known")
    assert rows(got) == rows(want)


@pytest.mark.parametrize("spread_us", [1, 900_000])
def test_a_key_within_one_second_is_many_blocks(spark, monkeypatch, task_rows, spread_us):
    """Nearly all rows are one key's, in one second or at one moment; no task gets more than a few blocks."""
    monkeypatch.setattr(sequences, "BLOCK_ROWS", 250)
    rng = random.Random(5)
    data = [
        (0 if n % 10 else None, n * 7 % 5001, T0 + timedelta(microseconds=rng.randrange(spread_us)), rng.choice([None, None, True, False]), n % 5)
        for n in range(5000)
    ]
    df = spark.createDataFrame(data, "k INT, id INT, ts TIMESTAMP, flag BOOLEAN, v INT")
    w = Window.partitionBy("k").orderBy("ts", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = rows(df.select(
        "id", F.lag("v").over(w).alias("before"), F.lead("v").over(w).alias("after"), F.sum("v").over(upto).alias("total"),
        F.last("flag", ignorenulls=True).over(upto).alias("known"),
    ))
    blocks = sequences.with_slot(df, ["k"], ["ts", "id"]).groupBy("k", "_slot", "_block").count().collect()
    assert len(blocks) >= 15 and max(r["count"] for r in blocks) <= 4 * 250
    seen = len(want)
    marked = capture.mark_revisits(df, ["k"], "ts", "id", ttl_seconds=60)
    assert marked.filter("is_revisit").count() == seen - 2
    out = sequences.neighbour(df, ["k"], ["ts", "id"], ["v"], "p")
    assert rows(out.select("id", "p.v")) == sorted(((r[0], r[1]) for r in want), key=str)
    out = sequences.neighbour(df, ["k"], ["ts", "id"], ["v"], "n", step=-1)
    assert rows(out.select("id", "n.v")) == sorted(((r[0], r[2]) for r in want), key=str)
    assert rows(sequences.running_total(df, ["k"], ["ts", "id"], F.col("v"), "total").select("id", "total")) == sorted(((r[0], r[3]) for r in want), key=str)
    known = sequences.last_known(df.withColumn("known", F.col("flag")), ["k"], ["ts", "id"], ["known"])
    assert rows(known.select("id", "known")) == sorted(((r[0], r[4]) for r in want), key=str)


def test_no_task_holds_a_hot_key(spark, monkeypatch, task_rows):
    monkeypatch.setattr(sequences, "BLOCK_ROWS", 250)
    df = spark.range(20_000).selectExpr("1 AS k", "id", "timestamp_micros(id) AS ts", "CAST(1 AS BIGINT) AS v").cache()
    df.count()
    base = task_rows()
    assert sequences.running_total(df, ["k"], ["ts", "id"], F.col("v"), "total").agg(F.max("total")).first()[0] == 20_000
    assert base <= task_rows() <= 4_000  # a plain window would read 20,000 rows in one task


def test_session_edge(spark):
    at = [0, 299, 599, 900]
    df = spark.createDataFrame([(1, n, T0 + timedelta(seconds=s)) for n, s in enumerate(at)], "k INT, id INT, ts TIMESTAMP")
    got = {r.id: r.session_no for r in sessions.sessionize(df, ["k"], "ts", "id").collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 2}


def test_toggle_parity(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), ("c",), ("c",)], "m STRING")
    assert {r.m: r.is_marked for r in sessions.toggle_state(df, "m").collect()} == {"a": True, "b": False, "c": True}


def test_active_time_stops_when_idle(spark):
    def at(s):
        return T0 + timedelta(seconds=s)

    data = [(1, at(0), 0, True, True, at(0)), (1, at(100), 1, None, False, None), (1, at(200), 2, None, True, at(200)), (1, at(220), 3, False, None, None)]
    df = spark.createDataFrame(data, "k INT, ts TIMESTAMP, id INT, playing BOOLEAN, focused BOOLEAN, input TIMESTAMP")
    out = capture.active_time(df, ["k"], ["ts", "id"], ["playing", "focused"], "input").first()
    assert out.active_seconds == 30 + 20
    assert capture.active_time(df, ["k"], ["ts", "id"], ["playing", "focused"]).first().active_seconds == 120


# --- messages and groups ---------------------------------------------------------------
def test_history_without_messages(spark):
    parsed = spark.createDataFrame([("a", n, "user" if n % 2 else "assistant", str(n)) for n in range(12)], "session_id STRING, seq INT, role STRING, content STRING")
    wanted = spark.createDataFrame([("a",), ("b",)], "session_id STRING")
    got = {r.session_id: r.history for r in messages.history_text(parsed, wanted).collect()}
    assert got["b"] == K.NO_HISTORY_TEXT
    assert got["a"].split("\n")[0] == "Assistant: 2" and len(got["a"].split("\n")) == 10


def test_append_and_read_turns(spark, tmp_path):
    turns = spark.createDataFrame([("s", "hi", "hello", T0)], "session_id STRING, user_query STRING, assistant_answer STRING, created_at TIMESTAMP")
    for _ in range(2):
        messages.append_turns(turns, str(tmp_path / "log"))
    back = messages.parse_messages(spark.read.parquet(str(tmp_path / "log")))
    assert messages.message_counts(back).first().messages == 4
    assert messages.delete_sessions(back, back.select("session_id"))[0].count() == 0
    assert {r.content for r in back.collect()} == {"hi", "hello"}


@pytest.mark.parametrize("few_rows", [200_000, 0])
def test_rules_over_midnight_and_types(spark, monkeypatch, few_rows):
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", few_rows)  # 0 takes the salted joins
    items = spark.createDataFrame(
        [
            ("a", "Big Data news", ["spark"], T0 + timedelta(hours=23), None, None, None, None),
            ("b", "x", [], T0 + timedelta(hours=12), "Ada <a@b.org>", "Host.com", "UC1", "Chan"),
        ],
        "memory_id STRING, title STRING, auto_keywords ARRAY<STRING>, created_at TIMESTAMP, sender STRING, domain STRING, channel_id STRING, channel_name STRING",
    )
    rules = spark.createDataFrame(
        [("r1", "g", "keyword", "big data"), ("r2", "g", "keyword", "SPARK"), ("r3", "g", "time_window", "22-6"), ("r4", "g", "sender", "B.org"),
         ("r5", "g", "sender", "a@b.org"), ("r6", "g", "domain", "host.com"), ("r7", "g", "channel", "uc1"), ("r8", "g", "channel", "Chan"), ("r9", "g", "keyword", "absent")],
        "rule_id STRING, group_id STRING, rule_type STRING, rule_value STRING",
    ).withColumn("is_active", F.lit(True)).withColumn("created_at", F.lit(T0))
    matches = groups.match_rules(items, rules)
    assert rows(matches.select("memory_id", "rule_id")) == [("a", "r1"), ("a", "r2"), ("a", "r3"), ("b", "r4"), ("b", "r5"), ("b", "r6"), ("b", "r7"), ("b", "r8")]
    counted = groups.rule_match_counts(rules, matches)
    assert [r.rule_id for r in groups.dead_rules(counted, F.lit(T0 + timedelta(days=31))).collect()] == ["r9"]
    assert groups.accepted_groups(groups.suggest(matches)).count() == 0


# --- phrase search, scopes, top-k ---------------------------------------------------------
@pytest.mark.parametrize("few", [1000, 0])
def test_phrase_paths_agree(spark, few):
    texts = ["Abc abcd", "xbcx", "", None, "dab", "a\nb \U0001f600d\U0001f600 ÄÖ", "the " * 5000 + "end"]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, t STRING")
    wanted = ["abc", "BC", "b", "bcd", "da", "zz", "", "d", "a\nb", "\U0001f600", "d\U0001f600", " äö", "the the end", "the the the", None]
    got = phrases.match_phrases(df, F.col("t"), spark.createDataFrame([(p,) for p in wanted], "phrase STRING"), ["id"], few)
    want = sorted({(n, p.lower()) for n, t in enumerate(texts) for p in wanted if p and p.lower() in (t or "").lower()})
    assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_many_phrases(spark):
    df = spark.range(2000).select("id", F.concat(F.lit("item number "), F.col("id") * 7, F.lit(" of all")).alias("t"))
    wanted = spark.range(100_001).select(F.concat(F.lit("number "), F.col("id"), F.lit(" of")).alias("phrase"))
    got = phrases.match_phrases(df, F.col("t"), wanted, ["id"])
    assert got.count() == got.distinct().count() == 2000


@pytest.mark.parametrize("k", [5, 1001])
def test_top_per_group(spark, k):
    n = 6000
    df = spark.range(0, n, 1, 200).select((F.col("id") % 10 == 0).cast("int").alias("k"), F.col("id").alias("v"))
    got = runtime.top_per_group(df, ["k"], [F.col("v").desc()], k)
    groups_ = {g: sorted((x for x in range(n) if (x % 10 == 0) == bool(g)), reverse=True)[:k] for g in (0, 1)}
    assert rows(got) == sorted([(g, v, r) for g, vs in groups_.items() for r, v in enumerate(vs, 1)], key=str)


def make_view(spark, n=300):
    rng = random.Random(5)
    data = [
        (f"m{i:04d}", rng.choice(K.SOURCES), f"title {rng.choice(['alpha', 'beta', 'gamma'])} {i}", [rng.choice(["kx", "ky"])],
         T0 + timedelta(minutes=rng.randint(0, 9000)), rng.random() < 0.9, rng.random() < 0.1,
         None if rng.random() < 0.1 else T0 + timedelta(seconds=rng.randint(0, 10**6)))
        for i in range(n)
    ]
    return spark.createDataFrame(
        data,
        "memory_id STRING, source_type STRING, title STRING, auto_keywords ARRAY<STRING>, created_at TIMESTAMP, preprocessed BOOLEAN, is_deleted BOOLEAN, last_accessed_at TIMESTAMP",
    )


def make_intents(spark):
    data = [
        ("q0", ["all"], None, "", False), ("q1", ["gmail"], "2024-01-03", "", False), ("q2", [], "2024-01-03T05:17:23", "", False),
        ("q3", ["gmail", "chrome"], "2024-01-02T10:00:00", "ALPHA", False), ("q4", ["youtube"], None, "kx", False), ("q5", ["youtube"], "soon", "kx", False),
        ("q6", ["youtube"], "soon", "nothing", True), ("q7", ["all"], None, "%", False), ("q8", ["all"], "2030-01-01", "", False),
        ("q9", ["all"], None, "", False),
    ]
    return spark.createDataFrame(data, "query_id STRING, sources ARRAY<STRING>, time_filter STRING, query_clean STRING, skip_postgres_filter BOOLEAN")


def brute_search(view, intents, limit):
    live = [r for r in view.collect() if r.preprocessed and not r.is_deleted]
    live.sort(key=lambda r: (r.last_accessed_at is None, -(r.last_accessed_at or T0).timestamp(), r.memory_id))
    out = []
    for q in intents.collect():
        open_sources = q.skip_postgres_filter or not q.sources or "all" in q.sources
        if q.time_filter == "soon" and not q.skip_postgres_filter:
            continue
        since = datetime.fromisoformat(q.time_filter) if q.time_filter and not q.skip_postgres_filter else None
        phrase = "" if q.skip_postgres_filter else q.query_clean.lower()
        hits = [
            r for r in live
            if (open_sources or r.source_type in q.sources) and (since is None or r.created_at >= since)
            and (not phrase or phrase in r.title.lower() or any(phrase in k for k in r.auto_keywords))
        ]
        out += [(q.query_id, r.memory_id, n) for n, r in enumerate(hits[:limit], 1)]
    return sorted(out)


@pytest.mark.parametrize("limit,few", [(7, 5000), (1000, 5000), (7, 0)])
def test_search_equals_brute_force(spark, monkeypatch, limit, few):
    monkeypatch.setattr(search, "FEW_SCOPES", few)  # 0 takes the salted joins
    view, intents = make_view(spark).cache(), make_intents(spark)
    got = search.search(intents, view, limit).select("query_id", "memory_id", "rank")
    assert sorted(map(tuple, got.collect())) == brute_search(view, intents, limit)


def test_bounds_and_hours_find_the_same(spark, monkeypatch):
    view, intents = make_view(spark), make_intents(spark)
    got = rows(search.search(intents, view, 7))
    monkeypatch.setattr(search, "FEW_BOUNDS", 0)
    assert rows(search.search(intents, view, 7)) == got and got


def test_equal_intents_share_their_results(spark, monkeypatch, task_rows):
    """One scope of very many queries: results are kept once, and their pairs are dealt over tasks."""
    view = make_view(spark)
    intents = make_intents(spark).limit(1).withColumn("query_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: i.cast("string"))))
    members, results = search.search_scopes(intents, view, 20)
    n = results.count()
    assert 0 < n <= 20 and members.count() == 20_000 and results.select("scope").distinct().count() == 1
    before = task_rows()
    pairs = search.expanded(members, results)
    assert pairs.count() == 20_000 * n and task_rows() <= max(before, 4_000)
    monkeypatch.setattr(search, "HOT_SCOPE", 10**9)
    assert rows(search.expanded(members.limit(50), results)) == rows(search.expanded(members, results).join(members.limit(50), "query_id", "left_semi"))


@pytest.mark.parametrize("anchors", [0, 4096])
def test_anchors_as_constants_or_rows_find_the_same(spark, monkeypatch, anchors):
    monkeypatch.setattr(phrases, "FEW_ANCHORS", anchors)
    texts = ["the quick brown fox", "THE QUIET fox", "äöü ünder", "ab", "", None, "x" * 50, "fox" * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, t STRING")
    asked = ["quick", "qui", "fox", "b", "ab", "ünd", "xxx", "nothing here", "o", "the qui"]
    for some in (asked, [p for p in asked if len(p) >= 3]):
        got = phrases.match_phrases(df, F.col("t"), spark.createDataFrame([(p,) for p in some], "phrase STRING"), ["id"])
        assert rows(got) == sorted(((i, p) for i, t in enumerate(texts) for p in some if p in (t or "").lower()), key=str)


@pytest.mark.parametrize("few", [0, 10_000])
def test_stored_postings_find_what_the_search_finds(spark, monkeypatch, tmp_path, few):
    from memengine.operators import postings

    monkeypatch.setattr(postings, "FEW_PIECES", few)
    folder = str(tmp_path / "postings")
    texts = ["the quick brown fox", "THE QUIET fox", "äöü ünder", "ab", "", None, "x" * 50, "fox" * 9, "quick the fox"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id STRING, t STRING")
    old = df.withColumn("t", F.when(F.col("id") == "0", "a quick old text").otherwise(F.col("t")))
    postings.append(old.filter("id < 5"), F.col("t"), folder, key="id", buckets=8)
    postings.append(df.filter("id >= 5 OR id = 0"), F.col("t"), folder, key="id", buckets=8)  # the rest, and a changed text
    asked = spark.createDataFrame([(p,) for p in ["quick", "THE QUI", "fox", "b", "ünd", "xxxx", "old text", "nothing here", "quick fox", ""]], "phrase STRING")
    got = rows(postings.match(df, F.col("t"), asked, ["id"], folder, buckets=8))
    assert got == rows(phrases.match_phrases(df, F.col("t"), asked, ["id"])) and len(got) > 10


def test_longer_phrases_are_looked_up_by_every_fifth_piece(spark):
    from memengine.operators import phrases

    body, phrase = "".join(chr(97 + i * i % 23) for i in range(400)), "Needle in hay"
    texts = [body[:i] + phrase.lower() + body[i:] for i in range(12)] + [phrase * 3, phrase[1:], f"needle in ha {body}", None, "n\U0001f600" * 3 + phrase]
    rows = [(i, t) for i, t in enumerate(texts)] * 2  # keys that come twice give both rows
    df = spark.createDataFrame(rows, "id INT, t STRING")
    for asked in ([phrase], [phrase, phrase[1:], "eedle", "ha"], [phrase[1:], "needle"], ["eedle"]):
        want = sorted((i, p.lower()) for i, t in rows for p in asked if p.lower() in (t or "").lower())
        for few_short in (phrases.FEW_SHORT, 0):
            kept, phrases.FEW_SHORT = phrases.FEW_SHORT, few_short
            try:
                got = phrases.match_phrases(df, F.col("t"), spark.createDataFrame([(p,) for p in asked], "phrase STRING"), ["id"])
                assert sorted(map(tuple, got.collect())) == want and len(want) > 10
            finally:
                phrases.FEW_SHORT = kept
    cut = df.limit(1).select(F.size(phrases.strided_pieces(F.col("t"))), F.size(phrases.whole_pieces(F.col("t"), phrases.LONG_PIECE))).first()
    assert 0 < cut[0] <= cut[1] / 5 + 1


def test_a_merge_leaves_only_the_store(spark, tmp_path):
    from pathlib import Path

    from memengine.operators import bucket_store
    from memengine.runtime import checkpoint_dir

    def kept():
        top = Path(checkpoint_dir(spark).removeprefix("file:"))
        return {str(f) for f in top.rglob("*") if f.is_file() and ("delta-" in str(f) or "rdd-" in str(f))}

    def fold(table, delta):
        return delta if table is None else table.join(delta.select("k"), "k", "left_anti").unionByName(delta)

    before, folder = kept(), str(tmp_path / "store")
    for number in range(3):
        delta = spark.range(number * 10, number * 10 + 20).select(F.col("id").alias("k"), F.struct(F.lit(number).alias("n")).alias("v"))
        assert bucket_store.merge(folder, delta, fold, number, key="k", buckets=4) == [0, 1, 2, 3]
    assert bucket_store.merge(folder, delta.limit(0), fold, 3, key="k", buckets=4) == []
    with pytest.raises(ZeroDivisionError):
        bucket_store.merge(folder, delta, lambda table, delta: 1 / 0, 4, key="k", buckets=4)
    got = {r.k: r.v.n for r in bucket_store.read(spark, folder).collect()}
    assert got == {k: min(k // 10, 2) for k in range(40)} and kept() <= before


def test_large_deltas_are_stored_in_parts(spark, tmp_path, monkeypatch):
    from memengine.operators import postings

    monkeypatch.setattr(postings, "PART_BYTES", 100)
    df = spark.createDataFrame([(str(i), f"text of item number {i}" * 3) for i in range(40)] + [("40", None)], "id STRING, t STRING")
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    for name, parts in (("many", 8), ("one", 1)):
        monkeypatch.setattr(postings, "PARTS", parts)
        postings.append(df, F.col("t"), str(tmp_path / name), key="id", buckets=4)
    stored = [sorted(map(tuple, spark.read.parquet(str(tmp_path / name)).collect())) for name in ("many", "one")]
    assert stored[0] == stored[1] and len({f.name.split("-")[-2] for f in (tmp_path / "many").rglob("*.parquet")}) >= 2
    postings.append(df.limit(0), F.col("t"), str(tmp_path / "none"), key="id", buckets=4)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def test_stored_postings_are_few_and_find_every_offset(spark, tmp_path):
    from memengine.operators import postings

    folder, phrase = str(tmp_path / "postings"), "needle in hay"
    noise = "".join(f"{i:x}" for i in range(1, 400))
    texts = [noise[:i] + phrase + noise[i:] for i in range(13)] + [noise + phrase, " ".join(phrase[i : i + 7] for i in range(7)), phrase[1:] + "x" * 9]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id STRING, t STRING")
    postings.append(df, F.col("t"), folder, key="id", buckets=4)
    assert spark.read.parquet(folder).count() <= sum(len(t) / 5 + 1 for t in texts)  # not one row for each character
    asked = spark.createDataFrame([(phrase,), (phrase[1:],), (phrase[2:],)], "phrase STRING")  # the last is too short for postings
    got = rows(postings.match(df, F.col("t"), asked, ["id"], folder, buckets=4))
    assert got == sorted(((str(i), p) for i, t in enumerate(texts) for p in (phrase, phrase[1:], phrase[2:]) if p in t), key=str)


def test_search_sorts_numbers_in_many_tasks(spark):
    """Hits are sorted and ranked as two numbers, and the items searched lie in partitions that no small input puts together."""
    view, intents = make_view(spark), make_intents(spark)
    plan = search.search(intents, view)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    windows = [line for line in plan if "Window" in line]
    assert windows and not any("memory_id" in line or "last_accessed_at" in line for line in windows)
    assert search.best_places(intents, view)[2].rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism


def test_search_plan_has_no_cross_join(spark):
    plan = search.search(make_intents(spark), make_view(spark))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_rerank_by_scope_is_the_same(spark):
    """Results once per scope give the ranks that results per query give; items without details vanish, ties go by key."""
    from memengine.plans import retrieval

    at = "timestamp'2024-02-01 00:00:00'"
    found = spark.range(40).selectExpr(
        "id % 2 AS scope", "concat('m', id) AS memory_id", "element_at(array('gmail', 'chrome', 'youtube'), int(id % 3) + 1) AS source_type",
        f"IF(id % 7 = 0, NULL, {at} - make_dt_interval(int(id % 5))) AS last_accessed_at",
    )
    details = spark.range(38).selectExpr(
        "concat('m', id) AS memory_id", "id % 4 * 100 AS dwell_time_seconds", "IF(id % 3 = 0, NULL, id) AS watch_time_seconds",
        "id / 40 AS completion_rate", "IF(id % 2 = 0, 300, NULL) AS word_count",
    )
    members = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1), ("none", 9)], "query_id STRING, scope BIGINT")
    near = spark.createDataFrame([("a", "m2", 0.5), ("b", "m3", 0.1), ("b", "m5", 0.0), ("c", "m39", 0.2)], "query_id STRING, memory_id STRING, distance DOUBLE")
    now = F.lit("2024-02-15").cast("timestamp")
    per_query = members.join(found, "scope").drop("scope").join(near, ["query_id", "memory_id"], "left")
    columns = ["query_id", "memory_id", "distance", "final_score", "final_rank"]
    got = rows(retrieval.rerank_scopes(members, found, near, details, now).select(*columns))
    assert got == rows(retrieval.rerank(per_query, details, now).select(*columns)) and len(got) == 19 + 2 * 19


# --- vectors and cascade -------------------------------------------------------------------
def test_knn_paths_agree_with_brute_force(spark):
    rng = np.random.default_rng(7)
    v, q = rng.normal(size=(120, 8)).astype(np.float32), rng.normal(size=(9, 8)).astype(np.float32)
    v[50] = v[3]  # an exact copy: ties go by id
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, [1.0])], "memory_id INT, embedding ARRAY<FLOAT>")
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id INT, query_vector ARRAY<FLOAT>")
    d = ((q[:, None, :].astype(float) - v[None].astype(float)) ** 2).sum(-1)
    want = sorted((i, j, r) for i in range(9) for r, j in enumerate(sorted(range(120), key=lambda j: (d[i, j], j))[:5], 1))
    pick = ["query_id", "memory_id", "rank"]
    for options in ({}, {"matrix_bytes": 0, "block_rows": 25}):
        got = knn.knn(queries, vectors, None, 5, 8, **options)
        assert sorted(map(tuple, got.select(*pick).collect())) == want
    pairs = queries.select("query_id").crossJoin(vectors.select("memory_id")).unionByName(spark.createDataFrame([(0, 12345)], "query_id INT, memory_id INT"))
    got = knn.knn(queries, vectors, pairs, 5, 8)
    assert sorted(map(tuple, got.select(*pick).collect())) == want


def test_stage_rules(spark):
    def row(source, labels=None, sender="", domain="", cat=None, short=False):
        return (source, labels, sender, domain, cat, short)

    data = [
        row("gmail", ["CATEGORY_PERSONAL", "CATEGORY_UPDATES"]), row("gmail", ["CATEGORY_FORUMS"]), row("gmail", sender="cs.ac.uk"),
        row("chrome", domain="cs.ac.uk"), row("chrome", domain="github.com"), row("chrome", domain="arxiv.org"), row("chrome", domain="www.github.com"),
        row("youtube", short=True), row("youtube", cat=28), row("youtube", cat=17),
    ]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(data)], "n INT, source_type STRING, gmail_labels ARRAY<STRING>, sender_domain STRING, domain STRING, youtube_category_id INT, is_short BOOLEAN")
    out = classify.classify(df, dimensions.domain_map(spark)).orderBy("n").collect()
    assert [(r.category, r.method) for r in out] == [
        ("personal", "structural"), ("misc", "structural"), ("study", "structural"), ("misc", "llm"), ("work", "structural"),
        ("study", "domain"), ("misc", "llm"), ("entertainment", "structural"), ("study", "structural"), ("misc", "llm"),
    ]
    assert dimensions.domain_map(spark).count() == 204


def test_centroid_bounds_are_strict(spark):
    def toward(a, b):
        return [a, b, float(np.sqrt(max(0.0, 1 - a * a - b * b)))]

    df = spark.createDataFrame([(0, toward(0.60, 0.50)), (1, toward(0.60, 0.55)), (2, toward(0.55, 0.1))], "n INT, embedding ARRAY<DOUBLE>")
    centroids = spark.createDataFrame([("x", [1.0, 0.0, 0.0]), ("y", [0.0, 1.0, 0.0])], "category STRING, centroid ARRAY<DOUBLE>")
    out = [r.stage3 for r in classify.centroid_group(df, centroids).orderBy("n").collect()]
    assert out[0].category == "x" and out[0].confidence == pytest.approx(0.6)
    assert out[1] is None and out[2] is None


def picky_model():
    """Built in a function, so it travels to the workers by value."""

    class Picky:
        def load(self):
            def model(texts):
                if any("bad" in t for t in texts):
                    raise ValueError("cannot read")
                return np.array([[len(t), 1.0] for t in texts])

            return model

    return Picky()


def test_one_bad_text_costs_only_itself(spark):
    df = spark.createDataFrame([(0, "a"), (1, "bad"), (2, " ccc "), (3, None)], "n INT, t STRING").coalesce(1)
    out = classify.embed(df, "t", picky_model(), dim=2, blank_error="blank").orderBy("n").collect()
    assert [r.embed_error for r in out] == [None, "cannot read", None, "blank"]
    assert [list(r.embedding) if r.embedding else None for r in out] == [[1.0, 1.0], None, [3.0, 1.0], None]


def test_scored_content_prefers_rich_element(spark):
    page = "<body><nav>menu menu menu</nav><div>short</div><article><h2>Head</h2><p>one &amp; two</p><p>three</p><form>no</form></article></body>"
    out = text_jobs.clean_page(spark.createDataFrame([(page,)], "h STRING"), "h", "scored").first()
    assert out.headings == ["Head"]
    assert out.clean_text == "short\nHead\none & two\nthree" or out.clean_text == "Head\none & two\nthree"


# --- retrieval rules --------------------------------------------------------------------------
def widen_one(spark, **kw):
    base = dict(query_id="q", sources=["gmail"], time_filter=None, query_clean="machine learning", skip_postgres_filter=False, full_faiss_scan=False, attempt=0)
    schema = "query_id STRING, sources ARRAY<STRING>, time_filter STRING, query_clean STRING, skip_postgres_filter BOOLEAN, full_faiss_scan BOOLEAN, attempt INT"
    row = {**base, **kw}
    return retrieval.widen(spark.createDataFrame([tuple(row.values())], schema)).first()


def test_widen_steps(spark):
    assert widen_one(spark, time_filter="2026-04-18").time_filter == "2026-04-14T00:00:00"
    assert widen_one(spark, time_filter="soon").time_filter is None
    assert widen_one(spark).sources == K.SOURCES
    assert widen_one(spark, sources=["youtube", "gmail", "chrome"]).query_clean == "machine"
    second = widen_one(spark, attempt=1, time_filter="2026-04-18")
    assert (second.time_filter, second.sources, second.query_clean, second.attempt) == (None, K.SOURCES, "machine", 2)
    third = widen_one(spark, attempt=2)
    assert third.skip_postgres_filter and third.full_faiss_scan and third.attempt == 3


@pytest.mark.parametrize(
    "found,want",
    [([], "empty"), ([("chrome", 0.9), ("chrome", 0.9)], "empty"), ([("gmail", 0.9)], "weak"), ([("gmail", 0.34), ("gmail", 0.1)], "weak"), ([("gmail", 0.35), ("gmail", 0.1)], "strong")],
)
def test_quality_order(spark, found, want):
    results = spark.createDataFrame([("q", s, T0, x) for s, x in found], "query_id STRING, source_type STRING, created_at TIMESTAMP, similarity DOUBLE")
    intents = spark.createDataFrame([("q", ["gmail"], None)], "query_id STRING, sources ARRAY<STRING>, time_filter STRING")
    assert retrieval.quality(results, intents).first().quality == want


def test_items_have_their_own_details(spark):
    t = Tables(spark, SMALL)
    details = views.with_details(t.searchable.limit(5), t.wide)
    assert {"domain", "thread_id", "video_id", "last_accessed_at"} <= set(details.columns)
    assert isinstance(details.first(), Row)


def test_null_keys_are_one_key(spark):
    from memengine.operators import sequences

    rows = [(None, "2024-01-01 00:00:00"), (None, "2024-01-02 00:00:00"), (None, "2024-01-03 00:00:00"), ("a", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "k string, t string").withColumn("t", F.to_timestamp("t"))
    got = sequences.neighbour(df, ["k"], ["t"], [], "before").orderBy("k", "t").collect()
    assert [r.before is None for r in got] == [True, False, False, True]


def test_null_content_keeps_its_line(spark):
    from memengine.operators import messages

    df = spark.createDataFrame([("s", 1, "user", "hi"), ("s", 2, "assistant", None)], "session_id string, seq int, role string, content string")
    assert messages.history_text(df).first().history == "User: hi\nAssistant: "


def test_hours_before_1970_have_leaves(spark):
    from memengine.operators import search

    df = spark.sql("SELECT timestamp(x) AS t FROM VALUES ('0001-01-01'), ('1900-01-01'), ('1969-12-31 23:30:00'), ('1970-01-01'), ('9999-01-01') v(x)")
    hours = [r[0] for r in df.select(search._hour(F.col("t"))).collect()]
    assert hours == sorted(hours) and hours[0] >= 0 and hours[-1] < 1 << search.HOUR_BITS and hours[2] + 1 == hours[3]


def test_many_centroids_by_search(spark):
    rng = np.random.default_rng(3)
    vectors = [(str(n), [float(x) for x in v]) for n, v in enumerate(rng.normal(size=(40, 4)))]
    df = spark.createDataFrame([*vectors, ("zero", [0.0] * 4), ("none", None)], "memory_id STRING, embedding ARRAY<DOUBLE>")
    centroids = spark.createDataFrame(
        [(f"c{n}", [float(x) for x in v]) for n, v in enumerate(rng.normal(size=(7, 4)))], "category STRING, centroid ARRAY<DOUBLE>"
    )

    def found(few):
        scored = classify.centroid_scores(df, centroids, few=few).filter("scores.best IS NOT NULL").orderBy("memory_id")
        return [(r[0], r.best if r.best_score > 0 else None, round(r.best_score, 9), round(r.second_score, 9))
                for r in scored.select("memory_id", "scores.*").collect()]

    assert found(1000) == found(0) and len(found(0)) == 41


# --- the store as files -------------------------------------------------------------
def test_a_merge_leaves_other_buckets_alone(spark, tmp_path):
    from memengine.operators import bucket_store

    folder = str(tmp_path / "items")
    fold = lambda table, delta: delta if table is None else table.join(delta, "memory_id", "left_anti").unionByName(delta)
    first = spark.range(200).selectExpr("CAST(id AS STRING) AS memory_id", "id AS v")
    bucket_store.merge(folder, first, fold, 0, buckets=16)
    files = {p.name: p.parent.name for p in (tmp_path / "items").rglob("*.parquet")}
    delta = spark.createDataFrame([("3", 33), ("new", 1)], "memory_id STRING, v BIGINT")
    touched = bucket_store.merge(folder, delta, fold, 1, buckets=16)
    after = {p.name: p.parent.name for p in (tmp_path / "items").rglob("*.parquet")}
    changed = {f"bucket={b}" for b in touched}
    assert 1 <= len(touched) <= 2 and {n for n, b in files.items() if b not in changed} == {n for n, b in after.items() if b not in changed}
    assert not {n for n, b in files.items() if b in changed} & set(after)
    want = {str(i): i for i in range(200)} | {"3": 33, "new": 1}
    assert {r.memory_id: r.v for r in bucket_store.read(spark, folder).collect()} == want
    # sums are not safe to repeat: the number of the merge tells
    add = lambda table, delta: delta.unionByName(table).groupBy("memory_id").agg(F.sum("v").alias("v"))
    bucket_store.merge(folder, delta, add, 2, buckets=16, replay_safe=False)
    assert bucket_store.merge(folder, delta, add, 2, buckets=16, replay_safe=False) == []
    assert {r.memory_id: r.v for r in bucket_store.read(spark, folder).collect()} == want | {"3": 66, "new": 2}
    assert bucket_store.merge(folder, delta.limit(0), fold, 3, buckets=16) == []


def test_expired_days_go_as_folders(spark, tmp_path):
    from memengine.operators import bucket_store

    folder = str(tmp_path / "messages")
    log = spark.createDataFrame([("s", n, T0 + timedelta(days=n)) for n in range(5)], "session_id STRING, n INT, created_at TIMESTAMP")
    bucket_store.save_days(log, folder)
    files = {p.name for p in (tmp_path / "messages").rglob("*.parquet")}
    assert bucket_store.drop_days(spark, folder, "2024-01-03") == ["2024-01-01", "2024-01-02"]
    left = spark.read.parquet(folder)
    assert sorted(r.n for r in left.collect()) == [2, 3, 4] and {p.name for p in (tmp_path / "messages").rglob("*.parquet")} < files
    assert bucket_store.drop_days(spark, folder, "2024-01-03") == []


def test_enrichment_rewrites_only_its_buckets(spark, tmp_path):
    from memengine.operators import bucket_store

    folder = str(tmp_path / "items")
    items = store.fold_items(None, item_rows(spark, [("A", "x")]).withColumn("memory_id", F.explode(F.array(*[F.lit(f"k{i}") for i in range(60)])))).drop("created_new")
    bucket_store.merge(folder, items, lambda table, delta: delta, 0, buckets=8)
    done = spark.createDataFrame([("k7", "work", "centroid", 0.9, ["w"])], "memory_id STRING, category STRING, method STRING, confidence DOUBLE, auto_keywords ARRAY<STRING>")
    assert len(bucket_store.merge(folder, done, store.write_enrichment, 1, buckets=8)) == 1
    stored = {r.memory_id: r for r in bucket_store.read(spark, folder).collect()}
    assert len(stored) == 60 and (stored["k7"].preprocessed, stored["k7"].classified_by) == (True, "centroid")
    assert not stored["k8"].preprocessed


def test_flat_text_of_nested_values(spark):
    from memengine.functions import text as X

    df = spark.sql("SELECT named_struct('a', 'x', 'b', array(1, NULL), 'c', map('k', array('y', 'z'))) AS v UNION ALL SELECT NULL")
    assert [r[0] for r in df.select(X.flatten_text(F.col("v"), df.schema["v"].dataType)).collect()] == ["x 1  y z", ""]


def test_grid_cells_meet_in_many_partitions(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 11), float(i)]) for i in range(300)], "memory_id long, embedding array<double>")
    queries = vectors.filter("memory_id % 3 = 0").select(F.col("memory_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        whole, grid = (sorted(map(tuple, knn.knn(queries, vectors, k=5, dim=3, **o).collect())) for o in ({}, {"matrix_bytes": 0, "block_rows": 25}))
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    assert len(whole) == 500 and grid == whole


def test_only_the_text_goes_to_the_model_in_bounded_batches(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        df = spark.range(5).select(F.col("id").alias("n"), F.lit("raw").alias("raw_text"), F.lit("ab").alias("t"))
        out = classify.embed(df, "t", picky_model(), dim=2)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 16 << 20
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "MapInPandas" not in plan and plan.count("ArrowEvalPython") == 1 and out.columns == ["n", "raw_text", "t", "embedding", "embed_error"]
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)


def test_long_phrases_are_anchored_by_long_pieces(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcd ") for _ in range(2000)) for _ in range(40)]
    asked = [t[100:112] for t in texts[::4]] + ["ab", "xyz", "A|b", texts[0][:7], "Å" * 9, "no such phrase"] + [c * 8 for c in "abcd"]
    rows = spark.createDataFrame(list(enumerate([*texts, "å" * 20, None])), "k INT, t STRING")
    wanted = spark.createDataFrame([(p,) for p in asked], "phrase STRING")
    want = sorted((k, p.lower()) for k, t in enumerate([*texts, "å" * 20]) for p in set(asked) if p.lower() in t.lower())
    for few_short in (phrases.FEW_SHORT, 0):
        kept, phrases.FEW_SHORT = phrases.FEW_SHORT, few_short
        try:
            assert sorted(map(tuple, phrases.match_phrases(rows, F.col("t"), wanted, ["k"]).collect())) == want
        finally:
            phrases.FEW_SHORT = kept
    long = wanted.filter(F.char_length("phrase") >= 8).select(F.lower("phrase").alias("phrase"))
    compared = [phrases._hits(rows.withColumnRenamed("t", "_text"), long, n).count() for n in (phrases.PIECE, phrases.LONG_PIECE)]
    assert compared[1] <= 2 * sum(len(p) >= 8 for _, p in want) < compared[0] / 3


def test_long_lists_stand_in_no_plan(spark):
    """Bounds and anchors of many queries: a plan is as long for 2000 of them as for 20."""
    view = make_view(spark)

    def length(n):
        asked = spark.range(n).selectExpr(
            "CAST(id AS STRING) AS query_id", "array('all') AS sources", "false AS skip_postgres_filter",
            "CAST(timestamp_micros(1704067200000000 + id * 977) AS STRING) AS time_filter",
            "IF(id % 2 = 0, '', concat('phrase of ', id)) AS query_clean",
        )
        return len(search.search(asked, view)._jdf.queryExecution().toString())

    assert length(2000) < 1.2 * length(200)


def test_quality_of_scopes_equals_that_of_pairs(spark):
    view, intents = make_view(spark), make_intents(spark)
    members, found = search.search_scopes(intents, view)
    pairs = search.expanded(members, found)
    near = pairs.filter("rank <= 2").select("query_id", "memory_id", (F.col("rank") / 4).alias("similarity"))
    want = retrieval.quality(pairs.join(near, ["query_id", "memory_id"], "left"), intents)
    got = retrieval.quality_of_scopes(intents, members, found, near)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.filter("quality = 'strong'").count() + got.filter("quality = 'weak'").count() > 0
