"""Streams over several files and batches must leave what one batch over all rows gives."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from curatrix.operators import quality as q
from curatrix.session import new_shared_path
from curatrix.streaming import jobs as st

START = datetime(2024, 1, 1)
ROWS = [(i, i % 4 if i % 3 else 1, START + timedelta(minutes=i * 7), ["view", "error"][i % 2], float(i % 20)) for i in range(300)]
SCHEMA = "event_id int, user_id int, ts timestamp_ntz, event_type string, value double"


@pytest.fixture(scope="module")
def files(spark):
    """Time-ordered files, so that the watermark moves from batch to batch."""
    path = new_shared_path(spark, "events-in")
    for i in range(3):
        spark.createDataFrame(ROWS[i * 100:(i + 1) * 100], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, files):
    return st.read_files(spark, files, spark.read.parquet(files).schema, files_per_trigger=1)


def rules():
    return [q.expr_rule("floor", "value >= 5"), q.expr_rule("fine", "event_type <> 'error'", "warn")]


def test_enforce_over_batches_equals_batch(spark, files):
    base = new_shared_path(spark, "enforce")
    st.stream_enforce(stream(spark, files), rules, base).awaitTermination()
    good = {r.event_id for r in st.read_sink(spark, f"{base}/good").collect()}
    bad = {r.event_id for r in st.read_sink(spark, f"{base}/quarantine").collect()}
    assert bad == {r[0] for r in ROWS if r[4] < 5} and good | bad == {r[0] for r in ROWS} and not good & bad
    # a second start finds nothing new
    st.stream_enforce(stream(spark, files), rules, base).awaitTermination()
    assert st.read_sink(spark, f"{base}/good").count() == len(good)


def test_repeated_events_are_staged_once(spark, files):
    base = new_shared_path(spark, "stage")
    twice = stream(spark, files).unionByName(stream(spark, files))
    st.stage_events(twice, "event_id", "ts", base).awaitTermination()
    ids = [r.event_id for r in st.read_sink(spark, f"{base}/events").collect()]
    assert sorted(ids) == [r[0] for r in ROWS]


def test_late_events_and_late_repeats_are_staged_once(spark):
    path, base = new_shared_path(spark, "late-in"), new_shared_path(spark, "late")
    days = [(i, 1, START + timedelta(days=i), "view", 1.0) for i in range(30)]
    nobody = (None, 1, START, "view", 1.0)
    for part in (days[20:], [*days[:10], nobody], [*days[10:20], *days[25:], nobody], days[:12]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    st.stage_events(stream(spark, path), "event_id", "ts", base).awaitTermination()
    ids = [r.event_id for r in st.read_sink(spark, f"{base}/events").collect()]
    assert ids.count(None) == 1 and sorted(i for i in ids if i is not None) == list(range(30))


def test_staging_calls_no_python_per_key(spark):
    """Many keys, each several times in a batch and over the batches: the earliest row of its first batch is staged, in vectorised steps."""
    path, base = new_shared_path(spark, "keys-in"), new_shared_path(spark, "keys")
    at = "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, {}, 0)"
    for i in range(2):
        rows = spark.sql(f"SELECT CAST(id % 20000 AS INT) AS event_id, {i} AS user_id, {at.format('CAST((id DIV 20000 + 2) % 3 AS INT)')} AS ts, 'v' AS event_type, CAST(id AS DOUBLE) AS value FROM range(60000)")
        rows.select("event_id", "user_id", "ts", "event_type", "value").coalesce(1).write.mode("append").parquet(path)
    query = st.stage_events(stream(spark, path), "event_id", "ts", base)
    query.awaitTermination()
    assert "FlatMapGroupsInPandasWithState" not in query._jsq.explainInternal(False)
    got = st.read_sink(spark, f"{base}/events").agg(F.count("*"), F.countDistinct("event_id"), F.max("user_id") - F.min("user_id"), F.min("value"), F.max("value")).first()
    assert tuple(got) == (20000, 20000, 0, 20000.0, 39999.0)


def test_current_state_keeps_the_two_newest(spark, files):
    base = new_shared_path(spark, "state")
    st.current_state(stream(spark, files), "user_id", ["ts", "event_id"], ["value"], base).awaitTermination()
    got = {r.user_id: (r.event_id, r.value, r.before_value) for r in st.read_state(spark, base, "user_id").collect()}
    want = {}
    for user in {r[1] for r in ROWS}:
        mine = sorted((r[2], r[0], r[4]) for r in ROWS if r[1] == user)
        want[user] = (mine[-1][1], mine[-1][2], mine[-2][2])
    assert got == want


def test_volume_counts_closed_windows(spark, files):
    base = new_shared_path(spark, "volume")
    st.append_sink(st.event_volume(stream(spark, files), "ts", "event_type"), base, "volume").awaitTermination()
    got = {(r.window_start, r.event_type): r.n for r in st.read_sink(spark, f"{base}/volume").collect()}
    last = max(r[2] for r in ROWS) - timedelta(minutes=10)
    want = {}
    for r in ROWS:
        w = r[2].replace(minute=0)
        if w + timedelta(hours=1) <= last:
            want[(w, r[3])] = want.get((w, r[3]), 0) + 1
    assert got == want


def test_open_windows_and_sessions_complete_the_closed_ones(spark, files):
    base = new_shared_path(spark, "whole")
    st.append_sink(st.event_volume(stream(spark, files), "ts", "event_type"), base, "volume").awaitTermination()
    closed, still = st.read_sink(spark, f"{base}/volume"), st.open_windows(spark, base, "event_type")
    want = {}
    for r in ROWS:
        want[(r[2].replace(minute=0), r[3])] = want.get((r[2].replace(minute=0), r[3]), 0) + 1
    assert still.count() and {(r.window_start, r.event_type): r.n for r in closed.unionByName(still).collect()} == want
    base = new_shared_path(spark, "sessions")
    st.append_sink(st.session_activity(stream(spark, files), "ts", "user_id", "2 hours"), base, "sessions").awaitTermination()
    assert st.read_sink(spark, f"{base}/sessions").unionByName(st.open_sessions(spark, base, "user_id")).agg(F.sum("events")).first()[0] == len(ROWS)


def test_late_events_are_kept_aside(spark):
    path, base = new_shared_path(spark, "late-in"), new_shared_path(spark, "late")
    early, late = [(i, 1, START + timedelta(hours=i), "view", 1.0) for i in range(30)], [(100, 1, START + timedelta(hours=2, minutes=5), "view", 1.0), (101, 1, START + timedelta(hours=29, minutes=30), "view", 1.0)]
    between = [(200, 1, START + timedelta(hours=29, minutes=10), "view", 1.0)]
    for part in (early, between, late):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    st.late_events(stream(spark, path), "ts", "1 hour", "10 minutes", base).awaitTermination()
    assert [r.event_id for r in st.read_sink(spark, f"{base}/late").collect()] == [100]
    counts = new_shared_path(spark, "counts")
    st.append_sink(st.event_volume(stream(spark, path), "ts", "event_type"), counts, "volume").awaitTermination()
    assert st.read_sink(spark, f"{counts}/volume").unionByName(st.open_windows(spark, counts, "event_type")).agg(F.sum("n")).first()[0] == 32


def test_the_first_of_equal_events_is_staged_whatever_their_types(spark):
    path, base = new_shared_path(spark, "ties-in"), new_shared_path(spark, "ties")
    rows = [(2**60 + 1, START, "b", 0.1, None), (2**60 + 1, START, "a", 0.2, START.date()), (None, START, "n", None, None), (2**60 + 1, START - timedelta(days=1), "late", 1e-300, None)]
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, "k long, ts timestamp_ntz, s string, v double, d date").coalesce(1).write.mode("append").parquet(path)
    st.stage_events(stream(spark, path), "k", "ts", base).awaitTermination()
    assert sorted(((r.k, r.s, r.v, r.d) for r in st.read_sink(spark, f"{base}/events").collect()), key=str) == [(2**60 + 1, "a", 0.2, START.date()), (None, "n", None, None)]


def test_incremental_sync_adds_each_triple_once(spark, files):
    base = new_shared_path(spark, "sync")
    none = F.lit(None).cast("string")
    t = stream(spark, files).select(
        F.col("user_id").cast("string").alias("subject"), F.lit("p").alias("predicate"), F.col("event_type").alias("object"), F.lit(False).alias("object_is_uri"),
        none.alias("language"), none.alias("datatype"), F.lit("g").alias("context"))
    st.incremental_sync(spark, t, base).awaitTermination()
    rows = [(r.subject, r.object) for r in st.read_sink(spark, f"{base}/triples").collect()]
    assert sorted(rows) == sorted({(str(r[1]), r[3]) for r in ROWS})


def test_stale_keys(spark, files):
    base = new_shared_path(spark, "fresh")
    st.stream_freshness(stream(spark, files), "user_id", "ts", base).awaitTermination()
    end = max(r[2] for r in ROWS)
    got = {r.user_id for r in st.stale_keys(spark, base, "user_id", end, 600).collect()}
    assert got == {u for u in {r[1] for r in ROWS} if max(r[2] for r in ROWS if r[1] == u) < end - timedelta(seconds=600)}
