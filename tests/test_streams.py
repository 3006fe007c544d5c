from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from sparkdocs.streaming.event_feed import (
    current_counts, current_history, final_counts, start_final_counts, start_history, start_history_state, start_stage_counts,
    state_history,
)

SCHEMA = "session_id string, event_no long, ts timestamp, level string, stage string, message string"


def event(session, n, stage="file_success"):
    return (session, n, datetime(2025, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=n), "info", stage, f"m{n}")


def feed_batches(spark, rows, batches):
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(rows)


def test_history_keeps_the_latest_over_batches(spark, tmp_path):
    rows, feed = str(tmp_path / "rows"), str(tmp_path / "feed")
    batches = [
        [event("a", 1), event("a", 2), event("b", 3)],
        [event("a", 4), event("a", 5, "debug_state")],
        [event("c", 6)],
        [event("a", 7), event("a", 8), event("a", 9)],
    ]
    for batch in batches:
        feed_batches(spark, rows, [batch])
        stream = spark.readStream.schema(SCHEMA).parquet(rows)
        start_history(stream, feed, str(tmp_path / "offsets"), keep=3, whole_every=2).awaitTermination()
    got = sorted((r.session_id, r.event_no) for r in current_history(spark, feed, whole_every=2).collect())
    assert got == [("a", 7), ("a", 8), ("a", 9), ("b", 3), ("c", 6)]
    # Starting again from the first offset rewrites batch folders instead of adding to them.
    stream = spark.readStream.schema(SCHEMA).parquet(rows)
    start_history(stream, str(tmp_path / "feed2"), str(tmp_path / "offsets2"), keep=3).awaitTermination()
    again = sorted((r.session_id, r.event_no) for r in current_history(spark, str(tmp_path / "feed2")).collect())
    assert again == got


def test_counts_follow_the_stream(spark, tmp_path):
    rows, feed = str(tmp_path / "rows"), str(tmp_path / "feed")
    for batch in ([event("a", 1), event("a", 2)], [event("a", 3), event("b", 4, "done")]):
        feed_batches(spark, rows, [batch])
        stream = spark.readStream.schema(SCHEMA).parquet(rows)
        start_stage_counts(stream, feed, str(tmp_path / "offsets")).awaitTermination()
    got = {(r.session_id, r.stage): r.n_events for r in current_counts(spark, feed).collect()}
    assert got == {("a", "file_success"): 3, ("b", "done"): 1}


def state_rows(spark, checkpoint):
    return spark.read.format("statestore").load(checkpoint).count()


def test_history_in_state_ends_with_the_session(spark, tmp_path):
    rows, feed, offsets = (str(tmp_path / n) for n in ("rows", "feed", "offsets"))
    batches = [
        [event("a", 1), event("a", 2), event("b", 3), event("a", 4, "debug_state")],
        [event("a", 6), event("a", 5), event("b", 7, "done")],
        [event("a", 300), event("c", 301)],
        [event("c", 900)],
    ]
    held = []
    for batch in batches:
        feed_batches(spark, rows, [batch])
        stream = spark.readStream.schema(SCHEMA).parquet(rows)
        start_history_state(stream, feed, offsets, keep=3, late="10 seconds", linger=60).awaitTermination()
        held.append(state_rows(spark, offsets))
    got = sorted((r.session_id, r.event_no) for r in state_history(spark, feed).collect())
    assert got == [("a", 5), ("a", 6), ("a", 300), ("b", 3), ("b", 7), ("c", 301), ("c", 900)]
    # The ended session leaves the state when the watermark has passed; its rows stay in the feed.
    assert held[:2] == [2, 2] and held[-1] == 2


def test_final_counts_come_once(spark, tmp_path):
    rows, feed, offsets = (str(tmp_path / n) for n in ("rows", "feed", "offsets"))
    batches = [
        [event("a", 1), event("a", 2), event("a", 2), event("b", 3, "odd")],
        [event("a", 1), event("a", 5, "done"), event("b", 6, "odd")],
        [event("z", 3000)],
        [event("a", 4), event("z", 3001)],  # too late
        [event("y", 9000)],
    ]
    for batch in batches:
        feed_batches(spark, rows, [batch])
        stream = spark.readStream.schema(SCHEMA).parquet(rows)
        start_final_counts(stream, feed, offsets, late="100 seconds", gap="60 seconds").awaitTermination()
    got = sorted((r.session_id, r.stage, r.n_events) for r in final_counts(spark, feed).collect())
    assert got == [("a", "done", 1), ("a", "file_success", 2), ("b", "other", 2), ("z", "file_success", 2)]
    assert final_counts(spark, str(tmp_path / "none")).count() == 0


def test_history_crosses_to_pandas_as_one_value(spark, tmp_path):
    import json

    import pandas as pd

    from sparkdocs.streaming import event_feed

    class State:
        exists = hasTimedOut = False
        got = None

        def update(self, value):
            self.got = value

    sent = [{"event_no": n, "us": 10**6 * n, "level": "info", "stage": "file_success", "message": f"m{n}"} for n in range(9)]
    frames = [pd.DataFrame({"session_id": "a", "event": [json.dumps(e) for e in part]}) for part in (sent[:5], sent[5:])]
    state = State()
    out = list(event_feed._bounded(3, 1000)(("a",), frames, state))
    assert [list(f.columns) for f in out] == [["session_id", "history"]] and [len(f) for f in out] == [1]
    assert [e[1] for e in json.loads(out[0]["history"][0])] == [8, 7, 6] and state.got == (out[0]["history"][0], None)
    # Odd values come back as they were.
    rows, feed, offsets = (str(tmp_path / n) for n in ("rows", "feed", "offsets"))
    odd = 'a "quoted" \\ line\n\t\u0001 end, [1] {"x": null} 页 😀'
    early = datetime(2024, 1, 1, 0, 0, 0, 123457, tzinfo=timezone.utc)
    batch = [
        ("a", 1, early, None, None, odd), ("a", None, early, "info", "file_error", None), ("a", 2**53 + 1, early, "", "file_skip", ""),
        ("a", 4, early, "info", "debug_state", "hidden"),
    ]
    feed_batches(spark, rows, [batch])
    start_history_state(spark.readStream.schema(SCHEMA).parquet(rows), feed, offsets, keep=3, late="10 seconds").awaitTermination()
    got = [tuple(r) for r in state_history(spark, feed).withColumn("ts", F.unix_micros("ts")).select(
        "session_id", "event_no", "ts", "level", "stage", "message").collect()]
    us = int(early.timestamp()) * 10**6 + 123457
    assert set(got) == {(s, n, us, lv, st, m) for s, n, _, lv, st, m in batch[:3]} and len(got) == 3
