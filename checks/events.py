"""Event feeds: summaries, progress, history, streams."""

from pyspark.sql import functions as F

from checks.tables import query
from sparkdocs.operators import events as E
from sparkdocs.session import fresh_dir
from sparkdocs.streaming.event_feed import (
    current_counts, current_history, final_counts, start_final_counts, start_history, start_history_state, start_stage_counts,
    state_history,
)


@query(
    "ingest_summary",
    "SELECT source AS scope_key, count(*) AS total_files, count(*) FILTER (WHERE status = 'completed' AND file_type <> 'PDF') AS processed, "
    "count(*) FILTER (WHERE status = 'completed' AND file_type = 'PDF') AS skipped, count(*) FILTER (WHERE status = 'failed') AS errors "
    "FROM {docs} GROUP BY source",
)
def _(t):
    outcome = F.when(F.col("status") == "failed", "error").when(F.col("file_type") == "PDF", "skipped").otherwise("processed")
    return E.ingest_summary(t.docs.select(F.col("source").alias("scope_key"), outcome.alias("outcome")))


@query(
    "progress",
    "SELECT source, file_path, row_number() OVER w AS file_no, count(*) OVER (PARTITION BY source) AS total_files, "
    "CAST(floor(row_number() OVER w / count(*) OVER (PARTITION BY source) * 100) AS INTEGER) AS progress "
    "FROM {docs} WINDOW w AS (PARTITION BY source ORDER BY file_path)",
)
def _(t):
    return E.progress(t.docs.select("source", "file_path"), "source", "file_path")


_HISTORY = """
    SELECT session_id, event_no, stage, message FROM (
        SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_no DESC) AS r
        FROM {ingest_events} WHERE stage <> 'debug_state') x
    WHERE r <= 
"""


@query("event_history", _HISTORY + "1000")
def _(t):
    return E.event_history(t.ingest_events).select("session_id", "event_no", "stage", "message")


@query("event_history_short", _HISTORY + "10")
def _(t):
    return E.event_history(t.ingest_events, keep=10).select("session_id", "event_no", "stage", "message")


@query(
    "latest_session",
    "SELECT session_id, strftime(started_at, '%Y-%m-%dT%H:%M:%SZ') AS started FROM "
    "(SELECT session_id, min(ts) AS started_at FROM {ingest_events} GROUP BY session_id) s ORDER BY started_at DESC, session_id DESC LIMIT 1",
)
def _(t):
    found = E.latest_session(t.ingest_events)
    return found.select("session_id", F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("started"))


_COUNTS = "SELECT session_id, stage, count(*) AS n_events FROM {ingest_events} GROUP BY session_id, stage"


@query("event_stage_counts", _COUNTS)
def _(t):
    return E.stage_counts(t.ingest_events)


def _event_stream(t):
    """The events in several files, read as a stream one file per micro-batch."""
    base = fresh_dir(t.spark, "events")
    t.ingest_events.repartition(3).write.parquet(f"{base}/in")
    stream = t.spark.readStream.schema(t.ingest_events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    return base, stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("event_stage_counts_stream", _COUNTS)
def _(t):
    base, stream = _event_stream(t)
    start_stage_counts(stream, f"{base}/feed", f"{base}/offsets").awaitTermination()
    return current_counts(t.spark, f"{base}/feed")


@query("event_history_stream", _HISTORY + "10")
def _(t):
    base, stream = _event_stream(t)
    start_history(stream, f"{base}/feed", f"{base}/offsets", keep=10, whole_every=2).awaitTermination()
    return current_history(t.spark, f"{base}/feed", whole_every=2).select("session_id", "event_no", "stage", "message")


@query("event_history_state", _HISTORY + "10")
def _(t):
    # Files come in any order of time, so no event may count as late here.
    base, stream = _event_stream(t)
    start_history_state(stream, f"{base}/feed", f"{base}/offsets", keep=10, late="9999 days").awaitTermination()
    return state_history(t.spark, f"{base}/feed").select("session_id", "event_no", "stage", "message")


@query(
    "event_counts_final",
    """
    SELECT session_id, stage, count(*) AS n_events, strftime(min(min(ts)) OVER (PARTITION BY session_id), '%Y-%m-%dT%H:%M:%SZ') AS started
    FROM {ingest_events} GROUP BY session_id, stage
    """,
)
def _(t):
    # Errors come twice, in another batch; an event far ahead closes all sessions.
    base = fresh_dir(t.spark, "final")
    t.ingest_events.repartition(3).write.parquet(f"{base}/in")
    t.ingest_events.filter("stage = 'file_error'").coalesce(1).write.mode("append").parquet(f"{base}/in")
    ahead = t.ingest_events.limit(1).select(
        *[(F.lit("~ahead") if c == "session_id" else F.col("ts") + F.expr("INTERVAL '60' YEAR") if c == "ts" else F.col(c)).alias(c) for c in t.ingest_events.columns]
    )
    stream = t.spark.readStream.schema(t.ingest_events.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false")
    events = stream.parquet(f"{base}/in").withColumn("ts", F.col("ts").cast("timestamp"))

    def go():
        start_final_counts(events, f"{base}/feed", f"{base}/offsets", late="9999 days", gap="3000 days").awaitTermination()

    go()
    ahead.write.mode("append").parquet(f"{base}/in")
    go()
    started = F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("started")
    return final_counts(t.spark, f"{base}/feed").select("session_id", "stage", "n_events", started)
