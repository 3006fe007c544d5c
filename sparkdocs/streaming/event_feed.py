"""Live views of ingest events: counts per stage, and the bounded history of each session.

Each micro-batch writes its own folder, overwritten if the batch comes again; readers take the rows of
the last batch that touched a session.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkdocs import schemas as S
from sparkdocs.operators.events import event_history, stage_counts

WHOLE_EVERY = 50

_EVENT = "session_id string, event_no long, ts timestamp, level string, stage string, message string"


def start_stage_counts(events: DataFrame, feed: str, checkpoint: str) -> StreamingQuery:
    """Running counts per session and stage (update mode) into `feed`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{feed}/batch={batch_id}")

    return (
        stage_counts(events).writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def current_counts(spark: SparkSession, feed: str) -> DataFrame:
    """Latest count per session and stage."""
    updates = spark.read.parquet(feed)
    return updates.groupBy("session_id", "stage").agg(F.max_by("n_events", "batch").alias("n_events"))


def _kept(spark: SparkSession, feed: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"{_EVENT}, batch long").parquet(feed)
    except AnalysisException:
        return None


def current_history(
    spark: SparkSession, feed: str, before: int | None = None, whole_every: int = WHOLE_EVERY
) -> DataFrame:
    """Kept events of every session, as of the last batch or of the last one before `before`.

    Reads from the last batch folder that holds all sessions.
    """
    kept = _kept(spark, feed)
    if kept is None:
        return spark.createDataFrame([], _EVENT)
    if before is not None:
        kept = kept.filter(F.col("batch") < before)
        newest = before - 1
    else:
        newest = kept.agg(F.max("batch")).first()[0] or 0
    kept = kept.filter(F.col("batch") >= newest - newest % whole_every)
    last = kept.groupBy("session_id").agg(F.max("batch").alias("batch"))
    return kept.join(last, ["session_id", "batch"]).drop("batch")


def start_history(
    events: DataFrame,
    feed: str,
    checkpoint: str,
    keep: int = S.EVENTS_KEPT_PER_SESSION,
    whole_every: int = WHOLE_EVERY,
) -> StreamingQuery:
    """Keep the latest events per session in `feed`.

    The latest of old and new events are the latest of those kept so far and the new ones, so a batch
    reads what is kept of the sessions it touches, and writes those. Every `whole_every`-th batch writes
    all sessions, which bounds what readers have to read. The salted ranking of `event_history` keeps a
    busy session off a single task.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.select("session_id", "event_no", "ts", "level", "stage", "message")
        old = current_history(spark, feed, batch_id, whole_every)
        if batch_id % whole_every:
            old = old.join(new.select("session_id").distinct(), "session_id", "left_semi")
        event_history(old.unionByName(new), keep).write.mode("overwrite").parquet(f"{feed}/batch={batch_id}")

    return (
        events.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


# Stages that an ingest run reports.
STAGES = [
    "scan_start", "scan_complete", "file_processing", "file_success", "file_skip", "file_error", "cancelled", "done",
    "critical_error", "debug_state",
]


def start_final_counts(
    events: DataFrame, feed: str, checkpoint: str, late: str = "10 minutes", gap: str = "1 hour", stages: list[str] = STAGES
) -> StreamingQuery:
    """Counts per session and stage, written once when a session has ended.

    A session has ended when it was silent for `gap` and the watermark, `late` behind the newest event, has
    passed that. Events that come again within `late` count once; later ones are dropped. So the state
    holds open sessions alone, and no row of the feed is ever replaced. Stages outside `stages` count as
    `other`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{feed}/batch={batch_id}")

    known = F.col("stage").isin(stages)
    counts = [F.count_if(F.col("stage") == s).alias(s) for s in stages] + [F.count_if(~F.coalesce(known, F.lit(False))).alias("other")]
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session_id", "event_no"])
    ended = once.groupBy("session_id", F.session_window("ts", gap).alias("open")).agg(*counts)
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("n_events")) for s in [*stages, "other"]]))
    rows = ended.select("session_id", F.col("open.start").alias("started_at"), F.col("open.end").alias("ended_at"), pairs.alias("c"))
    return (
        rows.select("session_id", "started_at", "ended_at", "c.stage", "c.n_events").filter("n_events > 0")
        .writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(write).start()
    )


def final_counts(spark: SparkSession, feed: str) -> DataFrame:
    """(session_id, started_at, ended_at, stage, n_events) of ended sessions."""
    kind = "session_id string, started_at timestamp, ended_at timestamp, stage string, n_events long"
    try:
        return spark.read.schema(kind).parquet(feed)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kind)


DONE = "done"  # the stage that ends a session


def _age(event: list) -> tuple:
    """Time, then number; unknown ones are oldest."""
    return event[2] is not None, event[2] or 0, event[1] is not None, event[1] or 0


def _bounded(keep: int, linger_ms: int):
    """State of a session: its latest events as JSON, and when it is over.

    Events come as one column of JSON and a history goes out as one value: pandas takes its time for every
    column of every session, so few columns and rows cross over.
    """

    def update(key, frames, state):
        session = key[0]
        held, done_at = json.loads(state.get[0]) if state.exists else [], state.get[1] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            return
        for frame in frames:  # a busy session comes in several frames; never more than `keep` events stay
            for e in json.loads("[" + ",".join(frame["event"].tolist()) + "]"):
                us, stage = e.get("us"), e.get("stage")
                ms = None if us is None else us // 1000
                if stage == DONE and ms is not None:
                    done_at = max(ms, done_at or 0)
                if stage != S.HIDDEN_STAGE:
                    held.append([ms, e.get("event_no"), us, e.get("level"), stage, e.get("message")])
            held.sort(key=_age, reverse=True)
            held = held[:keep]
        text = json.dumps(held)
        state.update((text, done_at))
        # Over a while after `done`, once the watermark is there.
        if done_at is not None:
            state.setTimeoutTimestamp(max(done_at + linger_ms, state.getCurrentWatermarkMs() + 1))
        if held:
            yield pd.DataFrame({"session_id": [session], "history": [text]})

    return update


def start_history_state(
    events: DataFrame, feed: str, checkpoint: str, keep: int = S.EVENTS_KEPT_PER_SESSION, late: str = "10 minutes", linger: float = 60.0
) -> StreamingQuery:
    """Keep the latest events per session in the stream's own state; `feed` gets the sessions of each batch.

    The state of a session holds at most `keep` events. It is dropped `linger` seconds of event time after
    a `done` event; what the feed has of the session stays. Events later than `late` are dropped. Unlike
    `start_history` no batch reads what earlier ones wrote.
    """
    event = F.struct(F.col("event_no").cast("long").alias("event_no"), F.unix_micros("ts").alias("us"), "level", "stage", "message")
    named = events.select("session_id", "ts", F.to_json(event).alias("event"))
    kept = named.withWatermark("ts", late).groupBy("session_id").applyInPandasWithState(
        _bounded(keep, int(linger * 1000)), "session_id string, history string", "history string, done_at long", "update", "EventTimeTimeout",
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        # A history lists (ms, event_no, us, level, stage, message).
        held = F.explode(F.from_json("history", "array<array<string>>", {"mode": "FAILFAST"})).alias("e")
        rows = batch.select("session_id", held).select(
            "session_id", F.col("e")[1].cast("long").alias("event_no"), F.timestamp_micros(F.col("e")[2].cast("long")).alias("ts"),
            F.col("e")[3].alias("level"), F.col("e")[4].alias("stage"), F.col("e")[5].alias("message"),
        )
        rows.write.mode("overwrite").parquet(f"{feed}/batch={batch_id}")

    return kept.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def state_history(spark: SparkSession, feed: str) -> DataFrame:
    """Kept events of every session, as of the last batch that touched it."""
    kept = _kept(spark, feed)
    if kept is None:
        return spark.createDataFrame([], _EVENT)
    last = kept.groupBy("session_id").agg(F.max("batch").alias("batch"))
    return kept.join(last, ["session_id", "batch"]).drop("batch")
