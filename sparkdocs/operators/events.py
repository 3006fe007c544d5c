"""Progress events of ingest runs: summaries, progress, bounded history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdocs import schemas as S
from sparkdocs.operators.sizes import number_rows, top_per_group


def ingest_summary(actions: DataFrame, scope: str = "scope_key") -> DataFrame:
    """Counts per scope from rows with `outcome`: processed, skipped or error."""
    return actions.groupBy(scope).agg(
        F.count("*").alias("total_files"),
        F.count_if(F.col("outcome") == "processed").alias("processed"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
    )


def progress(files: DataFrame, scope: str, order: str) -> DataFrame:
    """Share of its scope done after each file, in file order, as whole percent."""
    numbered = number_rows(files, [scope], [F.col(order)], "file_no", total="total_files")
    share = (F.col("file_no") / F.col("total_files") * 100).cast("int")
    return numbered.withColumn("progress", share)


def event_history(events: DataFrame, keep: int = S.EVENTS_KEPT_PER_SESSION) -> DataFrame:
    """Latest events per session without the debug stage."""
    shown = events.filter(~F.col("stage").eqNullSafe(S.HIDDEN_STAGE))
    return top_per_group(
        shown, ["session_id"], [F.desc("ts"), F.desc("event_no")], keep, spread=["event_no"]
    )


def latest_session(events: DataFrame) -> DataFrame:
    """The session that started last; of several, the greatest id."""
    starts = events.groupBy("session_id").agg(F.min("ts").alias("started_at"))
    return starts.agg(
        F.max_by("session_id", F.struct("started_at", "session_id")).alias("session_id"),
        F.max("started_at").alias("started_at"),
    )


def stage_counts(events: DataFrame) -> DataFrame:
    """Events per session and stage; works on a stream (update mode) as on a table."""
    return events.groupBy("session_id", "stage").count().withColumnRenamed("count", "n_events")
