"""The notes job: one run of the import into a store, with its cursor, and clean-up of moved notes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdocs import schemas as S
from sparkdocs.operators.changes import NOTE_COLUMNS, merge_state
from sparkdocs.operators.events import ingest_summary
from sparkdocs.plans.notes_import import NotesRun, import_notes
from sparkdocs.plans.store import DocumentStore
from sparkdocs.session import stage


def notes_cursor(state: DataFrame) -> datetime | None:
    """Start of the last whole run; one row at most."""
    mine = state.filter((F.col("source") == S.SOURCE_NOTES) & (F.col("scope_key") == S.SOURCE_NOTES))
    row = mine.select("cursor_updated_at").first()
    return row[0] if row else None


def _state_row(counts: DataFrame, run_ts: datetime, error: str | None) -> DataFrame:
    """One row for the notes; a run that failed keeps the cursor."""
    now = F.lit(run_ts).cast("timestamp")
    asked = counts.sparkSession.createDataFrame([(S.SOURCE_NOTES,)], "scope_key string")
    return asked.join(counts, "scope_key", "left").select(
        F.lit(S.SOURCE_NOTES).alias("source"), "scope_key", now.alias("last_started_at"), now.alias("last_ended_at"),
        F.lit(error).cast("string").alias("last_error_message"),
        (now if error is None else F.lit(None).cast("timestamp")).alias("cursor_updated_at"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_files", "processed", "skipped", "errors")],
        now.alias("created_at"), now.alias("updated_at"),
    )


def run_notes_import(
    store: DocumentStore, notes: DataFrame, folders: DataFrame, run_ts: datetime, full_resync: bool = False, ids: DataFrame | None = None
) -> NotesRun:
    """Import new and changed notes into a store; documents, counts and cursor are one commit.

    Notes older than the cursor are skipped unless `full_resync`; `ids` takes chosen notes only. The cursor
    becomes the start of the run. A note whose body cannot be converted counts as an error and leaves what
    is stored as it is. A run that fails as a whole commits its message and nothing else, and raises.
    """
    state = store.state()
    cursor = None if full_resync else notes_cursor(state)
    chosen = notes if ids is None else notes.join(ids.select("id").distinct(), "id", "left_semi")
    try:
        # The bodies are converted once, for the merge and for the counts.
        run = import_notes(chosen, folders, store.documents(), cursor, True)
        converted, outcomes = run.converted, stage(run.outcomes)
        row = stage(_state_row(ingest_summary(outcomes), run_ts, None))
        store.merge(converted, run_ts, state=merge_state(state, row), replaced=NOTE_COLUMNS)
    except Exception as failure:
        none = store.spark.createDataFrame([], "scope_key string, total_files long, processed long, skipped long, errors long")
        store.set_state(merge_state(state, _state_row(none, run_ts, f"{type(failure).__name__}: {failure}"[:4000])), run_ts)
        raise
    return NotesRun(converted, outcomes)


def moved_notes(docs: DataFrame) -> DataFrame:
    """(id, file_path, new_path): rows of notes that were renamed or moved since, one per path left behind.

    A note's id ends its path, so of several paths with one id the latest changed row is the note.
    """
    notes = docs.filter(F.col("source") == S.SOURCE_NOTES).select(
        "id", "file_path", F.regexp_extract("file_path", r"(?s)^.*__(.*)$", 1).alias("note"),
        F.struct("file_modified_time", "updated_at", "file_path").alias("age"),
    )
    newest = notes.groupBy("note").agg(F.max("age").alias("newest"), F.count("*").alias("n")).filter("n > 1")
    met = notes.join(newest, "note").filter(F.col("file_path") != F.col("newest.file_path"))
    return met.select("id", "file_path", F.col("newest.file_path").alias("new_path"))
