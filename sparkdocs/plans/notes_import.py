"""Import of exported notes into the documents table."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdocs import schemas as S
from sparkdocs.convert.html import FAILED, convert_html
from sparkdocs.functions.text import from_epoch_ms, strip_nul
from sparkdocs.operators.changes import detect_changes
from sparkdocs.operators.hierarchy import folder_paths
from sparkdocs.operators.sizes import keyed_join
from sparkdocs.session import stage

_OUT = [
    "file_path", "file_name", "file_type", "file_size", "file_created_at", "file_modified_time", "source",
    "source_url",
]


@dataclass
class NotesRun:
    converted: DataFrame
    outcomes: DataFrame


def note_rows(notes: DataFrame, folders: DataFrame) -> DataFrame:
    """Notes as document rows: path from the folder chain, title and id."""
    chains = folder_paths(folders).withColumnRenamed("id", "_folder")
    placed = keyed_join(
        notes.withColumn("_folder", F.col("parent_id").cast("string")), chains, ["_folder"], "left"
    )
    path = F.concat(
        F.lit(S.NOTE_PATH_SCHEME), F.coalesce("folder_path", F.lit("")), F.lit("/"), "title", F.lit("__"),
        F.col("id").cast("string"),
    )
    body = F.coalesce("body", F.lit(""))
    return placed.select(
        path.alias("file_path"),
        F.col("title").alias("file_name"),
        F.when(F.col("markup_language") == 2, "md").otherwise("html").alias("file_type"),
        F.octet_length(body).cast("long").alias("file_size"),
        from_epoch_ms(F.col("created_time")).alias("file_created_at"),
        from_epoch_ms(F.col("updated_time")).alias("file_modified_time"),
        F.lit(S.SOURCE_NOTES).alias("source"),
        F.coalesce("source_url", F.lit("")).alias("source_url"),
        body.alias("body"),
    )


def import_notes(
    notes: DataFrame, folders: DataFrame, docs: DataFrame, cursor: datetime | None = None, staged: bool = False
) -> NotesRun:
    """New and changed notes as rows to merge (with `NOTE_COLUMNS`), and an outcome for each note.

    Notes updated before the cursor are skipped before their folder chain is looked up. With `staged` the
    change test and the converted notes are written once, because later steps read them more than once.
    """
    stamp = from_epoch_ms(F.col("updated_time"))
    old = F.lit(False) if cursor is None else F.coalesce(stamp < F.lit(cursor), F.lit(False))
    rows = note_rows(notes.filter(~old), folders)
    actions = detect_changes(rows, docs)
    if staged:
        actions = stage(actions)
    todo = actions.filter(F.col("action") != "unchanged")
    empty = todo.filter(F.col("body") == "").select(
        *_OUT, F.lit("").alias("markdown_content"), F.lit(S.DIRECT).alias("conversion_type"),
        F.lit(True).alias("success"), F.lit(None).cast("string").alias("error_message"),
    )
    bodies = todo.filter(F.col("body") != "")
    # An all-markup body is an empty document here, not a failure.
    failed = F.col("error_message").startswith(FAILED)
    full = convert_html(bodies.select(*_OUT, "body"), "body").select(
        *_OUT, strip_nul(F.coalesce("markdown_content", F.lit(""))).alias("markdown_content"),
        F.lit(S.STRUCTURED).alias("conversion_type"),
        F.coalesce(~failed, F.lit(True)).alias("success"), "error_message",
    )
    both = empty.unionByName(full)
    if staged:
        both = stage(both)
    before = notes.filter(old).select(F.lit("skipped").alias("outcome"))
    same = actions.filter(F.col("action") == "unchanged").select(F.lit("skipped").alias("outcome"))
    done = both.select(F.when(F.col("success"), "processed").otherwise("error").alias("outcome"))
    outcomes = before.unionByName(same).unionByName(done).withColumn("scope_key", F.lit(S.SOURCE_NOTES))
    return NotesRun(both.filter(F.col("success")), outcomes)
