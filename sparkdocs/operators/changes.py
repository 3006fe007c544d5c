"""Change detection and the merge of converted items into the documents table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdocs.functions.paths import document_id, path_key
from sparkdocs.schemas import DOCUMENTS

# What a successful, and what a failed conversion changes on an existing document.
SUCCESS_COLUMNS = [
    "file_size", "file_modified_time", "markdown_content", "conversion_type", "source", "source_url",
]
FAILURE_COLUMNS = ["source", "source_url"]
# A re-imported note also replaces these.
NOTE_COLUMNS = [*SUCCESS_COLUMNS, "file_name", "file_type", "file_created_at"]


def latest_per_path(listing: DataFrame) -> DataFrame:
    """One row per case-folded path: the latest change wins, then the greatest path.

    An aggregate rather than a window: copies of one path meet map-side, so a path that fills a third
    of the listing never lands in one task.
    """
    row = F.struct(*[F.col(c) for c in listing.columns])
    rank = F.struct(F.col("file_modified_time"), F.col("file_path"), F.col("file_size"))
    best = listing.groupBy(path_key(F.col("file_path")).alias("_key")).agg(F.max_by(row, rank).alias("r"))
    return best.select("r.*")


def detect_changes(listing: DataFrame, docs: DataFrame) -> DataFrame:
    """Listing with `id` of the stored document and `action`: new, changed or unchanged.

    Only the key, id and time of the documents are read.
    """
    known = docs.select(
        path_key(F.col("file_path")).alias("_key"),
        F.col("id").alias("id"),
        F.col("file_modified_time").alias("_stored"),
    )
    same = F.col("file_modified_time").eqNullSafe(F.col("_stored"))
    joined = listing.join(known, path_key(F.col("file_path")) == F.col("_key"), "left")
    return joined.withColumn(
        "action",
        F.when(F.col("_key").isNull(), "new").when(same, "unchanged").otherwise("changed"),
    ).drop("_key", "_stored")


def _insert(batch: DataFrame, now: Column, *more: Column) -> DataFrame:
    done = F.col("success")
    new_id = F.coalesce(F.col("id"), document_id(F.col("file_path"))) if "id" in batch.columns else (
        document_id(F.col("file_path"))
    )
    return batch.select(
        new_id.alias("id"),
        "file_name", "file_type", "file_size", "file_created_at", "file_modified_time", "file_path",
        F.when(done, F.col("markdown_content")).alias("markdown_content"),
        F.when(done, F.col("conversion_type")).cast("int").alias("conversion_type"),
        F.when(done, "completed").otherwise("failed").alias("status"),
        F.when(~done, F.col("error_message")).alias("error_message"),
        "source", "source_url",
        now.alias("created_at"),
        now.alias("updated_at"),
        *more,
    )


def merge_documents(
    docs: DataFrame, batch: DataFrame, run_ts: datetime, replaced: list[str] = SUCCESS_COLUMNS, one_join: str | None = None
) -> DataFrame:
    """Documents after a batch of conversions (unique paths, with a `success` flag).

    A success replaces the content and its metadata; a failure only marks the row, so the content of
    an earlier success stays. Written as left join plus anti join: unlike a full outer join this lets
    Spark broadcast a small batch and pass the documents through without a shuffle.

    A batch that is too large for that would be computed and moved twice. With `one_join` it is so once:
    `full` gives the same rows, `right` those of them whose paths are in the batch.
    """
    now = F.lit(run_ts).cast("timestamp")
    key = path_key(F.col("file_path")).alias("_key")
    if one_join:
        fresh = _insert(batch, now, F.col("success").alias("_ok")).select(
            key, "_ok", *[F.col(f.name).alias(f"_{f.name}") for f in DOCUMENTS]
        ).withColumn("_error", F.col("_error_message"))
    else:
        fresh = batch.select(
            key, F.col("success").alias("_ok"), F.col("error_message").alias("_error"),
            *[F.col(c).alias(f"_{c}") for c in replaced],
        )
    touched, done = F.col("_ok").isNotNull(), F.col("_ok")

    def merged(name: str) -> Column:
        old = F.col(name)
        if name in FAILURE_COLUMNS:
            return F.when(touched, F.col(f"_{name}")).otherwise(old)
        if name in replaced:
            return F.when(done, F.col(f"_{name}")).otherwise(old)
        if name == "status":
            return F.when(done, "completed").when(touched, "failed").otherwise(old)
        if name == "error_message":
            return F.when(done, F.lit(None)).when(touched, F.col("_error")).otherwise(old)
        if name == "updated_at":
            return F.when(touched, now).otherwise(old)
        return old

    if one_join:
        held = docs.withColumn("_held", F.lit(True))
        added = F.col("_held").isNull()
        return held.join(fresh, path_key(held["file_path"]) == F.col("_key"), one_join).select(
            *[F.when(added, F.col(f"_{f.name}")).otherwise(merged(f.name)).cast(f.dataType).alias(f.name) for f in DOCUMENTS]
        )
    kept = docs.join(fresh, path_key(docs["file_path"]) == F.col("_key"), "left").select(
        *[merged(f.name).cast(f.dataType).alias(f.name) for f in DOCUMENTS]
    )
    if "action" in batch.columns:  # from detect_changes against these documents
        added = batch.filter(F.col("action") == "new")
    else:
        added = batch.join(docs.select(key), path_key(batch["file_path"]) == F.col("_key"), "left_anti")
    return kept.unionByName(_insert(added, now))


def merge_state(state: DataFrame, runs: DataFrame) -> DataFrame:
    """Ingest state with one row per (source, scope_key); rows of `runs` replace stored ones.

    `runs` has the state columns; its null cursor keeps the stored cursor, and the first creation
    time survives.
    """
    columns = [c for c in state.columns if c not in ("source", "scope_key")]
    new = runs.select(
        F.col("source").alias("_source"), F.col("scope_key").alias("_scope"),
        *[F.col(c).alias(f"_{c}") for c in columns],
    )
    both = state.join(
        new, (F.col("source") == F.col("_source")) & (F.col("scope_key") == F.col("_scope")), "full"
    )
    ran = F.col("_source").isNotNull()

    def value(name: str) -> Column:
        if name == "cursor_updated_at":
            return F.coalesce(F.col(f"_{name}"), F.col(name))
        if name == "created_at":
            return F.coalesce(F.col(name), F.col(f"_{name}"))
        return F.when(ran, F.col(f"_{name}")).otherwise(F.col(name))

    return both.select(
        F.coalesce("source", "_source").alias("source"),
        F.coalesce("scope_key", "_scope").alias("scope_key"),
        *[value(c).alias(c) for c in columns],
    )
