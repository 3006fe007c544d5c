"""Upkeep: orphans, deletes, retries, failed documents, reprocessing, code migration."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdocs import schemas as S
from sparkdocs.functions.paths import normalize_root, under
from sparkdocs.operators.search import substring_match


def orphans(
    docs: DataFrame,
    listing: DataFrame,
    folder: str,
    file_type: str | None = None,
    path_keyword: str | None = None,
    folder_exists: bool | None = None,
) -> DataFrame:
    """Documents under `folder` whose file is not in the unfiltered listing of it.

    The anti join runs on paths alone. `folder_exists` says whether the folder is there: all documents of
    an emptied one are orphans, none of a missing one. Unknown, a folder without listed files is taken to
    be missing.
    """
    folder = normalize_root(folder)
    columns = [c for c in docs.columns if c != "markdown_content"]
    stored = docs.select(columns).filter(under(F.col("file_path"), folder))
    if file_type:
        stored = stored.filter(F.lower("file_type") == file_type.lower())
    if path_keyword:
        stored = stored.filter(substring_match(F.col("file_path"), path_keyword))
    disk = listing.select("file_path").filter(under(F.col("file_path"), folder))
    if folder_exists is False or (folder_exists is None and disk.isEmpty()):
        return stored.limit(0)
    return stored.join(disk, "file_path", "left_anti").select(columns)


def delete_documents(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents left, and a one-row count of those deleted. `ids` has a column `id`."""
    wanted = ids.select("id")
    left = docs.join(wanted, "id", "left_anti")
    deleted = docs.select("id").join(wanted, "id", "left_semi").agg(F.count("*").alias("deleted"))
    return left, deleted


def document_by_id(docs: DataFrame, doc_id: int) -> DataFrame:
    return docs.filter(F.col("id") == doc_id)


def failed_documents(
    docs: DataFrame, name: str | None = None, date_from: str | None = None, date_to: str | None = None
) -> DataFrame:
    """Failed documents, last touched first."""
    out = docs.filter(F.col("status") == "failed")
    if name:
        out = out.filter(substring_match(F.col("file_name"), name))
    if date_from:
        out = out.filter(F.col("updated_at") >= F.lit(date_from).cast("timestamp"))
    if date_to:
        out = out.filter(F.col("updated_at") <= F.lit(date_to).cast("timestamp"))
    return out.orderBy(F.desc_nulls_first("updated_at"), F.asc("id"))


def retry_outcomes(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """What a retry request does for each id: `retry`, `not_failed` or `not_found`."""
    asked = ids.select("id").distinct()
    states = docs.select("id", "status", "file_path", "file_type")
    outcome = (
        F.when(F.col("file_path").isNull(), "not_found")
        .when(F.col("status").eqNullSafe("failed"), "retry")
        .otherwise("not_failed")
    )
    return asked.join(states, "id", "left").withColumn("outcome", outcome)


def html_to_reprocess(docs: DataFrame, only_missing: bool = False) -> DataFrame:
    """HTML documents; `only_missing` leaves out converted ones, and null codes by null logic."""
    out = docs.filter(F.lower("file_type").isin("html", "htm"))
    return out.filter(F.col("conversion_type") != S.HTML) if only_missing else out


def apply_reconversion(docs: DataFrame, converted: DataFrame, run_ts: datetime, mark_failures: bool) -> DataFrame:
    """Documents after converting some again (`id`, success, content, type, error).

    Successes replace content, type and state. Failures change nothing, or with `mark_failures` the
    state and the message.
    """
    new = converted.select(
        F.col("id").alias("_id"), F.col("success").alias("_ok"),
        F.col("markdown_content").alias("_content"), F.col("conversion_type").alias("_type"),
        F.col("error_message").alias("_error"),
    )
    ok = F.coalesce(F.col("_ok"), F.lit(False))
    bad = F.coalesce(~F.col("_ok"), F.lit(False)) & F.lit(mark_failures)
    changes = {
        "markdown_content": F.when(ok, F.col("_content")).otherwise(F.col("markdown_content")),
        "conversion_type": F.when(ok, F.col("_type").cast("int")).otherwise(F.col("conversion_type")),
        "status": F.when(ok, "completed").when(bad, "failed").otherwise(F.col("status")),
        "error_message": F.when(ok, F.lit(None)).when(bad, F.col("_error")).otherwise(F.col("error_message")),
        "updated_at": F.when(ok | bad, F.lit(run_ts).cast("timestamp")).otherwise(F.col("updated_at")),
    }
    return docs.join(new, docs["id"] == F.col("_id"), "left").select(
        *[changes.get(c, F.col(c)).alias(c) for c in docs.columns]
    )


def _old_html():
    return F.lower("file_type").isin("html", "htm") & (F.col("conversion_type") == S.STRUCTURED)


def migrate_html(docs: DataFrame) -> DataFrame:
    """Give HTML documents stored under the structured code the HTML code."""
    code = F.when(_old_html(), F.lit(S.HTML)).otherwise(F.col("conversion_type"))
    return docs.withColumn("conversion_type", code.cast("int"))


def migration_counts(docs: DataFrame) -> DataFrame:
    """Rows the migration changes, and HTML rows with the new code after it."""
    html = F.lower("file_type").isin("html", "htm")
    return docs.agg(
        F.count_if(_old_html()).alias("to_update"),
        F.count_if(html & F.col("conversion_type").isin(S.STRUCTURED, S.HTML)).alias("updated_html_docs"),
    )
