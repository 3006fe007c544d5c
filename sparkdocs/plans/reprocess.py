"""Second conversions: retries of failed documents and bulk reprocessing of HTML."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdocs.convert.default import default_registry
from sparkdocs.convert.registry import ConverterRegistry
from sparkdocs.operators.maintain import apply_reconversion, html_to_reprocess, retry_outcomes
from sparkdocs.plans.store import DocumentStore
from sparkdocs.session import stage


def _reconvert(rows: DataFrame, contents: DataFrame, registry: ConverterRegistry | None) -> DataFrame:
    todo = rows.select("id", "file_path", "file_name", "file_type").join(contents, "file_path", "left")
    return (registry or default_registry()).convert(todo)


def retry_failed(
    docs: DataFrame, ids: DataFrame, contents: DataFrame, run_ts: datetime, registry: ConverterRegistry | None = None
) -> tuple[DataFrame, DataFrame]:
    """(documents, outcome per id); only failed documents are tried again."""
    outcomes = retry_outcomes(docs, ids)
    chosen = docs.join(outcomes.filter(F.col("outcome") == "retry").select("id"), "id", "left_semi")
    converted = stage(_reconvert(chosen, contents, registry))  # read for the documents and for the outcomes
    result = converted.select("id", "success", "error_message")
    told = outcomes.join(result, "id", "left").withColumn(
        "outcome",
        F.when(F.col("success"), "completed").when(~F.col("success"), "failed").otherwise(F.col("outcome")),
    )
    return apply_reconversion(docs, converted, run_ts, mark_failures=True), told.select("id", "outcome", "error_message")


def reprocess_html(
    docs: DataFrame,
    contents: DataFrame,
    run_ts: datetime,
    only_missing: bool = False,
    registry: ConverterRegistry | None = None,
) -> DataFrame:
    """Documents with HTML converted again; failures keep what they had."""
    converted = _reconvert(html_to_reprocess(docs, only_missing), contents, registry)
    return apply_reconversion(docs, converted, run_ts, mark_failures=False)


def retry_stored(
    store: DocumentStore, ids: DataFrame, contents: DataFrame, run_ts: datetime, registry: ConverterRegistry | None = None
) -> int:
    """Retry failed documents of a store and commit the buckets that hold them."""
    return store.change(ids, lambda docs: retry_failed(docs, ids, contents, run_ts, registry)[0], run_ts)


def reprocess_stored(
    store: DocumentStore, contents: DataFrame, run_ts: datetime, only_missing: bool = False, registry: ConverterRegistry | None = None
) -> int:
    """Convert the HTML of a store again and commit the buckets that hold it."""
    ids = html_to_reprocess(store.documents(), only_missing).select("id")
    return store.change(ids, lambda docs: reprocess_html(docs, contents, run_ts, only_missing, registry), run_ts)
