"""Incremental ingest from a stream of listing rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkdocs.convert.registry import ConverterRegistry
from sparkdocs.operators.changes import merge_state
from sparkdocs.plans.ingest import IngestOptions, ingest
from sparkdocs.plans.store import DocumentStore
from sparkdocs.session import stage


COUNTS = ("total_files", "processed", "skipped", "errors")


def _added_up(runs: DataFrame, state: DataFrame, began: datetime) -> DataFrame:
    """Runs that started at `began`, with the counts their folders already have from earlier batches."""
    start = F.lit(began).cast("timestamp")
    earlier = state.filter(F.col("last_started_at") == start).select(
        "source", "scope_key", *[F.col(c).alias(f"earlier_{c}") for c in COUNTS]
    )
    joined = runs.withColumn("last_started_at", start).join(earlier, ["source", "scope_key"], "left")
    summed = {c: (F.col(c) + F.coalesce(f"earlier_{c}", F.lit(0))).alias(c) for c in COUNTS}
    return joined.select(*[summed.get(c, F.col(c)) for c in runs.columns])


def start_ingest_stream(
    listing: DataFrame,
    contents_of: Callable[[DataFrame], DataFrame],
    store: DocumentStore,
    roots: list[str],
    name: str,
    checkpoint: str,
    options: IngestOptions = IngestOptions(),
    registry: ConverterRegistry | None = None,
    sidecars_of: Callable[[DataFrame], DataFrame] | None = None,
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
    check: Callable[[], None] = lambda: None,
) -> StreamingQuery:
    """Merge each micro-batch of listing rows into the store; stops when the input is used up.

    `contents_of` gives (file_path, content, text), and `sidecars_of` (file_path, text), for the rows of
    a batch. A batch may be delivered again after a failure: the commit records its number with the id
    that the checkpoint folder holds, and a recorded batch is passed over; a new checkpoint folder has an
    id of its own and starts anew. `check` is called before and after each batch and may raise to stop the
    stream between batches: what is merged stays, and a restart goes on behind it. The state is part of that same commit, so a stream stopped between
    batches leaves it whole. Folders seen in a batch get a state row; its counts add up over this run.
    """
    began = clock()

    def merge(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.read.json(f"{checkpoint.rstrip('/')}/metadata").first()["id"]
        stream = f"{name}/{query}"
        check()
        if store.has_batch(stream, batch_id):
            return
        run_ts = clock()
        state = store.state()
        # The stream itself says what is new; the cursor is for whole listings.
        run = ingest(
            batch, contents_of(batch), store.documents(), state, roots, run_ts,
            replace(options, full=True), sidecars_of and sidecars_of(batch), registry,
            only_seen=True,
        )
        runs = stage(_added_up(run.runs, state, began))
        store.merge(run.converted, run_ts, state=merge_state(state, runs), stream=stream, batch_id=batch_id)
        check()

    return (
        listing.writeStream.queryName(name)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(merge)
        .start()
    )
