"""Stopping a run from another thread: nothing is committed, so a later run starts where this one did."""

from __future__ import annotations

import threading
from collections.abc import Callable
from datetime import datetime

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdocs.functions import paths as P
from sparkdocs.plans.ingest import IngestOptions, IngestRun, ingest_folders, session_of
from sparkdocs.plans.store import DocumentStore

RETRY_SECONDS = 0.5


class RunCancelled(Exception):
    """A run was asked to stop before its commit."""


class RunControl:
    """Handle of one run: `cancel` stops its Spark jobs and those it would still start.

    The jobs carry a tag of the run; `check` is called between steps, last before the commit. A commit is
    one small file, so a run is either whole or leaves documents, state and cursor as they were.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.tag = spark, f"run-{name}"
        self._asked, self._ended = threading.Event(), threading.Event()

    def cancel(self) -> None:
        """Interrupt the run's jobs, again and again until it has ended: one may be about to start."""
        self._asked.set()
        threading.Thread(target=self._interrupt, daemon=True).start()

    def _interrupt(self) -> None:
        while True:
            self.spark.sparkContext.cancelJobsWithTag(self.tag)
            if self._ended.wait(RETRY_SECONDS):
                return

    @property
    def cancelled(self) -> bool:
        return self._asked.is_set()

    def check(self) -> None:
        if self.cancelled:
            raise RunCancelled(self.tag)

    def run(self, job: Callable):
        """Result of `job`, or None if it was cancelled. Its other errors are raised."""
        self._ended.clear()
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            self.check()
            return job()
        except RunCancelled:
            return None
        except PySparkException:
            if not self.cancelled:
                raise
            return None  # the job that was interrupted
        except Exception as failure:
            # A job that ends while it is cancelled may surface as an error of the gateway.
            if self.cancelled and "cancelled" in str(failure).lower():
                return None
            raise
        finally:
            self._ended.set()
            self.spark.sparkContext.removeJobTag(self.tag)


def cancelled_events(spark: SparkSession, roots: list[str], run_ts: datetime) -> DataFrame:
    """Events of a stopped run: its start, the stop and the end, per folder."""
    folders = spark.createDataFrame([(P.normalize_root(r),) for r in roots], "scope_key string")

    def event(number: int, level: str, stage: str, message):
        return F.struct(
            F.lit(number).cast("long").alias("event_no"), F.lit(level).alias("level"), F.lit(stage).alias("stage"),
            message.alias("message"), F.lit(None).cast("int").alias("progress"), F.lit(None).cast("string").alias("current_file"),
        )

    # Messages of a stopped run.
    steps = F.array(
        event(0, "info", "scan_start", F.col("scope_key")),
        event(1, "warning", "cancelled", F.lit("Stopping before next file (cancelled).")),
        event(2, "warning", "done", F.lit("Processing stopped before completion.")),
    )
    return folders.select(session_of(run_ts).alias("session_id"), F.explode(steps).alias("e")).select("session_id", "e.*")


def ingest_cancellable(
    control: RunControl, store: DocumentStore, folders: list[str], run_ts: datetime, options: IngestOptions = IngestOptions(), **how
) -> tuple[IngestRun | None, DataFrame]:
    """(run, events) of an ingest that `control` may stop; the run is None if it did."""
    run = control.run(lambda: ingest_folders(control.spark, store, folders, run_ts, options, check=control.check, **how))
    return run, run.events(run_ts) if run else cancelled_events(control.spark, folders, run_ts)
