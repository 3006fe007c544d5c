"""Versioned Parquet tables of a corpus, made visible by a commit row.

Documents are laid out in hash buckets of their path. A merge reads and rewrites the buckets its batch
touches and leaves all others where they are. New files go to a new version folder; the row appended
to `commits` afterwards is what readers follow, so a job that dies leaves the old version in force.
One writer at a time. For a table format with its own MERGE, give the plans an object with the same
three methods.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdocs.functions.paths import path_key
from sparkdocs.operators.changes import SUCCESS_COLUMNS, merge_documents
from sparkdocs.operators.maintain import delete_documents
from sparkdocs.schemas import DOCUMENTS, INGEST_STATE

_COMMITS = (
    "version long, committed_at timestamp, stream string, batch_id long, state_version long, "
    "buckets array<struct<bucket: int, version: long>>"
)

# Rows of a batch from which it is joined once instead of left to Spark to broadcast, and buckets up to which
# tasks write a file for each as they are: a task's rows then still make files of some MB.
LARGE_BATCH = 10_000
FEW_BUCKETS = 16


class DocumentStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets

    def _bucket(self, path: Column) -> Column:
        return F.pmod(F.xxhash64(path_key(path)), F.lit(self.buckets)).cast("int")

    def _commits(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(_COMMITS).json(f"{self.root}/commits")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None  # an empty store

    def _head(self):
        commits = self._commits()
        return None if commits is None else commits.orderBy(F.desc("version")).first()

    @staticmethod
    def _places(head) -> dict[int, int]:
        """Version that holds each bucket."""
        return {b["bucket"]: b["version"] for b in head["buckets"]} if head else {}

    def version(self) -> int:
        head = self._head()
        return head["version"] if head else 0

    def has_batch(self, stream: str, batch_id: int) -> bool:
        """True if a streaming batch is already part of the table."""
        commits = self._commits()
        if commits is None:
            return False
        return not commits.filter((F.col("stream") == stream) & (F.col("batch_id") == batch_id)).isEmpty()

    def documents(self, touched: list[int] | None = None) -> DataFrame:
        """Current documents, or those of some buckets."""
        places = sorted(self._places(self._head()).items())
        paths = [
            f"{self.root}/documents/v={version}/bucket={bucket}"
            for bucket, version in places
            if touched is None or bucket in touched
        ]
        if not paths:
            return self.spark.createDataFrame([], DOCUMENTS)
        return self.spark.read.schema(DOCUMENTS).parquet(*paths)

    def state(self) -> DataFrame:
        head = self._head()
        if not head or not head["state_version"]:
            return self.spark.createDataFrame([], INGEST_STATE)
        return self.spark.read.schema(INGEST_STATE).parquet(f"{self.root}/state/v={head['state_version']}")

    def merge(
        self,
        batch: DataFrame,
        run_ts: datetime,
        state: DataFrame | None = None,
        stream: str | None = None,
        batch_id: int | None = None,
        replaced: list[str] = SUCCESS_COLUMNS,
    ) -> int:
        """Merge converted rows (see `merge_documents`) and commit, with the state if given."""
        rows = batch.groupBy(self._bucket(F.col("file_path")).alias("b")).agg(F.count("*").alias("n")).collect()
        touched = [r["b"] for r in rows]  # at most one int per bucket
        large = sum(r["n"] for r in rows) > LARGE_BATCH
        merged = merge_documents(self.documents(touched), batch, run_ts, replaced, "full" if large else None)
        return self._commit(merged if touched else None, touched, run_ts, state, stream, batch_id)

    def set_state(self, state: DataFrame, run_ts: datetime) -> int:
        """Commit a new state with the documents as they are."""
        return self._commit(None, [], run_ts, state, None, None)

    def replace(self, documents: DataFrame, run_ts: datetime) -> int:
        """Commit a whole new set of documents, for deletes and migrations."""
        return self._commit(documents, list(range(self.buckets)), run_ts, None, None, None)

    def change(self, ids: DataFrame, apply: Callable[[DataFrame], DataFrame], run_ts: datetime) -> int:
        """Commit `apply(documents)` for the buckets that hold some of `ids`; all others stay as they are.

        `apply` may drop rows and set columns, but not paths. Finding the buckets reads id and path alone.
        """
        held = self.documents().select("id", "file_path").join(ids.select("id"), "id", "left_semi")
        rows = held.select(self._bucket(F.col("file_path")).alias("b")).distinct().collect()
        touched = [r["b"] for r in rows]  # at most one int per bucket
        if not touched:
            return self.version()
        return self._commit(apply(self.documents(touched)), touched, run_ts, None, None, None)

    def delete(self, ids: DataFrame, run_ts: datetime) -> int:
        """Commit without the documents of `ids`."""
        return self.change(ids, lambda docs: delete_documents(docs, ids)[0], run_ts)

    def _commit(self, documents, touched, run_ts, state, stream, batch_id) -> int:
        head = self._head()
        version = (head["version"] if head else 0) + 1
        places = self._places(head)
        state_version = head["state_version"] if head else None
        if documents is not None:
            target = f"{self.root}/documents/v={version}"
            spread = documents.withColumn("bucket", self._bucket(F.col("file_path")))
            if self.buckets > FEW_BUCKETS:
                # Brings a bucket's rows together, and splits a large bucket over several tasks and files.
                spread = spread.hint("rebalance", F.col("bucket"))
            spread.write.mode("overwrite").partitionBy("bucket").parquet(target)
            written = self.spark.read.schema("file_path string, bucket int").parquet(target)
            present = {r["bucket"] for r in written.select("bucket").distinct().collect()}
            for bucket in touched:
                if bucket in present:
                    places[bucket] = version
                else:
                    places.pop(bucket, None)
        if state is not None:
            state.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/state/v={version}")
            state_version = version
        return self._record(version, run_ts, stream, batch_id, state_version, sorted(places.items()))

    def _record(self, version, run_ts, stream, batch_id, state_version, places) -> int:
        row = [(version, run_ts, stream, batch_id, state_version, places)]
        self.spark.createDataFrame(row, _COMMITS).coalesce(1).write.mode("append").json(f"{self.root}/commits")
        return version
