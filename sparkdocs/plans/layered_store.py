"""A store whose merges append: changed rows go to a layer of their own, newer layers mask older ones.

`DocumentStore` rewrites every bucket that a batch touches; a batch of a few thousand paths touches nearly
all. Here a merge reads the stored rows of its own paths alone, by a semi-join on the path key, and writes
those rows and their keys. Readers leave out of each layer the keys that newer ones touched. `compact` makes
one layer of all, `vacuum` removes what no commit names any more. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdocs.functions.paths import path_key
from sparkdocs.operators.changes import SUCCESS_COLUMNS, merge_documents
from sparkdocs.operators.sizes import keyed_join
from sparkdocs.plans.store import LARGE_BATCH, DocumentStore
from sparkdocs.schemas import DOCUMENTS
from sparkdocs.session import stage

_KEYS = "key string"


class LayeredStore(DocumentStore):
    """Same methods as `DocumentStore`; the `buckets` of its commits list the layers in force here."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root, buckets=1)

    def layers(self) -> list[int]:
        """Versions of the layers in force, oldest first."""
        head = self._head()
        return sorted(b["version"] for b in head["buckets"]) if head else []

    def _layer(self, version: int) -> DataFrame:
        return self.spark.read.schema(DOCUMENTS).parquet(f"{self.root}/documents/v={version}/rows")

    def _touched(self, version: int) -> DataFrame:
        return self.spark.read.schema(_KEYS).parquet(f"{self.root}/documents/v={version}/keys")

    def documents(self, touched: DataFrame | None = None) -> DataFrame:
        """Current documents, or those whose path keys are in `touched` (key)."""
        found, later = None, None
        for version in reversed(self.layers()):
            rows = self._layer(version).withColumn("_key", path_key(F.col("file_path")))
            if touched is not None:
                rows = keyed_join(rows, touched.select(F.col("key").alias("_key")).distinct(), ["_key"])
            if later is not None:
                rows = rows.join(later.select(F.col("key").alias("_key")), "_key", "left_anti")
            found = rows if found is None else found.unionByName(rows)
            own = self._touched(version)
            later = own if later is None else later.union(own)
        if found is None:
            return self.spark.createDataFrame([], DOCUMENTS)
        return found.select([f.name for f in DOCUMENTS])

    def merge(
        self,
        batch: DataFrame,
        run_ts: datetime,
        state: DataFrame | None = None,
        stream: str | None = None,
        batch_id: int | None = None,
        replaced: list[str] = SUCCESS_COLUMNS,
    ) -> int:
        """Merge converted rows (see `merge_documents`) as a new layer and commit, with the state if given."""
        keys = stage(batch.select(path_key(F.col("file_path")).alias("key")).distinct())
        if keys.isEmpty():
            return self._append(None, None, run_ts, state, stream, batch_id)
        if keys.count() > LARGE_BATCH:
            # The join that merges also leaves out the documents of other paths, so that contents move once.
            merged = merge_documents(self.documents(), batch, run_ts, replaced, "right")
        else:
            merged = merge_documents(self.documents(keys), batch, run_ts, replaced)
        return self._append(merged, keys, run_ts, state, stream, batch_id)

    def replace(self, documents: DataFrame, run_ts: datetime) -> int:
        keys = documents.select(path_key(F.col("file_path")).alias("key"))
        return self._append(documents, keys, run_ts, None, None, None, alone=True)

    def change(self, ids: DataFrame, apply: Callable[[DataFrame], DataFrame], run_ts: datetime) -> int:
        """Commit `apply(documents)` of the documents of `ids`; those it drops are deleted.

        Finding their paths reads id and path alone.
        """
        held = self.documents().select("id", "file_path").join(ids.select("id"), "id", "left_semi")
        keys = stage(held.select(path_key(F.col("file_path")).alias("key")).distinct())
        if keys.isEmpty():
            return self.version()
        return self._append(apply(self.documents(keys)), keys, run_ts, None, None, None)

    def compact(self, run_ts: datetime) -> int:
        """All layers as one; masked and deleted rows are gone from it."""
        return self.version() if len(self.layers()) < 2 else self.replace(self.documents(), run_ts)

    def vacuum(self) -> list[int]:
        """Remove the folders of layers no longer in force; their versions. Readers of older ones must have ended."""
        keep = set(self.layers())
        base = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/documents")
        files = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = []
        for status in files.listStatus(base) if files.exists(base) else []:
            version = int(status.getPath().getName().removeprefix("v="))
            if version not in keep:
                files.delete(status.getPath(), True)
                gone.append(version)
        return sorted(gone)

    def _append(self, rows, keys, run_ts, state, stream, batch_id, alone: bool = False) -> int:
        head = self._head()
        version = (head["version"] if head else 0) + 1
        layers = [] if alone else self.layers()
        if rows is not None:
            rows.write.mode("overwrite").parquet(f"{self.root}/documents/v={version}/rows")
            keys.write.mode("overwrite").parquet(f"{self.root}/documents/v={version}/keys")
            layers = [*layers, version]
        state_version = head["state_version"] if head else None
        if state is not None:
            state.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/state/v={version}")
            state_version = version
        return self._record(version, run_ts, stream, batch_id, state_version, [(i, v) for i, v in enumerate(layers)])

    def _commit(self, documents, touched, run_ts, state, stream, batch_id) -> int:
        return self._append(None, None, run_ts, state, stream, batch_id)
