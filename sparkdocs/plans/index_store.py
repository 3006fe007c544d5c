"""Index tables that follow the documents: one segment per change, newer segments mask older ones.

A segment holds the postings and trigrams of the documents that a change touched, and the list of those
documents. A document counts where it was touched last: what older segments say of it is left out on
reading, so a change writes nothing but its own segment. `compact` brings all segments together, `vacuum`
removes folders that no commit names any more. One writer at a time, as in `DocumentStore`.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdocs.operators.blocks import write_ranges
from sparkdocs.operators.fulltext import write_postings
from sparkdocs.operators.indexed import CorpusIndex, index_blocks, write_trigrams
from sparkdocs.operators.sizes import IdSet
from sparkdocs.session import stage, staged

_COMMITS = "generation long, committed_at timestamp, segments array<long>"
_TABLES = {
    "postings": "term string, id long, tf long, positions array<int>",
    "trigrams": "gram string, id long",
    # touched documents; `live` ones are completed, `has_text` ones among them have a text
    "ids": "id long, live boolean, has_text boolean",
}


class IndexStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _head(self):
        try:
            commits = self.spark.read.schema(_COMMITS).json(f"{self.root}/commits")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None  # an empty index
        return commits.orderBy(F.desc("generation")).first()

    def segments(self) -> list[int]:
        """Generations in force, oldest first."""
        head = self._head()
        return sorted(head["segments"]) if head else []

    def _commit(self, generation: int, segments: list[int], run_ts: datetime) -> int:
        row = [(generation, run_ts, segments)]
        self.spark.createDataFrame(row, _COMMITS).coalesce(1).write.mode("append").json(f"{self.root}/commits")
        return generation

    def _path(self, generation: int, table: str) -> str:
        return f"{self.root}/segments/g={generation}/{table}"

    def _read(self, generation: int, table: str) -> DataFrame:
        return self.spark.read.schema(_TABLES[table]).parquet(self._path(generation, table))

    def _index(self, generation: int, rows: DataFrame, touched: DataFrame) -> None:
        """Write the segment of some touched documents; those that `rows` lacks or that are not completed are absent.

        The texts are read once: their index rows are kept as packed blocks until all tables are written.
        """
        with staged(index_blocks(rows)) as made:
            for table in ("postings", "trigrams"):
                write_ranges(made.filter(F.col("kind") == table).select("n", "drawn", "block"), _TABLES[table], self._path(generation, table))
            cells = made.filter(F.col("kind") == "ids").select(F.explode(F.arrays_zip("ids", "texts")).alias("d"))
            known = cells.select(F.col("d.ids").alias("id"), F.lit(True).alias("live"), F.col("d.texts").alias("has_text"))
            absent = touched.join(known.select("id"), "id", "left_anti").select("id", F.lit(False).alias("live"), F.lit(False).alias("has_text"))
            known.unionByName(absent).write.parquet(self._path(generation, "ids"))

    def _next(self) -> int:
        head = self._head()
        return (head["generation"] if head else 0) + 1

    def update(self, documents: DataFrame, ids: DataFrame, run_ts: datetime) -> int:
        """Index the documents of `ids` as they are now; ids without a document are taken out.

        Give the current documents and the ids that a merge, a retry or a delete touched.
        """
        generation = self._next()
        touched = stage(ids.select(F.col("id").cast("long").alias("id")).distinct())
        rows = documents.select("id", "status", "file_name", "markdown_content")
        self._index(generation, IdSet(touched).join(rows, "left_semi"), touched)
        return self._commit(generation, [*self.segments(), generation], run_ts)

    def build(self, documents: DataFrame, run_ts: datetime) -> int:
        """Index all documents anew in one segment, in place of all there are."""
        generation = self._next()
        touched = documents.select(F.col("id").cast("long").alias("id")).filter(F.col("id").isNotNull()).distinct()
        self._index(generation, documents, touched)
        return self._commit(generation, [generation], run_ts)

    def _masks(self) -> dict[int, IdSet]:
        """What newer segments touched, for each segment but the newest."""
        masks, later = {}, None
        for generation in reversed(self.segments()):
            if later is not None:
                masks[generation] = IdSet(later)
            own = self._read(generation, "ids").select("id")
            later = own if later is None else later.union(own)
        return masks

    def _current(self, table: str, masks: dict[int, IdSet]) -> DataFrame:
        """Rows of a table as the newest segments that touched their documents give them."""
        found = None
        for generation in reversed(self.segments()):
            rows = self._read(generation, table)
            if generation in masks:
                rows = masks[generation].join(rows, "left_anti")
            found = rows if found is None else found.unionByName(rows)
        return found if found is not None else self.spark.createDataFrame([], _TABLES[table])

    def index(self) -> CorpusIndex:
        """Index tables for `search_indexed` and `search_postings`."""
        masks = self._masks()
        ids = self._current("ids", masks).filter("has_text").select("id")
        return CorpusIndex(self._current("postings", masks), self._current("trigrams", masks), ids)

    def compact(self, run_ts: datetime) -> int:
        """Bring all segments together in one; masked rows are gone from it."""
        held = self.segments()
        if len(held) < 2:
            return held[-1] if held else 0
        generation = self._next()
        masks = self._masks()
        write_postings(self._current("postings", masks), self._path(generation, "postings"))
        write_trigrams(self._current("trigrams", masks), self._path(generation, "trigrams"))
        self._current("ids", masks).filter("live").write.parquet(self._path(generation, "ids"))
        return self._commit(generation, [generation], run_ts)

    def vacuum(self) -> list[int]:
        """Remove the folders of segments that are no longer in force; their generations.

        Readers of an older commit must have ended.
        """
        keep = set(self.segments())
        base = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/segments")
        files = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = []
        if not files.exists(base):
            return gone
        for status in files.listStatus(base):
            generation = int(status.getPath().getName().removeprefix("g="))
            if generation not in keep:
                files.delete(status.getPath(), True)
                gone.append(generation)
        return sorted(gone)
