"""Folder ingest: scan, detect changes, convert, merge, and report."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdocs import schemas as S
from sparkdocs.convert.default import default_registry
from sparkdocs.convert.registry import ConverterRegistry
from sparkdocs.functions import paths as P
from sparkdocs.operators.changes import detect_changes, latest_per_path, merge_documents, merge_state
from sparkdocs.operators.events import ingest_summary, progress
from sparkdocs.plans.store import DocumentStore
from sparkdocs.session import stage
from sparkdocs.sources.files import as_listing, join_sidecars, list_files, read_contents, read_sidecars
from sparkdocs.sources.walk import can_walk, read_files, storage_uri, walk_folder


@dataclass
class IngestOptions:
    recursive: bool = True
    file_types: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    full: bool = False  # ignore the cursor
    download_root: str | None = None


@dataclass
class IngestRun:
    """`converted` holds the rows to merge, `outcomes` one row per scanned file."""

    converted: DataFrame
    outcomes: DataFrame
    runs: DataFrame

    def events(self, run_ts: datetime) -> DataFrame:
        return run_events(self.outcomes, self.runs, run_ts)


def cursors(state: DataFrame, roots: list[str]) -> dict[str, str]:
    """Stored cursors of the requested folders: at most one row each."""
    rows = (
        state.filter((F.col("source") == S.SOURCE_FILES) & F.col("scope_key").isin(roots))
        .filter(F.col("cursor_updated_at").isNotNull())
        .select("scope_key", F.date_format("cursor_updated_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("c"))
        .collect()
    )
    return {r["scope_key"]: r["c"] for r in rows}


def scan_scopes(listing: DataFrame, roots: list[str], options: IngestOptions, since: dict[str, str]) -> DataFrame:
    """Listing rows each folder's scan takes, with `scope_key`; a file belongs to the first folder that
    holds it. One pass over the listing for all folders."""
    path, mtime = F.col("file_path"), F.col("file_modified_time")
    scope: Column = F.lit(None).cast("string")
    recent: Column = F.lit(True)
    for root in reversed(roots):
        date_from = options.date_from or (None if options.full else since.get(root))
        inside = P.under(path, root)
        scope = F.when(inside, root).otherwise(scope)
        recent = F.when(inside, P.modified_within(mtime, date_from, options.date_to)).otherwise(recent)
    scoped = listing.filter(recent).withColumn("scope_key", scope).filter(F.col("scope_key").isNotNull())
    rel = path.substr(F.length(F.regexp_replace("scope_key", "/$", "")) + 2, F.length(path))
    taken = scoped.filter(~P.excluded(rel) & P.has_type(path, options.file_types))
    return taken if options.recursive else taken.filter(P.at_top(rel))


def ingest(
    listing: DataFrame,
    contents: DataFrame | Callable[[DataFrame], DataFrame],
    docs: DataFrame,
    state: DataFrame,
    roots: list[str],
    run_ts: datetime,
    options: IngestOptions = IngestOptions(),
    sidecars: DataFrame | None = None,
    registry: ConverterRegistry | None = None,
    staged: bool = True,
    existing: list[str] | None = None,
    only_seen: bool = False,
) -> IngestRun:
    """Plan one run over one or more folders.

    Folders may be URIs. `existing` names those known to be there: one without files is then done, not
    invalid. With `only_seen` folders without a listed file get no state row, as in a micro-batch.

    `contents` may be a function that reads those of given files. Sidecars are joined before the change
    test, contents after it. With `staged` three steps are written
    once because later ones read them more than once: the change test, the changed files (parted by
    converter), and the outcome.
    """
    registry = registry or default_registry()
    roots = [P.normalize_root(r) for r in roots]
    existing = [P.normalize_root(r) for r in existing or []]
    found = latest_per_path(scan_scopes(listing, roots, options, cursors(state, roots)))
    if sidecars is None:
        found = found.withColumn("source_url", F.lit(None).cast("string"))
    else:
        # Spark takes read files to be as small as their listing; a broadcast would bring them to the driver.
        found = join_sidecars(found, sidecars.hint("merge") if callable(contents) else sidecars)
    found = found.withColumn("source", P.derive_source(F.col("file_path"), options.download_root))
    actions = detect_changes(found, docs)
    if staged:
        actions = stage(actions)
    changed = actions.filter(F.col("action") != "unchanged")
    # Contents of unchanged files end here, before they are moved.
    wanted = contents(changed).hint("merge") if callable(contents) else contents.join(changed.select("file_path"), "file_path", "left_semi")
    todo = changed.join(wanted, "file_path", "left")
    todo = todo.withColumn("converter", registry.converter_of(F.col("file_type")))
    converted = registry.convert(stage(todo, "converter") if staged else todo)
    if staged:
        converted = stage(converted)
    skipped = actions.filter(F.col("action") == "unchanged").select(
        "scope_key", "file_path", "file_name", F.lit("skipped").alias("outcome"),
        F.lit(None).cast("string").alias("error_message"),
    )
    outcomes = skipped.unionByName(
        converted.select(
            "scope_key", "file_path", "file_name",
            F.when(F.col("success"), "processed").otherwise("error").alias("outcome"), "error_message",
        )
    )
    return IngestRun(converted, outcomes, _runs(listing, outcomes, roots, run_ts, existing, only_seen))


def _runs(
    listing: DataFrame, outcomes: DataFrame, roots: list[str], run_ts: datetime, existing: list[str], only_seen: bool
) -> DataFrame:
    """One state row per folder. A folder neither listed nor existing is reported, and keeps its cursor."""
    spark = listing.sparkSession
    asked = spark.createDataFrame([(r,) for r in roots], "scope_key string")
    scope = F.coalesce(*[F.when(P.under(F.col("file_path"), r), r) for r in roots])
    listed = listing.groupBy(scope.alias("scope_key")).agg(F.lit(True).alias("listed"))
    counts = ingest_summary(outcomes)
    now = F.lit(run_ts).cast("timestamp")
    bad = F.col("listed").isNull() & ~F.col("scope_key").isin(existing)
    # Both sides have one row per requested folder.
    return (
        asked.join(listed, "scope_key", "inner" if only_seen else "left").join(counts, "scope_key", "left").select(
            F.lit(S.SOURCE_FILES).alias("source"),
            "scope_key",
            now.alias("last_started_at"),
            now.alias("last_ended_at"),
            F.when(bad, "invalid_directory").alias("last_error_message"),
            F.when(~bad, now).alias("cursor_updated_at"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_files", "processed", "skipped", "errors")],
            now.alias("created_at"),
            now.alias("updated_at"),
        )
    )


def session_of(run_ts: datetime) -> Column:
    """Session of a folder's run, from `scope_key`."""
    return F.sha2(F.concat_ws("|", "scope_key", F.lit(run_ts.isoformat())), 256).substr(1, 32)


def run_events(outcomes: DataFrame, runs: DataFrame, run_ts: datetime) -> DataFrame:
    """Progress events of a run: two per file between those of its scan and its end."""
    session = session_of(run_ts)
    files = progress(outcomes, "scope_key", "file_path")
    level = F.when(F.col("outcome") == "error", "error").otherwise("info")
    stage_of = (
        F.when(F.col("outcome") == "error", "file_error")
        .when(F.col("outcome") == "skipped", "file_skip")
        .otherwise("file_success")
    )
    none = F.lit(None).cast("int")
    per_file = files.select(
        session.alias("session_id"),
        F.explode(
            F.array(
                F.struct(
                    (F.col("file_no") * 2).alias("event_no"), F.lit("info").alias("level"),
                    F.lit("file_processing").alias("stage"), F.col("file_path").alias("message"),
                    F.col("progress"), F.col("file_name").alias("current_file"),
                ),
                F.struct(
                    (F.col("file_no") * 2 + 1).alias("event_no"), level.alias("level"),
                    stage_of.alias("stage"), F.coalesce("error_message", "file_path").alias("message"),
                    none.alias("progress"), F.col("file_name").alias("current_file"),
                ),
            )
        ).alias("e"),
    ).select("session_id", "e.*")

    def event(number: Column, level: str, stage: str, message: Column) -> Column:
        return F.struct(
            number.cast("long").alias("event_no"), F.lit(level).alias("level"), F.lit(stage).alias("stage"),
            message.alias("message"), none.alias("progress"), F.lit(None).cast("string").alias("current_file"),
        )

    counted = F.to_json(F.struct("total_files", "processed", "skipped", "errors"))
    total = F.col("total_files")
    good = F.array(
        event(F.lit(0), "info", "scan_start", F.col("scope_key")),
        event(F.lit(1), "info", "scan_complete", total.cast("string")),
        event(total * 2 + 2, "info", "done", counted),
    )
    bad = F.array(event(F.lit(0), "critical", "critical_error", F.col("last_error_message")))
    per_run = runs.select(
        session.alias("session_id"),
        F.explode(F.when(F.col("last_error_message").isNull(), good).otherwise(bad)).alias("e"),
    ).select("session_id", "e.*")
    return per_run.unionByName(per_file)


def _folder(spark: SparkSession, folder: str, options: IngestOptions, start: str | None, most: int):
    """(listing, reader of the contents of changed files, sidecars) of one folder."""
    uri = storage_uri(spark, folder)
    if can_walk(uri):
        listed = walk_folder(spark, folder, options.recursive)
        beside = listed.filter(F.col("file_path").endswith(S.SIDECAR_SUFFIX))

        def read(changed: DataFrame) -> DataFrame:
            mine = listed.select("file_path", "file_size", "raw_path").join(changed.select("file_path").hint("merge"), "file_path", "left_semi")
            return read_files(mine, uri, most)

        return listed.drop("raw_path"), read, read_files(beside, uri).select("file_path", "text")
    try:
        listed = list_files(spark, folder, options.recursive)
        found = read_contents(spark, folder, options.recursive, start, options.file_types, most)
        beside = read_sidecars(spark, folder, options.recursive)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(folder) from missing
    return listed, lambda changed: found.join(changed.select("file_path"), "file_path", "left_semi"), beside


def ingest_folders(
    spark: SparkSession,
    store: DocumentStore,
    folders: list[str],
    run_ts: datetime,
    options: IngestOptions = IngestOptions(),
    registry: ConverterRegistry | None = None,
    check: Callable[[], None] = lambda: None,
) -> IngestRun:
    """Ingest folders (paths or URIs) from storage into a store: the state is committed with the documents.

    `check` is called between steps, last before the commit; it may raise to stop the run.

    Folders are walked by tasks, names that begin with `.` or `_` included; of the files found only those
    of the wanted types that a run takes and that changed are opened, and sidecars whatever their age. A
    store that only Spark reads is listed by Spark's file index instead, without such names. A file above
    the reader's size limit becomes a failed row. A folder that is not there is reported, any other error
    is raised.
    """
    since = cursors(store.state(), [P.normalize_root(f) for f in folders])
    most = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str(2**31 - 1)))
    present, listings, readers, sidecars = [], [], [], []
    for folder in folders:
        start = None if options.full or options.date_from else since.get(P.normalize_root(folder))
        try:
            listed, read, beside = _folder(spark, folder, options, start, most)
        except FileNotFoundError:
            continue  # reported by the run
        check()
        present.append(folder)
        listings.append(listed)
        readers.append(read)
        sidecars.append(beside)
    if not present:
        none = "file_path string, file_size long, file_created_at timestamp, file_modified_time timestamp"
        listings = [as_listing(spark.createDataFrame([], none))]
        sidecars = [spark.createDataFrame([], "file_path string, text string")]
    listing, beside = (functools.reduce(DataFrame.unionByName, x) for x in (listings, sidecars))

    def contents(changed: DataFrame) -> DataFrame:
        if not readers:
            return spark.createDataFrame([], "file_path string, content binary, text string")
        return functools.reduce(DataFrame.unionByName, [read(changed) for read in readers])

    docs, state = store.documents(), store.state()
    run = ingest(listing, contents, docs, state, folders, run_ts, options, beside, registry, existing=present)
    check()
    runs = stage(run.runs)
    check()
    store.merge(run.converted, run_ts, state=merge_state(state, runs))
    return IngestRun(run.converted, run.outcomes, runs)


def ingested_documents(run: IngestRun, docs: DataFrame, run_ts: datetime) -> DataFrame:
    """The documents after a planned run, without a store."""
    return merge_documents(docs, run.converted, run_ts)
