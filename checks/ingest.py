"""Change detection, merges, ingest runs, notes, the store and the ingest stream."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from checks.scan import _KEPT
from checks.tables import query
from sparkdocs import schemas as S
from sparkdocs.functions import paths as P
from sparkdocs.functions.text import iso_time
from sparkdocs.operators.changes import (
    NOTE_COLUMNS, detect_changes, latest_per_path, merge_documents, merge_state,
)
from sparkdocs.operators.events import ingest_summary
from sparkdocs.operators.maintain import orphans
from sparkdocs.plans.ingest import IngestOptions, ingest, ingest_folders
from sparkdocs.plans.notes_import import import_notes
from sparkdocs.plans.reprocess import reprocess_html, reprocess_stored, retry_failed, retry_stored
from sparkdocs.plans.layered_store import LayeredStore
from sparkdocs.plans.store import DocumentStore
from sparkdocs.session import fresh_dir
from sparkdocs.convert.default import default_registry
from sparkdocs.convert.image import ImageSources
from sparkdocs.plans.notes_job import moved_notes, run_notes_import
from sparkdocs.plans.run_control import RunControl, ingest_cancellable
from sparkdocs.plans.export import export_markdown
from sparkdocs.sources.files import scan_listing
from sparkdocs.sources.notes import read_folders, read_notes
from sparkdocs.sources.walk import storage_uri, walk_folder
from sparkdocs.streaming.ingest_stream import start_ingest_stream

RUN_TS = datetime(2024, 6, 1, tzinfo=timezone.utc)
_RUN = "'2024-06-01T00:00:00Z'"
_ISO = "'%Y-%m-%dT%H:%M:%SZ'"

_FOUND = f"""
    found AS (
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY lower(file_path)
                                         ORDER BY file_modified_time DESC, file_path DESC, file_size DESC) AS r
            FROM {{listing}} WHERE {_KEPT}
        ) x WHERE r = 1
    )"""

_HTML = "trim(regexp_replace(replace(replace(replace(c.text, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"

# Converted rows of a run, with the stored document each one belongs to.
_CONVERTED = f"""
    conv AS (
        SELECT f.*, d.id AS doc_id, d.file_modified_time AS stored, lower(f.file_type) <> 'pdf' AS ok,
               CASE lower(f.file_type) WHEN 'md' THEN c.text WHEN 'html' THEN {_HTML}
                    WHEN 'txt' THEN '# ' || f.file_name || chr(10) || chr(10) || c.text
                    WHEN 'py' THEN '# ' || f.file_name || chr(10) || chr(10) || '```py' || chr(10) || c.text || chr(10) || '```' END AS md,
               CASE lower(f.file_type) WHEN 'md' THEN 0 WHEN 'txt' THEN 1 WHEN 'py' THEN 2 WHEN 'html' THEN 8 END AS code,
               CASE WHEN lower(f.file_type) = 'pdf' THEN 'Unsupported file type: ' || f.file_type END AS error,
               CASE WHEN s.text LIKE '%broken' THEN NULL ELSE regexp_extract(s.text, '"source_url": "([^"]*)"', 1) END AS url
        FROM found f
        LEFT JOIN {{docs}} d ON lower(d.file_path) = lower(f.file_path)
        LEFT JOIN {{contents}} c ON c.file_path = f.file_path
        LEFT JOIN {{sidecars}} s ON s.file_path = f.file_path || '.meta.json'
    )"""

_SHOWN = [
    "file_path", "file_name", "file_size", "mtime", "markdown_content", "conversion_type", "status", "error_message",
    "source", "source_url", "updated",
]


def _show(docs):
    return docs.withColumns({
        "mtime": iso_time(F.col("file_modified_time")), "updated": iso_time(F.col("updated_at"))
    }).select(_SHOWN)


@query(
    "dedup_paths",
    """
    SELECT file_path, file_name, file_size, strftime(file_modified_time, '%Y-%m-%dT%H:%M:%SZ') AS mtime FROM (
        SELECT *, row_number() OVER (PARTITION BY lower(file_path) ORDER BY file_modified_time DESC, file_path DESC, file_size DESC) AS r
        FROM {listing}) x WHERE r = 1
    """,
)
def _(t):
    kept = latest_per_path(t.listing)
    return kept.select("file_path", "file_name", "file_size", iso_time(F.col("file_modified_time")).alias("mtime"))


@query(
    "detect_changes",
    "SELECT l.file_path, d.id, CASE WHEN d.id IS NULL THEN 'new' WHEN d.file_modified_time = l.file_modified_time THEN 'unchanged' "
    "ELSE 'changed' END AS action FROM {listing} l LEFT JOIN {docs} d ON lower(d.file_path) = lower(l.file_path)",
)
def _(t):
    return detect_changes(t.listing, t.docs).select("file_path", "id", "action")


_MERGED = f"""
    SELECT d.file_path, d.file_name,
           CASE WHEN b.success THEN b.file_size ELSE d.file_size END AS file_size,
           strftime(CASE WHEN b.success THEN b.file_modified_time ELSE d.file_modified_time END, {_ISO}) AS mtime,
           CASE WHEN b.success THEN b.markdown_content ELSE d.markdown_content END AS markdown_content,
           CASE WHEN b.success THEN b.conversion_type ELSE d.conversion_type END AS conversion_type,
           CASE WHEN b.success THEN 'completed' WHEN b.success IS NOT NULL THEN 'failed' ELSE d.status END AS status,
           CASE WHEN b.success THEN NULL WHEN b.success IS NOT NULL THEN b.error_message ELSE d.error_message END AS error_message,
           CASE WHEN b.success IS NOT NULL THEN b.source ELSE d.source END AS source,
           CASE WHEN b.success IS NOT NULL THEN b.source_url ELSE d.source_url END AS source_url,
           CASE WHEN b.success IS NOT NULL THEN {_RUN} ELSE strftime(d.updated_at, {_ISO}) END AS updated
    FROM {{docs}} d LEFT JOIN {{batch}} b ON lower(b.file_path) = lower(d.file_path)
    UNION ALL
    SELECT b.file_path, b.file_name, b.file_size, strftime(b.file_modified_time, {_ISO}),
           CASE WHEN b.success THEN b.markdown_content END, CASE WHEN b.success THEN b.conversion_type END,
           CASE WHEN b.success THEN 'completed' ELSE 'failed' END, CASE WHEN NOT b.success THEN b.error_message END,
           b.source, b.source_url, {_RUN}
    FROM {{batch}} b WHERE NOT EXISTS (SELECT 1 FROM {{docs}} d WHERE lower(d.file_path) = lower(b.file_path))
"""


@query("merge_documents", _MERGED)
def _(t):
    return _show(merge_documents(t.docs, t.batch, RUN_TS))


def _new_store(t, name):
    return DocumentStore(t.spark, fresh_dir(t.spark, name), buckets=8)


@query("store_merge", _MERGED)
def _(t):
    # The same merge through a bucketed store: existing documents first, then the batch.
    store = _new_store(t, "store")
    store.replace(t.docs, RUN_TS)
    store.merge(t.batch, RUN_TS)
    return _show(store.documents())


@query("store_layers", _MERGED)
def _(t):
    # The same merge as an appended layer that masks what it touched.
    store = LayeredStore(t.spark, fresh_dir(t.spark, "layers"))
    store.replace(t.docs, RUN_TS)
    store.merge(t.batch, RUN_TS)
    return _show(store.documents())


@query("store_layers_compacted", f"SELECT * FROM ({_MERGED}) m WHERE file_path NOT LIKE '/corpus/src2/%'")
def _(t):
    store = LayeredStore(t.spark, fresh_dir(t.spark, "layers"))
    store.replace(t.docs, RUN_TS)
    store.merge(t.batch, RUN_TS)
    store.delete(t.docs.filter("file_path LIKE '/corpus/src2/%'").select("id"), RUN_TS)
    store.compact(RUN_TS)
    store.vacuum()
    return _show(store.documents())


@query(
    "merge_state",
    """
    SELECT coalesce(o.source, n.source) AS source, coalesce(o.scope_key, n.scope_key) AS scope_key,
           coalesce(n.n, o.n) AS processed, coalesce(n.cursor_at, o.cursor_at) AS cursor_at
    FROM (SELECT 'local_fs' AS source, lang AS scope_key, count(*) AS n, '2024-01-01T00:00:00Z' AS cursor_at FROM {documents} GROUP BY lang
          UNION ALL SELECT 'local_fs', source, count(*), '2024-01-01T00:00:00Z' FROM {documents} GROUP BY source) o
    FULL JOIN (SELECT 'local_fs' AS source, source AS scope_key, sum(n_chars)::BIGINT AS n,
                      CASE WHEN source <> 'src1' THEN '2024-06-01T00:00:00Z' END AS cursor_at FROM {documents} GROUP BY source
               UNION ALL SELECT 'Joplin', source, sum(n_chars)::BIGINT, '2024-06-01T00:00:00Z' FROM {documents} GROUP BY source) n
    ON o.source = n.source AND o.scope_key = n.scope_key
    """,
)
def _(t):
    def rows(source, key, n, cursor):
        counted = t.documents.groupBy(F.col(key).alias("scope_key")).agg(n.alias("processed"))
        row = {f.name: F.lit(None).cast(f.dataType) for f in S.INGEST_STATE}
        row |= {"source": F.lit(source), "scope_key": F.col("scope_key"), "processed": F.col("processed"),
                "cursor_updated_at": F.lit(cursor).cast("timestamp")}
        return counted.select(*[c.alias(k) for k, c in row.items()])

    state = rows("local_fs", "lang", F.count("*"), "2024-01-01").unionByName(
        rows("local_fs", "source", F.count("*"), "2024-01-01")
    )
    run = rows("local_fs", "source", F.sum("n_chars"), "2024-06-01").unionByName(
        rows("Joplin", "source", F.sum("n_chars"), "2024-06-01")
    )
    run = run.withColumn(
        "cursor_updated_at",
        F.when(~((F.col("source") == "local_fs") & (F.col("scope_key") == "src1")), F.col("cursor_updated_at")),
    )
    made = merge_state(state, run)
    return made.select("source", "scope_key", "processed", iso_time(F.col("cursor_updated_at")).alias("cursor_at"))


def _run(t, docs, roots=("/corpus",), **options):
    state = t.spark.createDataFrame([], S.INGEST_STATE)
    contents = t.contents
    return ingest(
        t.listing, contents, docs, state, list(roots), RUN_TS, IngestOptions(**options), sidecars=t.sidecars
    )


@query(
    "ingest_full",
    f"""
    WITH {_FOUND}, {_CONVERTED}
    SELECT file_path, file_name, file_size, strftime(file_modified_time, {_ISO}) AS mtime, md AS markdown_content,
           code AS conversion_type, CASE WHEN ok THEN 'completed' ELSE 'failed' END AS status, error AS error_message,
           'local_fs' AS source, url AS source_url, {_RUN} AS updated
    FROM conv
    """,
)
def _(t):
    empty = t.spark.createDataFrame([], S.DOCUMENTS)
    return _show(merge_documents(empty, _run(t, empty).converted, RUN_TS))


_INCREMENTAL = f"""
    WITH {_FOUND}, {_CONVERTED}, todo AS (SELECT * FROM conv WHERE doc_id IS NULL OR stored <> file_modified_time)
    SELECT d.file_path, d.file_name, CASE WHEN b.ok THEN b.file_size ELSE d.file_size END AS file_size,
           strftime(CASE WHEN b.ok THEN b.file_modified_time ELSE d.file_modified_time END, {_ISO}) AS mtime,
           CASE WHEN b.ok THEN b.md ELSE d.markdown_content END AS markdown_content,
           CASE WHEN b.ok THEN b.code ELSE d.conversion_type END AS conversion_type,
           CASE WHEN b.ok THEN 'completed' WHEN b.ok IS NOT NULL THEN 'failed' ELSE d.status END AS status,
           CASE WHEN b.ok IS NULL THEN d.error_message ELSE b.error END AS error_message,
           CASE WHEN b.ok IS NULL THEN d.source ELSE 'local_fs' END AS source,
           CASE WHEN b.ok IS NULL THEN d.source_url ELSE b.url END AS source_url,
           CASE WHEN b.ok IS NULL THEN strftime(d.updated_at, {_ISO}) ELSE {_RUN} END AS updated
    FROM {{docs}} d LEFT JOIN todo b ON b.doc_id = d.id
    UNION ALL
    SELECT file_path, file_name, file_size, strftime(file_modified_time, {_ISO}), md, code,
           CASE WHEN ok THEN 'completed' ELSE 'failed' END, error, 'local_fs', url, {_RUN}
    FROM todo WHERE doc_id IS NULL
"""


@query("ingest_incremental", _INCREMENTAL)
def _(t):
    return _show(merge_documents(t.docs, _run(t, t.docs).converted, RUN_TS))


@query("ingest_stream", _INCREMENTAL)
def _(t):
    # The listing as a stream of rows, merged batch by batch into a store that holds the documents.
    store = _new_store(t, "stream-store")
    store.replace(t.docs, RUN_TS)
    rows = f"{store.root}/listing"
    t.listing.write.parquet(rows)
    stream = t.spark.readStream.schema(t.listing.schema).parquet(rows)
    contents, sidecars = t.contents, t.sidecars
    query = start_ingest_stream(
        stream, lambda batch: contents, store, ["/corpus"], "listing", f"{store.root}/offsets",
        clock=lambda: RUN_TS, sidecars_of=lambda batch: sidecars,
    )
    query.awaitTermination()
    return _show(store.documents())


_ROOTS = ["/corpus/new", "/corpus/src1", "/corpus/src3", "/corpus/src9", "/corpus"]
_SCOPE = (
    "CASE WHEN starts_with({0}, '/corpus/new/') THEN '/corpus/new' WHEN starts_with({0}, '/corpus/src1/') THEN '/corpus/src1' "
    "WHEN starts_with({0}, '/corpus/src3/') THEN '/corpus/src3' WHEN starts_with({0}, '/corpus/src9/') THEN '/corpus/src9' ELSE '/corpus' END"
)


@query(
    "ingest_many",
    f"""
    WITH {_FOUND}, {_CONVERTED},
    o AS (SELECT {_SCOPE.format('file_path')} AS scope_key,
                 CASE WHEN doc_id IS NOT NULL AND stored = file_modified_time THEN 's' WHEN ok THEN 'p' ELSE 'e' END AS x FROM conv),
    n AS (SELECT scope_key, count(*) AS total_files, count(*) FILTER (WHERE x = 'p') AS processed,
                 count(*) FILTER (WHERE x = 's') AS skipped, count(*) FILTER (WHERE x = 'e') AS errors FROM o GROUP BY scope_key),
    r AS (SELECT unnest({_ROOTS}) AS scope_key)
    SELECT scope_key, coalesce(total_files, 0) AS total_files, coalesce(processed, 0) AS processed, coalesce(skipped, 0) AS skipped,
           coalesce(errors, 0) AS errors, CASE WHEN scope_key = '/corpus/src3' THEN 'invalid_directory' END AS error
    FROM r LEFT JOIN n USING (scope_key)
    """,
)
def _(t):
    runs = _run(t, t.docs, _ROOTS).runs
    return runs.select(
        "scope_key", "total_files", "processed", "skipped", "errors", F.col("last_error_message").alias("error")
    )


@query(
    "ingest_run_events",
    f"""
    WITH {_FOUND}, {_CONVERTED},
    o AS (SELECT CASE WHEN doc_id IS NOT NULL AND stored = file_modified_time THEN 'file_skip' WHEN ok THEN 'file_success' ELSE 'file_error' END AS stage,
                 file_path, file_name, row_number() OVER (ORDER BY file_path) AS i, count(*) OVER () AS n, error,
                 doc_id IS NOT NULL AND stored = file_modified_time AS same FROM conv)
    SELECT 2 * i AS event_no, 'file_processing' AS stage, file_path AS message, file_name AS current_file,
           CAST(floor(i / n * 100) AS INTEGER) AS progress FROM o
    UNION ALL SELECT 2 * i + 1, stage, CASE WHEN stage = 'file_error' THEN error ELSE file_path END, file_name, NULL FROM o
    UNION ALL SELECT 0, 'scan_start', '/corpus', NULL, NULL
    UNION ALL SELECT 1, 'scan_complete', CAST(count(*) AS VARCHAR), NULL, NULL FROM o
    UNION ALL SELECT 2 * count(*) + 2, 'done', '{{{{"total_files":' || count(*) || ',"processed":' || count(*) FILTER (WHERE stage = 'file_success')
              || ',"skipped":' || count(*) FILTER (WHERE same) || ',"errors":' || count(*) FILTER (WHERE stage = 'file_error') || '}}}}', NULL, NULL FROM o
    """,
)
def _(t):
    return _run(t, t.docs).events(RUN_TS).select("event_no", "stage", "message", "current_file", "progress")


_CURSOR = datetime(2024, 1, 2, 12, tzinfo=timezone.utc)
_PATH = "'joplin://' || coalesce(w.p, '') || '/' || n.title || '__' || n.id"
_NOTES = f"""
    WITH RECURSIVE walk AS (
        SELECT id, title AS p FROM {{folders}} WHERE parent_id = ''
        UNION ALL SELECT f.id, w.p || '/' || f.title FROM {{folders}} f JOIN walk w ON f.parent_id = w.id
    )
    SELECT {_PATH} AS file_path, n.title AS file_name, CASE WHEN n.markup_language = 2 THEN 'md' ELSE 'html' END AS file_type,
           octet_length(encode(n.body)) AS file_size, strftime(make_timestamp(n.created_time * 1000), {_ISO}) AS created,
           strftime(make_timestamp(n.updated_time * 1000), {_ISO}) AS mtime, 'Joplin' AS source, coalesce(n.source_url, '') AS source_url,
           CASE WHEN n.body = '' THEN 0 ELSE 3 END AS conversion_type,
           trim(regexp_replace(n.body, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS markdown_content
    FROM {{notes}} n LEFT JOIN walk w ON w.id = n.parent_id
"""


def _note_rows(df):
    return df.select(
        "file_path", "file_name", "file_type", "file_size", iso_time(F.col("file_created_at")).alias("created"),
        iso_time(F.col("file_modified_time")).alias("mtime"), "source", "source_url", "conversion_type", "markdown_content",
    )


@query("notes_import", _NOTES)
def _(t):
    empty = t.spark.createDataFrame([], S.DOCUMENTS)
    run = import_notes(t.notes, t.folders, empty)
    return _note_rows(merge_documents(empty, run.converted, RUN_TS, NOTE_COLUMNS))


@query(
    "notes_incremental",
    _NOTES + " WHERE n.updated_time >= 1704196800000",
)
def _(t):
    empty = t.spark.createDataFrame([], S.DOCUMENTS)
    return _note_rows(import_notes(t.notes, t.folders, empty, cursor=_CURSOR).converted)


@query(
    "notes_summary",
    "SELECT 'Joplin' AS scope_key, count(*) AS total_files, count(*) FILTER (WHERE updated_time >= 1704196800000) AS processed, "
    "count(*) FILTER (WHERE updated_time < 1704196800000) AS skipped, 0 AS errors FROM {notes}",
)
def _(t):
    empty = t.spark.createDataFrame([], S.DOCUMENTS)
    return ingest_summary(import_notes(t.notes, t.folders, empty, cursor=_CURSOR).outcomes)


@query(
    "all_sources",
    "SELECT source, count(*) AS n, sum(file_size)::BIGINT AS bytes FROM (SELECT source, file_size FROM {docs} UNION ALL "
    "SELECT 'Joplin', octet_length(encode(body)) FROM {notes}) u GROUP BY source",
)
def _(t):
    run = import_notes(t.notes, t.folders, t.docs)
    both = merge_documents(t.docs, run.converted, RUN_TS, NOTE_COLUMNS)
    return both.groupBy("source").agg(F.count("*").alias("n"), F.sum("file_size").alias("bytes"))


_RETRIED = """
    SELECT id, CASE WHEN status = 'failed' AND file_type NOT IN ('pdf', 'PDF') THEN 'completed' ELSE status END AS status,
           CASE WHEN status = 'failed' AND file_type = 'md' THEN 'again ' || markdown_content
                WHEN status = 'failed' AND file_type = 'txt' THEN '# ' || file_name || chr(10) || chr(10) || 'again ' || markdown_content
                WHEN status = 'failed' AND file_type = 'py' THEN '# ' || file_name || chr(10) || chr(10) || '```py' || chr(10) || 'again ' || markdown_content || chr(10) || '```'
                WHEN status = 'failed' AND file_type = 'html' THEN trim(regexp_replace('again ' || markdown_content, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))
                ELSE markdown_content END AS markdown_content,
           CASE WHEN status = 'failed' AND lower(file_type) = 'pdf' THEN 'Unsupported file type: ' || file_type END AS error_message
    FROM {docs}
    """


@query("retry_failed", _RETRIED)
def _(t):
    contents = t.docs.select("file_path", F.concat(F.lit("again "), "markdown_content").alias("text"))
    after, _ = retry_failed(t.docs, t.docs.select("id"), contents, RUN_TS)
    return after.select("id", "status", "markdown_content", "error_message")


@query(
    "reprocess_html_run",
    """
    SELECT id, CASE WHEN file_type = 'html' THEN 'completed' ELSE status END AS status,
           CASE WHEN file_type = 'html' THEN '**bold** ' || trim(regexp_replace(markdown_content, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))
                ELSE markdown_content END AS markdown_content
    FROM {docs}
    """,
)
def _(t):
    contents = t.docs.select("file_path", F.concat(F.lit("<b>bold</b> "), "markdown_content").alias("text"))
    return reprocess_html(t.docs, contents, RUN_TS).select("id", "status", "markdown_content")


@query(
    "orphans_emptied",
    """
    SELECT id, file_path FROM {docs} WHERE starts_with(file_path, '/corpus/src2/')
    """,
)
def _(t):
    nothing = t.listing.filter(F.lit(False))
    return orphans(t.docs, nothing, "/corpus/src2/", folder_exists=True).select("id", "file_path")


@query(
    "uri_paths",
    """
    SELECT doc_id, 's3a://bucket/' || source || '/' || doc_id || '.md' AS remote, '/' || source || '/' || doc_id || '.md' AS local_file,
           'hdfs://nn:8020/' || source || '/x.md' AS dotted
    FROM {documents}
    """,
)
def _(t):
    name = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return t.documents.select(
        "doc_id", P.normalize_path(F.concat(F.lit("s3a://bucket//./"), name)).alias("remote"),
        P.normalize_path(F.concat(F.lit("file:///"), name)).alias("local_file"),
        P.normalize_path(F.concat(F.lit("hdfs://nn:8020/a/../"), "source", F.lit("/x.md"))).alias("dotted"),
    )


_STREAM_ROOTS = [f"/corpus/src{i}" for i in range(20) if i != 5] + ["/corpus/new", "/corpus/none"]
_STREAMED = f"""
    WITH {_FOUND}
    SELECT '/corpus/' || split_part(file_path, '/', 3) AS scope_key, count(*) AS total_files, count(*) AS handled, NULL AS error
    FROM found WHERE '/corpus/' || split_part(file_path, '/', 3) IN ({", ".join(f"'{r}'" for r in _STREAM_ROOTS)}) GROUP BY ALL
    """


@query("ingest_stream_state", _STREAMED)
def _(t):
    # All files in one stream, cut into several batches; one source is not asked for, a folder without a row gets no state.
    store = _new_store(t, "stream-state")
    rows = f"{store.root}/listing"
    t.listing.repartition(3, F.lower("file_path")).write.parquet(rows)  # copies of a path stay in one batch
    stream = t.spark.readStream.schema(t.listing.schema).option("maxFilesPerTrigger", 1).parquet(rows)
    contents, sidecars = t.contents, t.sidecars
    start_ingest_stream(
        stream, lambda batch: contents, store, _STREAM_ROOTS, "state", f"{store.root}/offsets",
        clock=lambda: RUN_TS, sidecars_of=lambda batch: sidecars,
    ).awaitTermination()
    handled = F.col("processed") + F.col("skipped") + F.col("errors")
    return store.state().select("scope_key", "total_files", handled.alias("handled"), F.col("last_error_message").alias("error"))


def _write_files(rows, root):
    """One file per row (rel, text) below `root`, written by the tasks that hold the rows."""
    uri = storage_uri(rows.sparkSession, root)

    def write(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for rel, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system.create_dir(f"{base}/{rel}".rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(f"{base}/{rel}") as sink:
                    sink.write(text.encode("utf-8"))
            yield batch.select([0])

    rows.mapInArrow(write, "rel string").write.format("noop").mode("overwrite").save()


@query(
    "ingest_folder_uri",
    f"""
    SELECT 'd-' || md5(text) AS name, min(md5(text)) AS text_md5, count(*) > 0 AS completed
    FROM {{documents}} WHERE text IS NOT NULL AND text <> '' GROUP BY text
    """,
)
def _(t):
    # Each distinct text is written as a file of its own below a shared folder, which is then ingested by URI.
    root = fresh_dir(t.spark, "uri-folder")
    texts = t.documents.filter("text IS NOT NULL AND text <> ''").select("text").distinct()
    rel = F.concat(F.lit("name=d-"), F.md5("text"), F.lit("/text.txt"))
    _write_files(texts.select(rel.alias("rel"), F.concat("text", F.lit("\u0000")).alias("text")), root)
    uri = root if ":" in root.split("/")[0] else f"file://{root}"
    store = _new_store(t, "uri-store")
    ingest_folders(t.spark, store, [uri + "/"], RUN_TS, IngestOptions(file_types="txt"))
    body = F.regexp_replace(F.regexp_replace("markdown_content", r"^# [^\n]*\n\n", ""), "\u0000$", "")
    return store.documents().select(
        F.regexp_extract("file_path", "name=([^/]*)/", 1).alias("name"), F.md5(body).alias("text_md5"),
        (F.col("status") == "completed").alias("completed"),
    )


@query("store_retry", _RETRIED)
def _(t):
    store = _new_store(t, "store-retry")
    store.replace(t.docs, RUN_TS)
    contents = t.docs.select("file_path", F.concat(F.lit("again "), "markdown_content").alias("text"))
    retry_stored(store, t.docs.select("id"), contents, RUN_TS)
    return store.documents().select("id", "status", "markdown_content", "error_message")


@query(
    "store_reprocess",
    """
    SELECT id, CASE WHEN file_type = 'html' THEN 'completed' ELSE status END AS status,
           CASE WHEN file_type = 'html' THEN '**bold** ' || trim(regexp_replace(markdown_content, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))
                ELSE markdown_content END AS markdown_content
    FROM {docs}
    """,
)
def _(t):
    store = _new_store(t, "store-reprocess")
    store.replace(t.docs, RUN_TS)
    reprocess_stored(store, t.docs.select("file_path", F.concat(F.lit("<b>bold</b> "), "markdown_content").alias("text")), RUN_TS)
    return store.documents().select("id", "status", "markdown_content")


@query("notes_from_json", _NOTES)
def _(t):
    # The same import from the JSON lines of an export.
    root = fresh_dir(t.spark, "notes-json")
    t.notes.write.json(f"{root}/notes")
    t.folders.write.json(f"{root}/folders")
    empty = t.spark.createDataFrame([], S.DOCUMENTS)
    run = import_notes(read_notes(t.spark, f"{root}/notes"), read_folders(t.spark, f"{root}/folders"), empty)
    return _note_rows(merge_documents(empty, run.converted, RUN_TS, NOTE_COLUMNS))


_SECOND = "2024-01-01 02:00:00"


@query(
    "ingest_second_run",
    f"""
    WITH {_FOUND}, {_CONVERTED}
    SELECT '/corpus' AS scope_key, count(*) AS total_files, count(*) FILTER (WHERE ok AND (doc_id IS NULL OR stored <> file_modified_time)) AS processed,
           count(*) FILTER (WHERE doc_id IS NOT NULL AND stored = file_modified_time) AS skipped,
           count(*) FILTER (WHERE NOT ok AND (doc_id IS NULL OR stored <> file_modified_time)) AS errors, '2024-06-01T00:00:00Z' AS cursor_at
    FROM conv WHERE file_modified_time >= TIMESTAMP '{_SECOND}'
    """,
)
def _(t):
    # The state holds the cursor of an earlier run: older files are not looked at.
    row = {"source": "local_fs", "scope_key": "/corpus", "cursor_updated_at": datetime.fromisoformat(_SECOND).replace(tzinfo=timezone.utc)}
    state = t.spark.createDataFrame([tuple(row.get(f.name) for f in S.INGEST_STATE)], S.INGEST_STATE)
    run = ingest(t.listing, t.contents, t.docs, state, ["/corpus"], RUN_TS, IngestOptions(), t.sidecars)
    after = merge_state(state, run.runs)
    return after.select("scope_key", "total_files", "processed", "skipped", "errors", iso_time(F.col("cursor_updated_at")).alias("cursor_at"))


@query("store_delete", "SELECT id, file_path, markdown_content FROM {docs} WHERE coalesce(status, '') <> 'failed'")
def _(t):
    store = _new_store(t, "store-delete")
    store.replace(t.docs, RUN_TS)
    store.delete(t.docs.filter("status = 'failed'").select("id"), RUN_TS)
    return store.documents().select("id", "file_path", "markdown_content")


# Names below a tree written from the documents: hidden ones, deep and wide folders, some that a scan shuts out.
_TREE = (
    "CASE doc_id % 7 WHEN 0 THEN '.hidden/.' || doc_id || '.md' WHEN 1 THEN '_private/_' || doc_id || '.txt' "
    "WHEN 2 THEN 'deep/' || substr(md5(text), 1, 1) || '/' || substr(md5(text), 2, 1) || '/' || lang || '/' || source || '/a/b/' || doc_id || '.html' "
    "WHEN 3 THEN 'wide/' || doc_id || '.md' WHEN 4 THEN source || '/.git/' || doc_id || '.md' "
    "WHEN 5 THEN 'pics ' || lang || '.Assets/' || doc_id || '.md' ELSE 'noext/' || doc_id END"
)


def _write_tree(t, name):
    """A folder with the text of each document under its name."""
    root = fresh_dir(t.spark, name)
    _write_files(t.documents.select(F.expr(_TREE).alias("rel"), F.coalesce("text", F.lit("")).alias("text")), root)
    return root


@query(
    "scan_folder",
    f"""
    SELECT rel, regexp_extract(rel, '[^/]*$') AS file_name, size FROM (
        SELECT {_TREE} AS rel, octet_length(encode(coalesce(text, ''))) AS size FROM {{documents}}) x
    WHERE rel NOT LIKE '%/.git/%' AND rel NOT LIKE '%.Assets/%'
    """,
)
def _(t):
    root = _write_tree(t, "walk")
    found = scan_listing(walk_folder(t.spark, root), P.normalize_root(root))
    return found.select(P.relative(F.col("file_path"), P.normalize_root(root)).alias("rel"), "file_name", F.col("file_size").alias("size"))


@query(
    "scan_folder_all",
    f"SELECT {_TREE} AS rel, CASE WHEN doc_id % 7 = 6 THEN '' ELSE split_part({_TREE}, '.', -1) END AS file_type FROM {{documents}}",
)
def _(t):
    # As a check for orphans lists it: nothing is shut out.
    root = _write_tree(t, "walk-all")
    rel = P.relative(F.col("file_path"), P.normalize_root(root)).alias("rel")
    return walk_folder(t.spark, root, exclude=False).select(rel, "file_type")


@query(
    "ingest_folder_hidden",
    f"""
    SELECT rel, octet_length(encode(text)) AS file_size, 'completed' AS status, md5(CASE WHEN rel LIKE '%.md' THEN text
           ELSE '# ' || regexp_extract(rel, '[^/]*$') || chr(10) || chr(10) || text END) AS content
    FROM (SELECT {_TREE} AS rel, coalesce(text, '') AS text FROM {{documents}}) x
    WHERE rel NOT LIKE '%/.git/%' AND rel NOT LIKE '%.Assets/%' AND (rel LIKE '%.md' OR rel LIKE '%.txt')
    """,
)
def _(t):
    root = _write_tree(t, "hidden")
    store = _new_store(t, "hidden-store")
    ingest_folders(t.spark, store, [root], RUN_TS, IngestOptions(file_types="md,txt"))
    rel = P.relative(F.col("file_path"), P.normalize_root(root)).alias("rel")
    return store.documents().select(rel, "file_size", "status", F.md5("markdown_content").alias("content"))


@query(
    "export_counts",
    "SELECT count(*) AS total, count(*) FILTER (WHERE lower(file_type) <> 'pdf') AS success, "
    "count(*) FILTER (WHERE lower(file_type) = 'pdf') AS failed FROM {docs}",
)
def _(t):
    out = fresh_dir(t.spark, "export")
    contents = t.docs.select("file_path", F.col("markdown_content").alias("text"))
    return export_markdown(t.docs, contents, "/corpus", storage_uri(t.spark, out))


# Images of the attempts: their paths as files, the provider `view` standing for local text recognition.
_CHAIN_AT = "CASE provider WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 END"
_WON = f"""
    a AS (SELECT *, {_CHAIN_AT} AS pos FROM {{attempts}}),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, provider ORDER BY attempt_no) AS r FROM a) x
          WHERE r = 1 AND pos IS NOT NULL),
    g AS (SELECT path, min(pos) FILTER (WHERE ok) AS won,
                 string_agg('provider=' || CASE provider WHEN 'view' THEN 'local' ELSE provider END || ' error=' || coalesce(error, 'None'), '; ' ORDER BY pos) AS tried
          FROM f GROUP BY path),
    p AS (SELECT DISTINCT path FROM {{attempts}}),
    w AS (SELECT p.path, won, tried, f.content FROM p LEFT JOIN g ON g.path = p.path LEFT JOIN f ON f.path = g.path AND f.pos = g.won)"""


def _image_run(t, registry):
    files = t.attempts.select("path").distinct()
    listing = files.select(
        F.concat("path", F.lit(".png")).alias("file_name"), F.lit("png").alias("file_type"), F.length("path").cast("long").alias("file_size"),
        F.lit(RUN_TS).cast("timestamp").alias("file_created_at"), F.lit(RUN_TS).cast("timestamp").alias("file_modified_time"),
        F.concat(F.lit("/img/"), "path", F.lit(".png")).alias("file_path"),
    )
    contents = listing.select("file_path", F.encode("file_name", "UTF-8").alias("content"), F.lit(None).cast("string").alias("text"))
    none = t.spark.createDataFrame([], S.DOCUMENTS)
    run = ingest(listing, contents, none, t.spark.createDataFrame([], S.INGEST_STATE), ["/img"], RUN_TS, registry=registry)
    return merge_documents(none, run.converted, RUN_TS)


def _image_sources(t):
    path = F.concat(F.lit("/img/"), "path", F.lit(".png"))
    provider = F.when(F.col("provider") == "view", "local").otherwise(F.col("provider"))
    exif = t.attempts.select("path").distinct().select(
        path.alias("file_path"), F.create_map(F.lit("Model"), F.substring("path", 1, 3), F.lit("Make"), F.lit("m")).alias("exif")
    )
    return ImageSources(t.attempts.withColumn("path", path).withColumn("provider", provider), "purchase", ["local", "click"], exif)


@query(
    "image_markdown",
    f"""
    WITH {_WON}
    SELECT path || '.png' AS file_name, 5 AS conversion_type, CASE won WHEN 2 THEN
        '---' || e || e || 'source_file: ' || path || '.png' || e || 'provider: local-ocr' || e || 'hash_sha256: ' || sha256(path || '.png') || e
        || 'file_size: ' || length(path) || e || 'modified_time: 2024-06-01T00:00:00' || e || 'exif:' || e || '  Model: ' || substr(path, 1, 3) || e
        || '  Make: m' || e || 'ocr_lang: eng' || e || e || '---' || e || e || '# ' || path || '.png' || e || e || content || e
        ELSE content END AS markdown_content
    FROM w, (SELECT chr(10) AS e) WHERE won IS NOT NULL
    """,
)
def _(t):
    made = _image_run(t, default_registry(images=_image_sources(t)))
    return made.filter("status = 'completed'").select("file_name", "conversion_type", "markdown_content")


@query(
    "image_failed",
    f"""
    WITH {_WON}
    SELECT path || '.png' AS file_name, 'Image OCR/caption extraction failed: ' || coalesce(tried, 'no providers attempted') AS error_message
    FROM w WHERE won IS NULL
    """,
)
def _(t):
    made = _image_run(t, default_registry(images=_image_sources(t)))
    return made.filter("status = 'failed'").select("file_name", "error_message")


@query(
    "image_off",
    "SELECT DISTINCT path || '.png' AS file_name, 'completed' AS status, 5 AS conversion_type, '# ' || path || '.png' || chr(10) AS markdown_content FROM {attempts}",
)
def _(t):
    return _image_run(t, default_registry()).select("file_name", "status", "conversion_type", "markdown_content")


_YEAR_MS = 366 * 86_400_000


@query(
    "notes_job_state",
    """
    WITH n AS (SELECT count(*) AS n, count(*) FILTER (WHERE markup_language = 2) AS u,
                      count(*) FILTER (WHERE markup_language <> 2 AND id LIKE '%x1') AS c FROM {notes})
    SELECT 1 AS run, n AS total_files, n AS processed, 0 AS skipped, 0 AS errors, '2024-06-01T00:00:00Z' AS cursor_at FROM n
    UNION ALL SELECT 2, n, u, n - u, 0, '2024-08-01T00:00:00Z' FROM n
    UNION ALL SELECT 3, n, 0, n, 0, '2025-06-01T00:00:00Z' FROM n
    UNION ALL SELECT 4, c, c, 0, 0, '2025-07-01T00:00:00Z' FROM n
    """,
)
def _(t):
    # All notes; then those of users a year later; a full run that finds nothing new; chosen notes at last.
    store = _new_store(t, "notes-store")
    later = F.when(F.col("markup_language") == 2, F.col("updated_time") + _YEAR_MS).otherwise(F.col("updated_time"))
    second = t.notes.withColumn("updated_time", later)
    third = second.withColumn("updated_time", F.col("updated_time") + 1000 * _YEAR_MS)
    chosen = t.notes.filter("markup_language <> 2 AND id LIKE '%x1'").select("id")
    found = None
    for no, (notes, at, how) in enumerate([
        (t.notes, RUN_TS, {}), (second, datetime(2024, 8, 1, tzinfo=timezone.utc), {}),
        (second, datetime(2025, 6, 1, tzinfo=timezone.utc), {"full_resync": True}),
        (third, datetime(2025, 7, 1, tzinfo=timezone.utc), {"ids": chosen}),
    ]):
        run_notes_import(store, notes, t.folders, at, **how)
        row = store.state().select(
            F.lit(no + 1).alias("run"), "total_files", "processed", "skipped", "errors", iso_time(F.col("cursor_updated_at")).alias("cursor_at")
        )
        found = row if found is None else found.unionByName(row)
    return found


@query(
    "notes_moved",
    f"""
    WITH RECURSIVE walk AS (
        SELECT id, title AS p FROM {{folders}} WHERE parent_id = ''
        UNION ALL SELECT f.id, w.p || '/' || f.title FROM {{folders}} f JOIN walk w ON f.parent_id = w.id
    )
    SELECT {_PATH} AS file_path, replace({_PATH}, '/' || n.title || '__', '/New ' || n.title || '__') AS new_path
    FROM {{notes}} n LEFT JOIN walk w ON w.id = n.parent_id WHERE n.markup_language = 2
    """,
)
def _(t):
    store = _new_store(t, "moved-store")
    run_notes_import(store, t.notes, t.folders, RUN_TS)
    mine = F.col("markup_language") == 2
    renamed = t.notes.withColumn("title", F.when(mine, F.concat(F.lit("New "), "title")).otherwise(F.col("title"))).withColumn(
        "updated_time", F.when(mine, F.col("updated_time") + _YEAR_MS).otherwise(F.col("updated_time"))
    )
    run_notes_import(store, renamed, t.folders, datetime(2025, 6, 1, tzinfo=timezone.utc), full_resync=True)
    return moved_notes(store.documents()).select("file_path", "new_path")


_TAKEN = f"(SELECT count(*) AS n FROM (SELECT {_TREE} AS rel FROM {{documents}}) x WHERE rel LIKE 'wide/%' OR rel LIKE '.hidden/%')"


@query(
    "ingest_cancelled",
    f"""
    WITH c AS {_TAKEN}
    SELECT 1 AS run, 0 AS event_no, 'info' AS level, 'scan_start' AS stage, 0 AS documents, 0 AS states
    UNION ALL SELECT 1, 1, 'warning', 'cancelled', 0, 0 UNION ALL SELECT 1, 2, 'warning', 'done', 0, 0
    UNION ALL SELECT 2, 0, 'info', 'scan_start', n, 1 FROM c UNION ALL SELECT 2, 1, 'info', 'scan_complete', n, 1 FROM c
    UNION ALL SELECT 2, 2 * n + 2, 'info', 'done', n, 1 FROM c
    """,
)
def _(t):
    # A run that another thread stops while it plans its conversions, then the same run again.
    import threading

    root = _write_tree(t, "cancel")
    store = _new_store(t, "cancel-store")
    control = RunControl(t.spark, "cancel")

    def stopping(rows):
        other = threading.Thread(target=control.cancel)
        other.start()
        other.join()
        return rows.select(*[c for c in rows.columns if c not in ("text", "content")], F.col("text").alias("markdown_content"), F.lit(None).cast("string").alias("error_message"))

    registry = default_registry()
    registry.register(["md"], 0, frame=stopping)
    options = IngestOptions(file_types="md")
    _, first = ingest_cancellable(control, store, [root], RUN_TS, options, registry=registry)
    held = store.documents().count(), store.state().count()
    told = first.select(F.lit(1).alias("run"), "event_no", "level", "stage", F.lit(held[0]).alias("documents"), F.lit(held[1]).alias("states"))
    _, second = ingest_cancellable(RunControl(t.spark, "again"), store, [root], RUN_TS, options)
    held = store.documents().count(), store.state().count()
    again = second.filter("stage IN ('scan_start', 'scan_complete', 'done')").select(
        F.lit(2).alias("run"), "event_no", "level", "stage", F.lit(held[0]).alias("documents"), F.lit(held[1]).alias("states")
    )
    return told.unionByName(again)
