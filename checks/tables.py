"""Test tables, the views derived from them, and the registry of checked queries.

A view's SQL text runs unchanged in Spark and in DuckDB, so both sides start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdocs.operators.sizes import IdSet
from sparkdocs.session import prepare, stage

BASE = {
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
}

# Views that stand for stored tables and are costly to derive again for each branch of a plan.
STAGED = {"listing", "contents"}

_START = "TIMESTAMP '2024-01-01 00:00:00'"

VIEWS = {
    # Every document as a stored file; those of one source failed to convert.
    "docs": f"""
        SELECT id, file_name, file_type, file_size,
               mtime - INTERVAL '1' HOUR AS file_created_at, mtime AS file_modified_time,
               '/corpus/' || source || '/' || lang || '/' || file_name AS file_path,
               markdown_content, conversion_type,
               CASE WHEN source = 'src4' THEN 'failed' ELSE 'completed' END AS status,
               CASE WHEN source = 'src4' THEN 'no converter for ' || file_type END AS error_message,
               source,
               CASE WHEN lang = 'en' THEN 'https://example.org/' || file_name END AS source_url,
               mtime + INTERVAL '1' HOUR AS created_at, mtime + INTERVAL '1' DAY AS updated_at
        FROM (
            SELECT doc_id AS id, 'doc_' || doc_id || '.' || ext AS file_name, ext AS file_type,
                   n_chars AS file_size, {_START} + doc_id * INTERVAL '1' MINUTE AS mtime,
                   lang, source, text AS markdown_content,
                   CASE ext WHEN 'md' THEN 0 WHEN 'txt' THEN 1 WHEN 'py' THEN 2 WHEN 'html' THEN 8
                            ELSE 3 END AS conversion_type
            FROM (
                SELECT *, CASE doc_id % 6 WHEN 0 THEN 'md' WHEN 1 THEN 'txt' WHEN 2 THEN 'py'
                               WHEN 3 THEN 'html' WHEN 4 THEN 'pdf' ELSE 'PDF' END AS ext
                FROM {{documents}}
            ) typed
        ) named
    """,
    # The disk as a scan finds it: one source's folder is gone, German files were saved again, Spanish
    # paths differ in case; one source has a second copy, others lie in folders or under names that a
    # scan leaves out.
    "listing": """
        SELECT file_name, file_type, file_size, file_created_at,
               CASE WHEN file_path LIKE '%/de/%' THEN file_modified_time + INTERVAL '1' HOUR
                    ELSE file_modified_time END AS file_modified_time,
               CASE WHEN file_path LIKE '%/es/%' THEN replace(file_path, '/es/doc', '/ES/DOC')
                    ELSE file_path END AS file_path
        FROM {docs} WHERE source <> 'src3'
        UNION ALL
        SELECT file_name, file_type, file_size, file_created_at, file_modified_time,
               replace(file_path, '/corpus/', '/corpus/new/') AS file_path
        FROM {docs} WHERE source = 'src5'
        UNION ALL
        SELECT file_name, file_type, file_size, file_created_at,
               file_modified_time - INTERVAL '2' HOUR AS file_modified_time,
               replace(file_path, '/doc_', '/Doc_') AS file_path
        FROM {docs} WHERE source = 'src6'
        UNION ALL
        SELECT file_name, file_type, file_size, file_created_at, file_modified_time,
               replace(file_path, '/corpus/src7/', '/corpus/src7/.git/') AS file_path
        FROM {docs} WHERE source = 'src7'
        UNION ALL
        SELECT file_name, file_type, file_size, file_created_at, file_modified_time,
               replace(file_path, '/corpus/src8/', '/corpus/src8/pics.Assets/') AS file_path
        FROM {docs} WHERE source = 'src8'
        UNION ALL
        SELECT file_name || '.TMP' AS file_name, 'TMP' AS file_type, file_size, file_created_at,
               file_modified_time, file_path || '.TMP' AS file_path
        FROM {docs} WHERE source = 'src9'
        UNION ALL
        SELECT file_name, file_type, file_size, file_created_at, file_modified_time,
               '/corpus/' || file_name AS file_path
        FROM {docs} WHERE source = 'src10'
    """,
    # Contents of listed files.
    "contents": """
        SELECT l.file_path, d.markdown_content AS text
        FROM {listing} l JOIN {docs} d ON lower(d.file_name) = lower(l.file_name)
    """,
    # A converted batch: every listed text file, PDFs fail.
    "batch": """
        SELECT l.file_name, l.file_type, l.file_size, l.file_created_at, l.file_modified_time, l.file_path,
               d.id AS id, '# ' || l.file_name || ' ' || d.markdown_content AS markdown_content, 1 AS conversion_type,
               lower(l.file_type) <> 'pdf' AS success,
               CASE WHEN lower(l.file_type) = 'pdf' THEN 'Unsupported file type: ' || l.file_type END AS error_message,
               'local_fs' AS source, CAST(NULL AS VARCHAR(10)) AS source_url
        FROM {listing} l JOIN {docs} d ON lower(d.file_path) = lower(l.file_path)
        WHERE l.file_path NOT LIKE '%/Doc_%'
        UNION ALL
        SELECT l.file_name, l.file_type, l.file_size, l.file_created_at, l.file_modified_time, l.file_path,
               d.id + 1000000000 AS id, '# ' || l.file_name || ' ' || d.markdown_content AS markdown_content, 1 AS conversion_type,
               lower(l.file_type) <> 'pdf' AS success,
               CASE WHEN lower(l.file_type) = 'pdf' THEN 'Unsupported file type: ' || l.file_type END AS error_message,
               'local_fs' AS source, CAST(NULL AS VARCHAR(10)) AS source_url
        FROM {listing} l JOIN {docs} d ON d.file_name = l.file_name
        WHERE l.file_path LIKE '/corpus/new/%'
    """,
    "sidecars": """
        SELECT file_path || '.meta.json' AS file_path,
               CASE WHEN file_type = 'py' THEN '{{"source_url": broken'
                    ELSE '{{"source_url": "https://example.org/' || file_name || '", "n": 1}}' END AS text
        FROM {docs} WHERE file_path NOT LIKE '%/fr/%'
    """,
    # Folders as a tree of five children each; conversations as notes in them.
    "folders": """
        SELECT CAST(p_partkey AS VARCHAR(20)) AS id,
               CASE WHEN p_partkey = 0 THEN '' ELSE CAST(CAST(floor((p_partkey - 1) / 5) AS BIGINT) AS VARCHAR(20)) END AS parent_id,
               p_name AS title
        FROM {part}
    """,
    "notes": """
        SELECT conv_id || 'x' || turn AS id, CAST(conv_id AS VARCHAR(20)) AS parent_id,
               role || ' ' || turn AS title, text AS body,
               1704067200000 + conv_id * 3600000 AS created_time,
               1704067200000 + conv_id * 3600000 + turn * 60000 AS updated_time,
               CASE WHEN role = 'user' THEN 2 ELSE 1 END AS markup_language,
               CASE WHEN role = 'user' THEN 'https://example.org/' || conv_id END AS source_url
        FROM {conversations}
    """,
    "ingest_events": """
        SELECT CAST(user_id AS VARCHAR(20)) AS session_id, event_id AS event_no, ts, 'info' AS level,
               CASE event_type WHEN 'signup' THEN 'scan_start' WHEN 'view' THEN 'file_processing'
                    WHEN 'click' THEN 'file_success' WHEN 'error' THEN 'file_error' ELSE 'debug_state' END AS stage,
               props AS message
        FROM {events}
    """,
    # Attempts of five providers, one path per user and day.
    "attempts": """
        SELECT user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS path, event_type AS provider,
               event_id AS attempt_no, value > 60 AS ok, 'text ' || event_id AS content,
               CASE WHEN value > 60 THEN NULL ELSE 'e' || event_id END AS error
        FROM {events}
    """,
    # Outlines of forty topics each, three children per topic.
    "outline": """
        SELECT 'outline_' || f || '.xmind' AS file, 0 AS sheet, CAST(k AS VARCHAR(20)) AS node_id,
               CASE WHEN j > 0 THEN CAST(f * 40 + CAST(floor((j - 1) / 3) AS BIGINT) AS VARCHAR(20)) END AS parent_id,
               CASE WHEN j > 0 THEN (j - 1) % 3 ELSE 0 END AS ordinal, p_name AS title
        FROM (SELECT p_partkey AS k, CAST(floor(p_partkey / 40) AS BIGINT) AS f, p_partkey % 40 AS j, p_name
              FROM {part}) t
    """,
}


def _names(sql: str) -> list[str]:
    return [n for n in [*VIEWS, *BASE] if "{" + n + "}" in sql.replace("{{", "").replace("}}", "")]


class Tables:
    """Base tables and views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in BASE:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                made = self._batch() if name == "batch" else self._view(VIEWS[name])
                self._made[name] = stage(made) if name in STAGED else made
        return self._made[name]

    def _view(self, sql: str, **other: DataFrame) -> DataFrame:
        return self.spark.sql(sql, **{n: getattr(self, n) for n in _names(sql)} | other)

    def _batch(self) -> DataFrame:
        """Both halves of the view. Documents without a listed name have no row in the second: their texts stay out of its join."""
        first, second = VIEWS["batch"].split("UNION ALL")
        name = F.xxhash64("file_name").alias("id")
        listed = IdSet(self.listing.filter(F.col("file_path").startswith("/corpus/new/")).select(name))
        if not listed.small:  # to leave documents out would move their texts as well
            return self._view(VIEWS["batch"])
        named = listed.join(self.docs.withColumn("_id", F.col("id")).withColumn("id", name), "left_semi")
        return self._view(first).unionByName(self._view(second, docs=named.withColumn("id", F.col("_id")).drop("_id")))


def _view_order(sql: str) -> list[str]:
    order: list[str] = []

    def visit(text: str) -> None:
        for n in _names(text):
            if n in VIEWS and n not in order:
                visit(VIEWS[n])
                order.append(n)

    visit(sql)
    return order


def oracle(sql: str) -> str:
    """DuckDB text of a check: the views it names as common table expressions."""
    names = {n: n for n in [*VIEWS, *BASE]}
    views = [f"{n} AS ({VIEWS[n].format(**names)})" for n in _view_order(sql)]
    body = sql.format(**names)
    recursive = "RECURSIVE " if "UNION ALL" in body and "WITH RECURSIVE" in body else ""
    if not views:
        return body
    body = body.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return f"WITH {recursive}" + ", ".join(views) + ", " + body[len(start):]
    return "WITH " + ", ".join(views) + " " + body


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a check: a function of `Tables`, and the SQL that must give the same rows."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn

    return add
