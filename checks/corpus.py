"""Filters, sorts, pages, facets and upkeep of the documents table."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from checks.tables import query
from sparkdocs.functions.text import iso_time
from sparkdocs.operators import catalog as C
from sparkdocs.operators import maintain as M
from sparkdocs.operators.search import SearchParams, matches, search, search_info

RUN_TS = datetime(2024, 6, 1, tzinfo=timezone.utc)
_COLS = ["id", "file_name", "file_type", "source"]
_PICK = "SELECT id, file_name, file_type, source FROM {docs} WHERE status = 'completed' AND "


@query("filter_types", _PICK + "lower(file_type) IN ('pdf', 'md')")
def _(t):
    return matches(t.docs, SearchParams(file_types=["pdf", "md"])).select(_COLS)


@query("filter_conversion", _PICK + "conversion_type IN (2, 3)")
def _(t):
    return matches(t.docs, SearchParams(conversion_types=[2, 3])).select(_COLS)


@query(
    "filter_dates",
    _PICK + "file_modified_time >= TIMESTAMP '2024-01-01 02:00:00' AND file_modified_time <= TIMESTAMP '2024-01-01 10:00:00'",
)
def _(t):
    return matches(t.docs, SearchParams(date_from="2024-01-01T02:00:00", date_to="2024-01-01T10:00:00")).select(_COLS)


@query("filter_source", _PICK + "source = 'src2'")
def _(t):
    return matches(t.docs, SearchParams(source="src2")).select(_COLS)


@query("filter_all", _PICK + "source = 'src2' AND lower(file_type) IN ('md') AND conversion_type IN (0, 1)")
def _(t):
    return matches(t.docs, SearchParams(source="src2", file_types=["md"], conversion_types=[0, 1])).select(_COLS)


_PAGE = """
    SELECT id, file_name AS filename, file_path AS filepath, file_type AS filetype, file_size AS filesize,
           strftime(file_modified_time, '%Y-%m-%dT%H:%M:%SZ') AS file_modified_time,
           substr(markdown_content, 1, 200) AS snippet, source, source_url, CAST(NULL AS DOUBLE) AS relevance
    FROM {docs} WHERE status = 'completed'
"""


@query("sort_filename", _PAGE + " ORDER BY file_name ASC NULLS LAST, id LIMIT 50 OFFSET 100")
def _(t):
    return search(t.docs, SearchParams(sort_by="filename", sort_order="asc", page=3, per_page=50))


@query("sort_filename_desc", _PAGE + " ORDER BY file_name DESC NULLS FIRST, id LIMIT 50 OFFSET 0")
def _(t):
    return search(t.docs, SearchParams(sort_by="filename", per_page=50))


@query("sort_mtime", _PAGE + " ORDER BY file_modified_time ASC NULLS LAST, id LIMIT 50 OFFSET 50")
def _(t):
    return search(t.docs, SearchParams(sort_by="mtime", sort_order="asc", page=2, per_page=50))


@query("browse_latest", _PAGE + " ORDER BY file_modified_time DESC NULLS FIRST, id LIMIT 20")
def _(t):
    return search(t.docs, SearchParams())


@query("doc_by_id", "SELECT id, file_name, file_type, source FROM {docs} WHERE id = 42")
def _(t):
    return M.document_by_id(t.docs, 42).select(_COLS)


@query("sources", "SELECT DISTINCT source FROM {docs} WHERE source <> ''")
def _(t):
    return C.sources(t.docs)


@query("file_types", "SELECT DISTINCT file_type FROM {docs} WHERE file_type <> ''")
def _(t):
    return C.file_types(t.docs)


@query(
    "type_catalog",
    """
    SELECT d.id, c.category, c.description, c.type_label
    FROM {docs} d LEFT JOIN (VALUES ('md', 'native', 'Markdown', 'Markdown'), ('txt', 'plain_text', 'Plain Text', '文本'),
        ('py', 'code', 'Python Script', '代码'), ('html', 'html', 'HTML File', 'HTML'),
        ('pdf', 'structured', 'PDF Document', 'Office/PDF')) AS c(ext, category, description, type_label)
    ON lower(d.file_type) = c.ext
    """,
)
def _(t):
    return C.join_catalog(t.docs).select("id", "category", "description", "type_label")


@query(
    "catalog_order",
    """
    SELECT file_type, n, category, row_number() OVER (ORDER BY category_position, ext_position) AS place
    FROM (SELECT lower(file_type) AS file_type, count(*) AS n FROM {docs} GROUP BY 1) d
    JOIN (VALUES ('pdf', 'structured', 1, 1), ('md', 'native', 2, 1), ('html', 'html', 7, 1), ('txt', 'plain_text', 8, 1),
        ('py', 'code', 9, 1)) AS c(ext, category, category_position, ext_position) ON file_type = ext
    """,
)
def _(t):
    # Types in use with their number of documents, in catalog order (31 rows at most).
    used = t.docs.groupBy(F.lower("file_type").alias("file_type")).agg(F.count("*").alias("n"))
    shown = C.ordered_catalog(C.type_catalog(t.spark)).join(used, F.col("ext") == F.col("file_type"))
    place = F.expr("row_number() OVER (ORDER BY category_position, ext_position, listed)")
    return shown.select("file_type", "n", "category", place.cast("long").alias("place"))


@query(
    "orphans",
    "SELECT d.id, d.file_path, d.status FROM {docs} d WHERE starts_with(d.file_path, '/corpus/src') "
    "AND starts_with(d.file_path, '/corpus/') AND NOT EXISTS (SELECT 1 FROM {listing} l WHERE l.file_path = d.file_path)",
)
def _(t):
    return M.orphans(t.docs, t.listing, "/corpus").select("id", "file_path", "status")


@query(
    "orphans_filtered",
    "SELECT d.id, d.file_path, d.status FROM {docs} d WHERE lower(d.file_type) = 'pdf' AND contains(lower(d.file_path), 'src3') "
    "AND NOT EXISTS (SELECT 1 FROM {listing} l WHERE l.file_path = d.file_path)",
)
def _(t):
    return M.orphans(t.docs, t.listing, "/corpus", "pdf", "SRC3").select("id", "file_path", "status")


def _toxic(t):
    return t.labels.filter("toxic = 1").select(F.col("doc_id").alias("id"))


@query(
    "delete_ids",
    "SELECT d.id, d.file_path FROM {docs} d WHERE d.id NOT IN (SELECT doc_id FROM {labels} WHERE toxic = 1)",
)
def _(t):
    return M.delete_documents(t.docs, _toxic(t))[0].select("id", "file_path")


@query(
    "delete_count",
    "SELECT count(*) AS deleted FROM {docs} d WHERE d.id IN (SELECT doc_id FROM {labels} WHERE toxic = 1)",
)
def _(t):
    return M.delete_documents(t.docs, _toxic(t))[1]


@query(
    "failed_docs",
    "SELECT id, file_name, error_message, strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ') AS updated FROM {docs} "
    "WHERE status = 'failed' AND contains(lower(file_name), 'doc_') AND updated_at >= TIMESTAMP '2024-01-02 01:00:00'",
)
def _(t):
    found = M.failed_documents(t.docs, name="DOC_", date_from="2024-01-02T01:00:00")
    return found.select("id", "file_name", "error_message", iso_time(F.col("updated_at")).alias("updated"))


@query(
    "retry_outcomes",
    "SELECT i.id, CASE WHEN d.id IS NULL THEN 'not_found' WHEN d.status = 'failed' THEN 'retry' ELSE 'not_failed' END AS outcome "
    "FROM (SELECT DISTINCT doc_id * 3 AS id FROM {labels}) i LEFT JOIN {docs} d ON d.id = i.id",
)
def _(t):
    ids = t.labels.select((F.col("doc_id") * 3).alias("id"))
    return M.retry_outcomes(t.docs, ids).select("id", "outcome")


@query("reprocess_html", "SELECT id, file_type, conversion_type FROM {docs} WHERE file_type IN ('html', 'htm')")
def _(t):
    return M.html_to_reprocess(t.docs).select("id", "file_type", "conversion_type")


_OLD = "(SELECT id, file_type, CASE WHEN source = 'src1' AND file_type = 'html' THEN 3 ELSE conversion_type END AS conversion_type FROM {docs}) o"


def _before_migration(t):
    code = F.when((F.col("source") == "src1") & (F.col("file_type") == "html"), 3).otherwise(F.col("conversion_type"))
    return t.docs.withColumn("conversion_type", code)


@query(
    "reprocess_html_missing",
    f"SELECT id, file_type, conversion_type FROM {_OLD} WHERE file_type IN ('html', 'htm') AND conversion_type <> 8",
)
def _(t):
    return M.html_to_reprocess(_before_migration(t), only_missing=True).select("id", "file_type", "conversion_type")


@query(
    "migrate_html",
    f"SELECT id, CASE WHEN file_type IN ('html', 'htm') AND conversion_type = 3 THEN 8 ELSE conversion_type END AS conversion_type FROM {_OLD}",
)
def _(t):
    return M.migrate_html(_before_migration(t)).select("id", "conversion_type")


@query(
    "migrate_counts",
    "SELECT count(*) FILTER (WHERE file_type IN ('html', 'htm') AND conversion_type = 3) AS to_update, "
    f"count(*) FILTER (WHERE file_type IN ('html', 'htm') AND conversion_type IN (3, 8)) AS updated_html_docs FROM {_OLD}",
)
def _(t):
    return M.migration_counts(_before_migration(t))


@query(
    "page_info_browse",
    "SELECT 2 AS page, 20 AS per_page, ceil(count(*) / 20.0)::BIGINT AS total_pages, 2 < ceil(count(*) / 20.0) AS has_next, "
    "true AS has_prev, count(*) AS total_results FROM {docs} WHERE status = 'completed'",
)
def _(t):
    return search_info(t.docs, SearchParams(page=2))
