"""Scans, paths, sidecars, export targets."""

from pyspark.sql import functions as F

from checks.tables import query
from sparkdocs.functions import paths as P
from sparkdocs.functions.text import iso_time
from sparkdocs.plans.export import export_paths, select_for_export
from sparkdocs.sources.files import as_listing, join_sidecars, scan_listing

_ISO = "strftime(file_modified_time, '%Y-%m-%dT%H:%M:%SZ') AS mtime"


def _listed(df):
    return df.select("file_path", "file_name", "file_size", iso_time(F.col("file_modified_time")).alias("mtime"))


_LISTED = f"SELECT file_path, file_name, file_size, {_ISO} FROM {{listing}} "
_KEPT = (
    "NOT regexp_matches(file_path, '^/corpus/(.*/)?(\\.git|\\.vscode|__pycache__|node_modules|\\.assets|dist|build|venv)/') "
    "AND NOT regexp_matches(lower(file_path), '\\.assets/') "
    "AND NOT regexp_matches(lower(file_name), '\\.(log|tmp|bak|swo|swp|pyc)$')"
)


@query("scan_listing", f"{_LISTED} WHERE starts_with(file_path, '/corpus/') AND {_KEPT}")
def _(t):
    return _listed(scan_listing(t.listing, "/corpus"))


@query(
    "scan_depth1",
    f"{_LISTED} WHERE starts_with(file_path, '/corpus/') AND len(string_split(file_path, '/')) = 3 AND {_KEPT}",
)
def _(t):
    return _listed(scan_listing(t.listing, "/corpus", recursive=False))


@query("scan_excluded", f"{_LISTED} WHERE starts_with(file_path, '/corpus/') AND NOT ({_KEPT})")
def _(t):
    return _listed(t.listing.filter(P.under(F.col("file_path"), "/corpus") & P.excluded(P.relative(F.col("file_path"), "/corpus"))))


@query(
    "scan_types",
    f"{_LISTED} WHERE starts_with(file_path, '/corpus/') AND {_KEPT} "
    "AND (lower(file_name) LIKE '%.pdf' OR lower(file_name) LIKE '%.md')",
)
def _(t):
    return _listed(scan_listing(t.listing, "/corpus", file_types="PDF, md"))


@query(
    "scan_mtime",
    f"{_LISTED} WHERE starts_with(file_path, '/corpus/') AND {_KEPT} "
    "AND file_modified_time >= TIMESTAMP '2024-01-01 03:00:00' AND file_modified_time < TIMESTAMP '2024-01-02 00:00:00'",
)
def _(t):
    return _listed(scan_listing(t.listing, "/corpus", date_from="2024-01-01T03:00:00", date_to="2024-01-01"))


@query(
    "normalize_paths",
    """
    SELECT id, nfc_normalize(replace('/corpus/' || source || '/' || markdown_content || '\\' || file_name, '\\', '/')) AS path
    FROM (SELECT id, source, file_name,
                 regexp_replace(markdown_content, '[^\\p{{L}}]+', '_', 'g') AS markdown_content FROM {docs}) d
    """,
)
def _(t):
    # Decomposed accents, dots, doubled and backward slashes that have to come out in normal form.
    words = F.regexp_replace("markdown_content", r"[^\p{L}]+", "_")
    raw = F.concat(
        F.lit("corpus//./"), "source", F.lit("/x/../"), words, F.lit("\\"), "file_name"
    )
    return t.docs.select("id", P.normalize_path(raw, base="/").alias("path"))


@query(
    "path_parts",
    """
    SELECT p AS file_path, string_split(p, '/')[-1] AS file_name,
           CASE WHEN regexp_matches(string_split(p, '/')[-1], '^\\.*[^.].*\\.')
                THEN string_split(string_split(p, '/')[-1], '.')[-1] ELSE '' END AS file_type
    FROM (
        SELECT unnest([file_path, file_path || '.gz', '/corpus/.' || source, '/corpus/..' || source || '.x', '/c.d/' || source,
                       '/corpus/' || source || '.']) AS p
        FROM (SELECT file_path, string_split(file_path, '/')[3] AS source FROM {listing}) l
    ) x
    """,
)
def _(t):
    path = F.col("file_path")
    forms = F.array(
        path, F.concat(path, F.lit(".gz")), F.concat(F.lit("/corpus/."), "source"),
        F.concat(F.lit("/corpus/.."), "source", F.lit(".x")), F.concat(F.lit("/c.d/"), "source"),
        F.concat(F.lit("/corpus/"), "source", F.lit(".")),
    )
    made = t.listing.withColumn("source", F.split("file_path", "/")[2]).select(F.explode(forms).alias("file_path"))
    return made.select("file_path", P.file_name(path).alias("file_name"), P.extension(path).alias("file_type"))


@query(
    "derive_source",
    """
    SELECT file_path,
           CASE WHEN starts_with(file_path, '/corpus/new/') AND len(string_split(file_path, '/')) > 4
                THEN '公众号_' || string_split(file_path, '/')[4] ELSE 'local_fs' END AS source
    FROM {listing}
    """,
)
def _(t):
    return t.listing.select("file_path", P.derive_source(F.col("file_path"), "/corpus/new").alias("source"))


@query(
    "sidecar_join",
    """
    SELECT l.file_path,
           CASE WHEN s.text LIKE '%broken' THEN NULL ELSE regexp_extract(s.text, '"source_url": "([^"]*)"', 1) END AS source_url
    FROM {listing} l LEFT JOIN {sidecars} s ON s.file_path = l.file_path || '.meta.json'
    """,
)
def _(t):
    return join_sidecars(t.listing, t.sidecars).select("file_path", "source_url")


@query(
    "export_paths",
    """
    SELECT out_path, max(file_path) AS file_path, count(*) AS candidates FROM (
        SELECT file_path, regexp_replace(substr(file_path, 9), '\\.[^./]*$', '') || '.md' AS out_path
        FROM (SELECT * FROM {listing} UNION ALL
              SELECT file_name, 'docx' AS file_type, file_size, file_created_at, file_modified_time,
                     regexp_replace(file_path, '\\.[^./]*$', '.docx') AS file_path
              FROM {listing} WHERE lower(file_type) = 'pdf') f
        WHERE lower(string_split(file_path, '.')[-1]) IN ('md','txt','py','html','pdf','docx')
    ) o GROUP BY out_path
    """,
)
def _(t):
    # The same file as PDF and Word document gives one target.
    twins = as_listing(
        t.listing.filter(F.lower("file_type") == "pdf").withColumn(
            "file_path", F.regexp_replace("file_path", r"\.[^./]*$", ".docx")
        )
    )
    files = t.listing.select(*twins.columns).unionByName(twins)
    return export_paths(select_for_export(files, "/corpus"), "/corpus")
