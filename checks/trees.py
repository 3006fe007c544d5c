"""Folder chains and outlines."""

from pyspark.sql import functions as F

from checks.tables import query
from sparkdocs.operators.hierarchy import folder_paths, outline_markdown


@query(
    "folder_paths",
    """
    WITH RECURSIVE walk AS (
        SELECT id, title AS folder_path FROM {folders} WHERE parent_id = ''
        UNION ALL
        SELECT f.id, w.folder_path || '/' || f.title FROM {folders} f JOIN walk w ON f.parent_id = w.id
    )
    SELECT id, folder_path FROM walk
    """,
)
def _(t):
    return folder_paths(t.folders)


@query(
    "outline_markdown",
    """
    WITH RECURSIVE walk AS (
        SELECT file, node_id, title, 0 AS depth, lpad(CAST(ordinal AS VARCHAR), 4, '0') AS place
        FROM {outline} WHERE parent_id IS NULL
        UNION ALL
        SELECT o.file, o.node_id, o.title, w.depth + 1, w.place || '.' || lpad(CAST(o.ordinal AS VARCHAR), 4, '0')
        FROM {outline} o JOIN walk w ON o.file = w.file AND o.parent_id = w.node_id
    )
    SELECT file, string_agg(CASE WHEN depth = 0 THEN '# ' || title || chr(10) ELSE repeat('  ', depth - 1) || '- ' || title END,
                            chr(10) ORDER BY place) AS markdown_content
    FROM walk GROUP BY file
    """,
)
def _(t):
    return outline_markdown(t.outline)
