"""Mind-map files (a zip with JSON or XML) as outline node rows."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdocs.operators.hierarchy import dotted_path, render_outlines
from sparkdocs.session import stage

# Fixed value: text stored with a failed file.
XMIND_FAILED = "XMind conversion failed: "

NODES = (
    "file string, sheet int, node_id string, parent_id string, ordinal int, title string, error_message string"
)


def _json_topics(topic: dict, path: tuple[int, ...]):
    yield path, topic.get("title") or ""
    for i, child in enumerate((topic.get("children") or {}).get("attached") or []):
        yield from _json_topics(child, (*path, i))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _xml_topics(topic, path: tuple[int, ...]):
    titles = [e.text or "" for e in topic if _local(e.tag) == "title"]
    yield path, titles[0] if titles else ""
    attached = (
        child
        for box in topic if _local(box.tag) == "children"
        for group in box if _local(group.tag) == "topics" and group.get("type") == "attached"
        for child in group if _local(child.tag) == "topic"
    )
    for i, child in enumerate(attached):
        yield from _xml_topics(child, (*path, i))


def _sheets(content: bytes):
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = archive.namelist()
        if "content.json" in names:
            for sheet in json.loads(archive.read("content.json")):
                if sheet.get("rootTopic"):
                    yield _json_topics(sheet["rootTopic"], (0,))
        elif "content.xml" in names:
            for sheet in ElementTree.fromstring(archive.read("content.xml")):
                roots = [t for t in sheet if _local(t.tag) == "topic"] if _local(sheet.tag) == "sheet" else []
                if roots:
                    yield _xml_topics(roots[0], (0,))
        else:
            raise ValueError("no content.json or content.xml in the file")


def _node_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [part.split(" ")[0] for part in NODES.split(", ")]
    for batch in batches:
        for path, content in zip(batch["file_path"], batch["content"]):
            try:
                rows = [
                    (path, s, ".".join(map(str, at)), ".".join(map(str, at[:-1])) or None, at[-1], title, None)
                    for s, topics in enumerate(_sheets(bytes(content)))
                    for at, title in topics
                ]
                if not rows:
                    raise ValueError("no sheet with a topic")
            except Exception as e:
                rows = [(path, None, None, None, None, None, XMIND_FAILED + str(e))]
            yield pd.DataFrame(rows, columns=names).astype({"sheet": "Int32", "ordinal": "Int32"})


def outline_nodes(files: DataFrame) -> DataFrame:
    """One row per topic of files (file_path, content); an unreadable file gives one error row."""
    return files.select("file_path", "content").mapInPandas(_node_batches, NODES)


def outline_frame(rows: DataFrame) -> DataFrame:
    """Frame converter for mind-map files."""
    nodes = stage(outline_nodes(rows))  # read once for the topics and once for the errors
    topics = nodes.filter(F.col("error_message").isNull())
    texts = render_outlines(topics.select("file", "sheet", dotted_path(F.col("node_id")).alias("path"), "title"))
    failed = nodes.filter(F.col("error_message").isNotNull()).select(
        F.col("file").alias("file_path"), F.lit(None).cast("string").alias("markdown_content"), "error_message"
    )
    return texts.select(
        F.col("file").alias("file_path"), "markdown_content", F.lit(None).cast("string").alias("error_message")
    ).unionByName(failed)
