"""Diagram files (XML) as label rows, and their Markdown."""

from __future__ import annotations

import base64
import io
import zlib
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdocs.functions.text import clean_label

# Texts stored in converted documents.
UNNAMED_PAGE = "未命名图表"
NO_TEXT = "*此页面没有找到文本内容*"
NO_DIAGRAM = "未找到 diagram 元素"
COUNTS = "总共 %d 个页面，%d 个文本项目"
XML_FAILED = "Draw.io XML 解析失败: "

LABELS = "file string, page int, page_name string, item int, value string, error_message string"


def _unpacked(packed: bytes, window: int | None) -> str | None:
    """Text of packed bytes, inflated with a window size if one is given; null if they are not that."""
    try:
        return (packed if window is None else zlib.decompress(packed, wbits=window)).decode("utf-8")
    except (zlib.error, UnicodeDecodeError):
        return None


def decode_payload(text: str) -> str:
    """Diagram XML of an encoded page: base64 of deflated, of zlib or of plain text, else the text itself.

    The first reading that is UTF-8 counts; all are percent-encoded.
    """
    try:
        packed = base64.b64decode(text)
    except ValueError:
        return unquote(text)
    readings = (_unpacked(packed, window) for window in (-15, 15, None))
    return unquote(next((r for r in readings if r is not None), text))


class _Pages:
    """Pages of a diagram file, gathered in one pass over its XML events.

    Cells are the children of the first `root` in the first `mxGraphModel` of a page. The two cells that
    every model begins with have no label of their own.
    """

    def __init__(self, whole_model: bool = False):
        self.found: list[tuple[str, list[str]]] = [("", [])] if whole_model else []
        self.path: list[str] = []
        self.model = self.cells = 0  # depth of the open model and cell list, -1 once closed

    def start(self, tag: str, attrs) -> None:
        self.path.append(tag)
        depth = len(self.path)
        if tag == "diagram" and depth == 2 and not (self.found and self.found[0][0] == ""):
            self.found.append((attrs.get("name", UNNAMED_PAGE), []))
            self.model = self.cells = 0
        elif tag == "mxGraphModel" and self.model == 0 and self.found:
            self.model = depth
        elif tag == "root" and self.cells == 0 and depth == self.model + 1:
            self.cells = depth
        elif depth == self.cells + 1 and self.cells > 0:
            label = attrs.get("value")
            if attrs.get("id") not in ("0", "1") and label and label.strip():
                self.found[-1][1].append(label)

    def end(self) -> None:
        if len(self.path) == self.cells:
            self.cells = -1
        if len(self.path) == self.model:
            self.model = -1
        self.path.pop()


def read_pages(content: bytes, whole_model: bool = False) -> list[tuple[str, list[str]]]:
    """(name, labels) of the pages of a diagram file, or of the one page that a model's XML is."""
    pages = _Pages(whole_model)
    for event, element in ElementTree.iterparse(io.BytesIO(content), ("start", "end")):
        if event == "start":
            pages.start(element.tag, element.attrib)
            continue
        page_ends = pages.path[1:] == ["diagram"]
        packed = (element.text or "").strip() if page_ends and pages.model == 0 else ""
        pages.end()
        if packed and not whole_model:
            try:
                pages.found[-1][1].extend(read_pages(decode_payload(element.text).encode(), True)[0][1])
            except ElementTree.ParseError:
                pass  # a page whose payload cannot be read has no labels
        element.clear()
    return pages.found


def _label_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [part.split(" ")[0] for part in LABELS.split(", ")]
    for batch in batches:
        for path, content in zip(batch["file_path"], batch["content"]):
            rows = []
            try:
                for p, (name, labels) in enumerate(read_pages(bytes(content))):
                    rows.append((path, p, name, None, None, None))  # a page may have no label
                    rows.extend((path, p, name, i, v, None) for i, v in enumerate(labels))
                if not rows:
                    base = path.rsplit("/", 1)[-1]
                    rows = [(path, None, None, None, None, f"# {base}\n\n{NO_DIAGRAM}\n")]
            except Exception as e:
                rows = [(path, None, None, None, None, f"{XML_FAILED}{e}")]
            yield pd.DataFrame(rows, columns=names).astype({"page": "Int32", "item": "Int32"})


def diagram_labels(files: DataFrame) -> DataFrame:
    """Raw label values of diagram files (file_path, content).

    Each page also has one row without item, so pages without labels stay; a bad file has one error row.
    """
    return files.select("file_path", "content").mapInPandas(_label_batches, LABELS)


def diagram_markdown(labels: DataFrame) -> DataFrame:
    """(file, pages, items, markdown_content) of label rows (file, page, page_name, item, value)."""
    return _rendered(labels).drop("error_message")


def _rendered(labels: DataFrame) -> DataFrame:
    """Markdown of every file, or its error, from one pass over the labels."""
    if "error_message" not in labels.columns:
        labels = labels.withColumn("error_message", F.lit(None).cast("string"))
    cleaned = labels.withColumn("label", F.nullif(clean_label(F.col("value")), F.lit("")))
    entry = F.when(F.col("label").isNotNull(), F.struct("item", "label"))
    pages = cleaned.groupBy("file", "page", "page_name").agg(
        F.array_sort(F.collect_list(entry)).alias("entries"), F.count("label").alias("n"), F.max("error_message").alias("error_message"),
    )
    listed = F.array_join(F.transform("entries", lambda e: F.concat(F.lit("- "), e["label"])), "\n\n")
    block = F.concat(F.lit("## "), "page_name", F.lit("\n\n"), F.when(F.col("n") > 0, listed).otherwise(NO_TEXT))
    ordered = F.array_sort(F.collect_list(F.struct("page", block.alias("block"))))
    files = pages.groupBy("file").agg(
        F.count("*").alias("pages"), F.sum("n").alias("items"), ordered.alias("blocks"), F.max("error_message").alias("error_message"),
    )
    name = F.regexp_extract("file", r"([^/]*)$", 1)
    text = F.concat(
        F.lit("# "), name, F.lit("\n\n"), F.format_string(COUNTS, "pages", "items"), F.lit("\n\n---\n\n"),
        F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n\n\n"),
    )
    tidy = F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit("\n"))
    return files.select(
        "file", "pages", "items", F.when(F.col("error_message").isNull(), tidy).alias("markdown_content"), "error_message"
    )


def diagram_frame(rows: DataFrame) -> DataFrame:
    """Frame converter for diagram files."""
    return _rendered(diagram_labels(rows)).select(F.col("file").alias("file_path"), "markdown_content", "error_message")
