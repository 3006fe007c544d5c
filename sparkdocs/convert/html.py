"""HTML to Markdown in bulk, on Arrow batches.

HTML in the wild is not well-formed, so tags are read by the tolerant standard-library parser inside
tasks; Spark spreads the pages and everything before and after stays in expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMPTY = "HTML conversion gave empty content"
FAILED = "HTML to Markdown conversion failed"

_BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt", "fieldset", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "html", "main", "nav", "ol", "p",
    "pre", "section", "table", "ul", "li", "tr",
}
_DROPPED = {"script", "style", "head", "template", "noscript"}
# What may stand in a head; any other tag ends it, as its end tag is optional.
_IN_HEAD = {"title", "meta", "link", "base", "basefont", "bgsound", "style", "script", "noscript", "template"}
_MARKS = {"b": "**", "strong": "**", "em": "*", "i": "*", "code": "`", "del": "~~", "s": "~~"}


class _Markdown(HTMLParser):
    """Collects finished blocks; emphasis and links left open end with their block."""

    def __init__(self, dropped: set[str] = _DROPPED) -> None:
        super().__init__(convert_charrefs=True)
        self.dropped = dropped
        self.inside: list[str] = []  # open elements whose content is left out
        self.blocks: list[str] = []
        self.line: list[str] = []
        self.open: list[tuple[str, int, str]] = []  # tag, where its text starts, link target
        self.lists: list[list] = []  # kind, items so far
        self.quotes = 0
        self.pre = False
        self.lead = ""
        self.row: list[str] | None = None
        self.rows: list[list[str]] = []

    def _text(self) -> str:
        while self.open:
            self._close(self.open[-1][0])
        text = "".join(self.line)
        self.line = []
        if self.pre:
            return text.strip("\n")
        text = re.sub(r"[ \t\r\f\v]*\n[ \t\r\f\v]*", "  \n", re.sub(r"[ \t\r\f\v]+", " ", text))
        return re.sub(r"^(?:\s)+|(?:\s)+$", "", text)

    def _flush(self) -> None:
        text = self._text()
        if text:
            block = f"```\n{text}\n```" if self.pre else self.lead + text
            if self.quotes:
                block = "\n".join("> " * self.quotes + ln for ln in block.split("\n"))
            tight = self.lists and self.blocks and not self.pre
            if tight and self.blocks[-1].lstrip(" ")[:1] in "*+-0123456789" and self.lead.strip():
                self.blocks[-1] += "\n" + block
            else:
                self.blocks.append(block)
            self.lead = "" if not self.lists else " " * len(self.lead)

    def handle_starttag(self, tag, attrs) -> None:
        attrs = dict(attrs)
        if self.inside == ["head"] and tag not in _IN_HEAD:
            self.inside = []
        if tag in self.dropped:
            self.inside.append(tag)
        if self.inside:
            return
        if tag in _BLOCKS and self.row is None:
            self._flush()
        if tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.lead = ""
        elif tag == "li":
            depth = max(len(self.lists), 1)
            mark = "* "
            if self.lists:
                self.lists[-1][1] += 1
                if self.lists[-1][0] == "ol":
                    mark = f"{self.lists[-1][1]}. "
            self.lead = "  " * (depth - 1) + mark
        elif re.fullmatch("h[1-6]", tag):
            self.lead = "#" * int(tag[1]) + " "
        elif tag == "p" and not self.lists:
            self.lead = ""
        elif tag == "blockquote":
            self.quotes += 1
        elif tag == "pre":
            self.pre = True
        elif tag == "br":
            self.line.append("\n")
        elif tag == "hr":
            self._flush()
            self.blocks.append("---")
        elif tag == "img":
            self.line.append(f"![{attrs.get('alt') or ''}]({attrs.get('src') or ''})")
        elif tag == "table":
            self.rows = []
        elif tag == "tr":
            self._end_row()
            self.row = []
        elif tag in ("td", "th") and self.row is not None and self.line:
            self._end_cell()
        elif (tag in _MARKS and not self.pre) or tag == "a":
            self.open.append((tag, len(self.line), attrs.get("href") or ""))

    def _close(self, tag: str) -> None:
        name, start, href = self.open.pop()
        text = "".join(self.line[start:])
        inner = text.strip()
        if inner:
            before, after = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
            made = f"[{inner}]({href})" if name == "a" and href else _MARKS.get(name, "") + inner + _MARKS.get(name, "")
            self.line[start:] = [before + made + after]

    def handle_endtag(self, tag) -> None:
        if tag in self.dropped:
            while tag in self.inside:
                if self.inside.pop() == tag:
                    break
            return
        if self.inside:
            return
        if any(name == tag for name, _, _ in self.open):
            while self.open[-1][0] != tag:
                self._close(self.open[-1][0])
            self._close(tag)
        elif tag in ("td", "th") and self.row is not None:
            self._end_cell()
        elif tag == "tr":
            self._end_row()
        elif tag == "table":
            self._table()
        elif tag in _BLOCKS and self.row is None:
            self._flush()
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
                self.lead = ""
            elif tag == "blockquote":
                self.quotes = max(self.quotes - 1, 0)
            elif tag == "pre":
                self.pre = False
            elif tag == "li" or tag[0] == "h":
                self.lead = ""

    def _end_cell(self) -> None:
        self.row.append(re.sub(r"\s+", " ", self._text()).replace("|", "\\|"))

    def _end_row(self) -> None:
        if self.row is not None:
            if self.line:
                self._end_cell()
            self.rows.append(self.row)
        self.row = None

    def _table(self) -> None:
        self._end_row()
        width = max((len(r) for r in self.rows), default=0)
        if width:
            lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in self.rows]
            lines.insert(1, "| " + " | ".join(["---"] * width) + " |")
            self.blocks.append("\n".join(lines))
        self.rows = []

    def handle_data(self, data) -> None:
        if not self.inside:
            self.line.append(data if self.pre else re.sub(r"[ \t\r\n\f\v]+", " ", data))


def html_to_markdown(html: str, dropped: set[str] = _DROPPED) -> str:
    """Markdown of a page. An element left open to the end of the page is not taken for one that is dropped."""
    parser = _Markdown(dropped)
    parser.feed(html)
    parser.close()
    left_open = set(parser.inside) & {"noscript", "template"}
    if left_open:
        return html_to_markdown(html, dropped - left_open)
    if parser.row is not None or parser.rows:
        parser._table()
    parser._flush()
    return "\n\n".join(parser.blocks)


def _convert_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, errors = [], []
        for html in batch.column(batch.num_columns - 1).to_pylist():
            try:
                text = html_to_markdown(html or "")
                texts.append(text if text.strip() else None)
                errors.append(None if text.strip() else EMPTY)
            except Exception as e:  # a bad page is a failed row, never a failed job
                texts.append(None)
                errors.append(f"{FAILED}: {e}")
        made = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(errors, pa.string())]
        names = [*batch.schema.names[:-1], "markdown_content", "error_message"]
        yield pa.RecordBatch.from_arrays(made, names)


def convert_html(pages: DataFrame, html: str) -> DataFrame:
    """Rows with markdown_content and error_message in place of a column of HTML.

    The other columns ride along in the Arrow batches, so no join is needed to put them back.
    """
    others = [c for c in pages.columns if c != html]
    schema = T.StructType([
        *[pages.schema[c] for c in others],
        T.StructField("markdown_content", T.StringType()),
        T.StructField("error_message", T.StringType()),
    ])
    return pages.select(*others, html).mapInArrow(_convert_batches, schema)


def html_frame(rows: DataFrame) -> DataFrame:
    """Frame converter for files whose `text` is HTML."""
    return convert_html(rows.drop("content"), "text")


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
