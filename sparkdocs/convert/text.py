"""Markdown, plain text, code and switched-off images as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def native_markdown() -> Column:
    return F.col("text")


def plain_text() -> Column:
    return F.concat(F.lit("# "), "file_name", F.lit("\n\n"), "text")


def code_block() -> Column:
    return F.concat(
        F.lit("# "), "file_name", F.lit("\n\n```"), F.lower("file_type"), F.lit("\n"), "text", F.lit("\n```")
    )


def image_title() -> Column:
    """Images without text extraction keep their name only."""
    return F.concat(F.lit("# "), "file_name", F.lit("\n"))
