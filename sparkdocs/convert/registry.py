"""Converter registry and dispatch by file type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdocs.functions.text import decode_utf8, strip_nul

# Builds the Markdown from the row's columns; null means failure.
ColumnConverter = Callable[[], Column]
# Takes the rows of its types, returns (file_path, markdown_content, error_message), with the other
# columns of the rows if it can keep them.
FrameConverter = Callable[[DataFrame], DataFrame]


# Fixed value: text stored with a file of a type that no converter takes.
UNSUPPORTED = "Unsupported file type: "


class ConverterRegistry:
    """Converters by extension, looked up without regard to case.

    Input rows carry file_path, file_name, file_type, and text (`text`), bytes (`content`) or both.
    Column converters share one `when` chain in a single pass; a frame converter gets the rows of its
    types.
    """

    def __init__(self) -> None:
        self._columns: dict[str, tuple[ColumnConverter, int, str]] = {}
        self._frames: dict[str, tuple[str, FrameConverter, int]] = {}

    def register(
        self,
        extensions: list[str],
        conversion_type: int,
        column: ColumnConverter | None = None,
        frame: FrameConverter | None = None,
        empty_error: str = "conversion gave no content",
    ) -> None:
        for ext in (e.lower() for e in extensions):
            self._columns.pop(ext, None)
            self._frames.pop(ext, None)
            if column is not None:
                self._columns[ext] = (column, conversion_type, empty_error)
            elif frame is not None:
                self._frames[ext] = (",".join(extensions), frame, conversion_type)

    def registered(self) -> list[str]:
        return sorted([*self._columns, *self._frames])

    def converter_of(self, file_type: Column) -> Column:
        """Name of the branch that converts a type: a frame converter's types, or `columns`."""
        name = F.lit("columns")
        for ext, (group, _, _) in self._frames.items():
            name = F.when(F.lower(file_type) == ext, group).otherwise(name)
        return name  # a missing type falls through to `columns`

    def _by_columns(self, rows: DataFrame) -> DataFrame:
        kind = F.lower("file_type")
        text, code, error = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("string")
        groups: dict[tuple, list[str]] = {}
        for ext, entry in self._columns.items():
            groups.setdefault(entry, []).append(ext)
        for (column, conversion_type, empty_error), exts in groups.items():
            mine = kind.isin(exts)
            text = F.when(mine, column()).otherwise(text)
            code = F.when(mine, conversion_type).otherwise(code)
            error = F.when(mine, empty_error).otherwise(error)
        known = kind.isin(list(self._columns)) if self._columns else F.lit(False)
        unknown = F.concat(F.lit(UNSUPPORTED), F.coalesce("file_type", F.lit("None")))
        out = rows.withColumn("_text", strip_nul(text))
        done = F.col("_text").isNotNull()
        return out.select(
            *[c for c in rows.columns if c not in ("text", "content")],
            done.alias("success"),
            F.col("_text").alias("markdown_content"),
            F.when(done, code).alias("conversion_type"),
            F.when(~done, F.when(F.coalesce(known, F.lit(False)), error).otherwise(unknown)).alias("error_message"),
        )

    def convert(self, rows: DataFrame) -> DataFrame:
        """Rows with success, markdown_content, conversion_type and error_message; none is lost.

        Rows staged with a partition column `converter` (see `converter_of`) are read once, branch by
        branch; otherwise every branch filters the rows by type.
        """
        if "content" not in rows.columns:
            rows = rows.withColumn("content", F.encode("text", "UTF-8"))
        if "text" not in rows.columns:
            rows = rows.withColumn("text", decode_utf8(F.col("content")))
        if "converter" not in rows.columns:
            rows = rows.withColumn("converter", self.converter_of(F.col("file_type")))
        out = self._by_columns(rows.filter(F.col("converter") == "columns").drop("converter"))
        branches = {group: (frame, code) for group, frame, code in self._frames.values()}
        for group, (frame, conversion_type) in branches.items():
            mine = rows.filter(F.col("converter") == group).drop("converter")
            kept = [c for c in mine.columns if c not in ("text", "content")]
            made = frame(mine)
            if not set(kept) <= set(made.columns):
                made = made.select("file_path", "markdown_content", "error_message")
                made = mine.select(*kept).join(made, "file_path", "left")
            done = F.col("markdown_content").isNotNull()
            out = out.unionByName(
                made.select(
                    *kept,
                    done.alias("success"),
                    strip_nul(F.col("markdown_content")).alias("markdown_content"),
                    F.when(done, conversion_type).alias("conversion_type"),
                    F.when(~done, F.coalesce("error_message", F.lit("conversion gave no content"))).alias("error_message"),
                )
            )
        return out
