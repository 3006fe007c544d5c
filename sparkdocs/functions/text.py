"""Text expressions used by converters and result rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities and the order in which they are replaced.
LABEL_ENTITIES = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&amp;", "&"),
    ("&nbsp;", " "),
    ("&quot;", '"'),
    ("&#39;", "'"),
]

SIZE_UNITS = ["B", "KB", "MB", "GB", "TB"]

# Fixed value: the characters Unicode text splitting takes as white space.
WHITESPACE = r"[\s\x1C-\x1F\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


def decode_utf8(content: Column) -> Column:
    """Bytes as UTF-8 text, undecodable ones dropped (genuine U+FFFD characters survive)."""
    text = content.cast("string")
    repaired = F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit(""))
    return F.when(F.is_valid_utf8(text), text).otherwise(repaired)


def strip_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\x00"), F.lit(""))


def clean_label(html: Column) -> Column:
    """Plain text of a label: entities in order, tags out, white space collapsed."""
    text = html
    for entity, char in LABEL_ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.regexp_replace(text, "<[^>]+>", "")
    return F.trim(F.regexp_replace(text, WHITESPACE, " "))


def human_bytes(size: Column, style: str = "units") -> Column:
    """`x.xx B` up to TB; style `list` shows KB, and MB above 1 MiB."""
    size = size.cast("double")

    def shown_as(power: int) -> Column:
        # bround: ties go to even, as in the stored texts.
        return F.format_string(f"%.2f {SIZE_UNITS[power]}", F.bround(size / 1024.0**power, 2))

    if style == "list":
        return F.when(size > 1024 * 1024, shown_as(2)).when(size.isNotNull(), shown_as(1))
    shown = shown_as(4)
    for power in range(3, -1, -1):
        shown = F.when(size < 1024.0 ** (power + 1), shown_as(power)).otherwise(shown)
    return F.when(size.isNull(), "N/A").otherwise(shown)


def human_duration(seconds: Column) -> Column:
    """`mm:ss.mmm`, with hours when there are any."""
    ms = (seconds.cast("double") * 1000).cast("long")
    parts = [F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, F.pmod(ms, F.lit(1000))]
    hours = F.floor(ms / 3600000)
    return (
        F.when(seconds.isNull(), "N/A")
        .when(hours > 0, F.format_string("%02d:%02d:%02d.%03d", hours, *parts))
        .otherwise(F.format_string("%02d:%02d.%03d", *parts))
    )


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def from_epoch_ms(ms: Column) -> Column:
    return F.timestamp_millis(F.nullif(ms, F.lit(0)))


def front_matter(fields: list[tuple[str, Column]]) -> Column:
    """`key: value` lines; a map value becomes a key line and indented entries."""
    lines = []
    for key, value in fields:
        if isinstance(value, MapField):
            entries = F.transform(
                F.coalesce(F.map_entries(value.column), F.array()),
                lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None"))),
            )
            body = F.array_join(entries, "\n")
            lines.append(
                F.when(body == "", F.lit(f"{key}:")).otherwise(F.concat(F.lit(f"{key}:\n"), body))
            )
        else:
            lines.append(F.concat(F.lit(f"{key}: "), F.coalesce(value.cast("string"), F.lit("None"))))
    return F.concat(F.lit("---\n\n"), F.concat_ws("\n", *lines), F.lit("\n\n---"))


class MapField:
    """Marks a map<string,string> column as a nested front matter block."""

    def __init__(self, column: Column):
        self.column = column
