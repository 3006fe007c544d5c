"""Highlights and snippets of a result row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SNIPPET_LENGTH = 200


def split_keyword(keyword: str | None) -> list[str]:
    return [k for k in re.split(r"[\s+]+", keyword or "") if k]


def _literal(word: str) -> str:
    return r"\Q" + word.replace(r"\E", r"\E\\E\Q") + r"\E"


def highlight(text: Column, keyword: str | None) -> Column:
    """Wrap every match of a keyword in <mark>, all keywords in one pass, longest first."""
    words = sorted(split_keyword(keyword), key=len, reverse=True)
    if not words:
        return text
    pattern = "(?iu)(" + "|".join(_literal(w) for w in words) + ")"
    return F.regexp_replace(text, pattern, "<mark>$1</mark>")


def snippet(text: Column, keyword: str | None, length: int = SNIPPET_LENGTH) -> Column:
    """Window around the first match of the first keyword that matches, with highlights."""
    text = F.coalesce(text, F.lit(""))
    words = split_keyword(keyword)
    head = F.substring(text, 1, length)
    if not words:
        return head
    size = F.length(text)
    low = F.lower(text)
    # Plain `when`: nullif would add a projection that keeps Spark from planning the page as a top-k.
    places = [F.locate(w.lower(), low) for w in words]
    found = F.coalesce(*[F.when(place > 0, place) for place in places])
    at = found - 1
    half = length // 2
    start0 = F.greatest(F.lit(0), at - half)
    end0 = F.least(size, at + len(words[0]) + half)
    end = F.when(start0 == 0, F.least(size, F.lit(length))).otherwise(end0)
    start = F.when(end == size, F.greatest(F.lit(0), size - length)).otherwise(start0)
    dots = F.lit("...")
    empty = F.lit("")
    cut = F.concat(
        F.when(start > 0, dots).otherwise(empty),
        F.substring(text, start + 1, end - start),
        F.when(end < size, dots).otherwise(empty),
    )
    unmatched = F.concat(head, F.when(size > length, dots).otherwise(empty))
    return F.when(found.isNull(), unmatched).otherwise(highlight(cut, keyword))
