"""Path expressions: normalization, parts, source labels, scan predicates."""

from __future__ import annotations

import re
import unicodedata
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from sparkdocs import schemas as S


@pandas_udf(StringType())
def _nfc(paths: pd.Series) -> pd.Series:
    return paths.map(lambda p: None if p is None else unicodedata.normalize("NFC", p))


def _resolve_dots(path: Column) -> Column:
    """Drop empty and '.' segments and apply '..', as an absolute path does."""
    parts = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda kept, part: F.when(part.isin("", "."), kept)
        .when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
        .otherwise(F.array_append(kept, part)),
    )
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


# Scheme and authority of a URI; one letter and a colon is a drive, not a scheme.
_STORE = r"^([A-Za-z][A-Za-z0-9+.\-]+:(?://[^/\\]*)?)(?=[/\\])"


def store_of(path: str) -> str:
    """Scheme and authority as the user wrote them; none for a plain path and for a local file URI."""
    found = re.match(_STORE, path)
    return "" if not found or found.group(1).lower() in ("file:", "file://") else found.group(1)


def normalize_root(root: str) -> str:
    """A folder as its files are named: store, then its path without empty, `.` and `..` segments."""
    kept: list[str] = []
    plain = unicodedata.normalize("NFC", re.sub(_STORE, "", root))
    for part in plain.replace("\\", "/").split("/"):
        if part == "..":
            kept = kept[:-1]
        elif part not in ("", "."):
            kept.append(part)
    return store_of(root) + "/" + "/".join(kept)


def named_below(path: Column, root: str) -> Column:
    """A path that storage lists below `root`, with the store as `root` names it."""
    return F.concat(F.lit(store_of(root)), F.regexp_replace(path, _STORE, ""))


def normalize_path(path: Column, base: str = "/") -> Column:
    """Absolute path in Unicode NFC with '/' separators; scheme and authority of a URI stay as they are.

    A local file URI becomes its path. NFC has no built-in expression; ASCII rows reach the Arrow
    function as nulls.
    """
    store = F.regexp_replace(F.regexp_extract(path, _STORE, 1), r"(?i)^file:(?://)?$", "")
    return F.concat(store, _normal(F.regexp_replace(path, _STORE, ""), base))


def _normal(path: Column, base: str) -> Column:
    absolute = F.when(path.startswith("/"), path).otherwise(
        F.concat(F.lit(base.rstrip("/") + "/"), path)
    )
    untidy = absolute.rlike(r"//|/\.{1,2}(?:/|$)|./$")
    resolved = F.when(untidy, _resolve_dots(absolute)).otherwise(absolute)
    composed = F.coalesce(_nfc(F.when(resolved.rlike(r"[^\x00-\x7F]"), resolved)), resolved)
    return F.replace(composed, F.lit("\\"), F.lit("/"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Extension without dot; leading dots of a name do not start one."""
    return F.regexp_extract(file_name(path), r"(?s)^\.*[^.].*\.([^.]*)$", 1)


def stem(path: Column) -> Column:
    """Path without its extension."""
    ext = extension(path)
    plain = F.substring(path, F.lit(1), F.length(path) - F.length(ext) - 1)
    has_dot = file_name(path).rlike(r"(?s)^\.*[^.].*\.[^.]*$")
    return F.when(has_dot, plain).otherwise(path)


def relative(path: Column, root: str) -> Column:
    return path.substr(F.lit(len(root.rstrip("/")) + 2), F.length(path))


def path_key(path: Column) -> Column:
    """Natural key of a document: its path, case folded."""
    return F.lower(path)


def document_id(path: Column) -> Column:
    return F.xxhash64(path_key(path))


def under(path: Column, root: str) -> Column:
    """True for paths inside folder `root`, not for siblings sharing its prefix."""
    return path.startswith(root.rstrip("/") + "/")


def derive_source(path: Column, download_root: str | None) -> Column:
    """`local_fs`, or the labelled first folder below the download root."""
    default = F.lit(S.SOURCE_FILES)
    if not download_root:
        return default
    first = F.split(relative(path, download_root), "/")
    inside = under(path, download_root) & (F.size(first) > 1)
    return F.when(inside, F.concat(F.lit(S.DOWNLOAD_SOURCE_PREFIX), first[0])).otherwise(default)


def excluded(
    rel: Column,
    dirs: list[str] = S.EXCLUDED_DIRS,
    dir_suffixes: list[str] = S.EXCLUDED_DIR_SUFFIXES,
    extensions: list[str] = S.EXCLUDED_EXTENSIONS,
) -> Column:
    """Files in a shut-out folder, or with a shut-out extension; the path is relative to the root."""
    tests = []
    if dirs:
        tests.append(rel.rlike("(?:^|/)(?:" + "|".join(re.escape(d) for d in dirs) + ")/"))
    if dir_suffixes:
        tests.append(
            F.lower(rel).rlike("(?:" + "|".join(re.escape(s.lower()) for s in dir_suffixes) + ")/")
        )
    tests.extend(F.lower(rel).endswith("." + e.lower()) for e in extensions)
    found = F.lit(False)
    for test in tests:
        found = found | test
    return found


def has_type(path: Column, types: str | None) -> Column:
    """Name ends with one of the comma separated types; multi-dot types work."""
    if not types:
        return F.lit(True)
    found = F.lit(False)
    for wanted in types.split(","):
        found = found | F.lower(path).endswith("." + wanted.strip().lower())
    return found


def at_top(rel: Column) -> Column:
    return ~rel.contains("/")


def _utc(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def modified_within(mtime: Column, date_from: str | None, date_to: str | None) -> Column:
    """From an instant to the end of a day, both inclusive, read as UTC. Bad dates raise here."""
    found = F.lit(True)
    if date_from:
        found = found & (mtime >= F.lit(_utc(date_from)))
    if date_to:
        end = _utc(date_to + "T00:00:00") + timedelta(days=1)
        found = found & (mtime < F.lit(end))
    return found
