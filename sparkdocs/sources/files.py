"""File listings, sidecars and file contents as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdocs import schemas as S
from sparkdocs.functions import paths as P
from sparkdocs.functions.text import decode_utf8


def _files(spark: SparkSession, root: str, recursive: bool, names: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if names:
        reader = reader.option("pathGlobFilter", names)
    return reader.load(root)


def type_glob(types: str | None) -> str | None:
    """File name pattern of comma separated types in either case, for the reader."""
    if not types:
        return None
    letters = lambda t: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() and c.isascii() else c for c in t)
    found = [t.strip() for t in types.split(",")]
    return None if any(re.search(r"[^\w.+-]", t) or not t.isascii() for t in found) else "*.{" + ",".join(map(letters, found)) + "}"


def list_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Listing of a folder by Spark's file index, without reading contents.

    It goes through the driver and skips names that begin with `.` or `_`; see `walk.walk_folder` for a
    listing without either. The file source has no creation time, so the change time stands for it.
    """
    found = _files(spark, root, recursive).select("path", "modificationTime", "length")
    return as_listing(
        found.select(
            P.named_below(F.col("path"), root).alias("file_path"),
            F.col("length").alias("file_size"),
            F.col("modificationTime").alias("file_created_at"),
            F.col("modificationTime").alias("file_modified_time"),
        )
    )


def as_listing(files: DataFrame, base: str = "/", keep: list[str] | None = None) -> DataFrame:
    """Listing columns from rows with file_path, file_size and times: normalized path, name, type; and `keep`."""
    path = P.normalize_path(F.col("file_path"), base)
    return files.withColumn("file_path", path).select(
        P.file_name(F.col("file_path")).alias("file_name"),
        P.extension(F.col("file_path")).alias("file_type"),
        "file_size", "file_created_at", "file_modified_time", "file_path", *(keep or []),
    )


def scan_listing(
    listing: DataFrame,
    root: str,
    recursive: bool = True,
    file_types: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
) -> DataFrame:
    """Files of a listing that a scan of `root` takes."""
    path, root = F.col("file_path"), P.normalize_root(root)
    rel = P.relative(path, root)
    found = listing.filter(P.under(path, root) & ~P.excluded(rel))
    if not recursive:
        found = found.filter(P.at_top(rel))
    return found.filter(
        P.has_type(path, file_types) & P.modified_within(F.col("file_modified_time"), date_from, date_to)
    )


def read_contents(
    spark: SparkSession,
    root: str,
    recursive: bool = True,
    modified_from: str | None = None,
    types: str | None = None,
    most_bytes: int | None = None,
) -> DataFrame:
    """(file_path, content, text) of a folder.

    Only files of the `types`, changed at `modified_from` (UTC) or later, of at most `most_bytes` bytes
    are opened: names are filtered by the reader, time and length by filters it takes over.
    """
    found = _files(spark, root, recursive, type_glob(types))
    if modified_from:
        found = found.filter(F.col("modificationTime") >= F.lit(modified_from).cast("timestamp"))
    if most_bytes is not None:
        found = found.filter(F.col("length") <= most_bytes)
    # Paths of most folders are ASCII; the bytes then stay clear of the Arrow step for NFC.
    return found.select(
        P.normalize_path(P.named_below(F.col("path"), root)).alias("file_path"),
        "content",
        decode_utf8(F.col("content")).alias("text"),
    )


def read_sidecars(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(file_path, text) of all sidecar files of a folder, however old."""
    found = _files(spark, root, recursive, "*" + S.SIDECAR_SUFFIX)
    path = P.normalize_path(P.named_below(F.col("path"), root))
    return found.select(path.alias("file_path"), decode_utf8(F.col("content")).alias("text"))


def sidecar_urls(sidecars: DataFrame) -> DataFrame:
    """(file_path, source_url) from sidecar files (file_path, text); unreadable JSON gives null."""
    url = F.try_variant_get(F.try_parse_json(F.col("text")), "$.source_url", "string")
    return sidecars.filter(F.col("file_path").endswith(S.SIDECAR_SUFFIX)).select(
        F.expr(f"substring(file_path, 1, length(file_path) - {len(S.SIDECAR_SUFFIX)})").alias("file_path"),
        url.alias("source_url"),
    )


def join_sidecars(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Files with the `source_url` of their sidecar, null without one."""
    return files.join(sidecar_urls(sidecars), "file_path", "left")
