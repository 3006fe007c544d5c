"""Folder walks and file reads inside tasks, names that begin with `.` or `_` included.

A walk goes breadth first: the folders of one level are a table, listed by tasks, and those found are the
next level. Neither the listing nor any level of it passes the driver, and shut-out folders are not
entered. Storage is reached by pyarrow's file systems (local disks, HDFS, object stores).
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdocs import schemas as S
from sparkdocs.functions import paths as P
from sparkdocs.functions.text import decode_utf8
from sparkdocs.session import stage
from sparkdocs.sources.files import as_listing

# Entries that a task sends on at a time, and bytes of contents.
_ROWS = 10_000
_BYTES = 32 * 1024 * 1024

_FOUND = "path string, kind string, size long, created timestamp, modified timestamp"
_KINDS = pa.schema([
    ("path", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("created", pa.timestamp("us", "UTC")),
    ("modified", pa.timestamp("us", "UTC")),
])


def storage_uri(spark: SparkSession, root: str) -> str:
    """URI of a folder: a plain path belongs to the session's default file system."""
    if P.store_of(root):
        return root
    plain = P.normalize_root(root)
    if root.lower().startswith("file:"):
        return "file://" + plain
    default = spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return default.rstrip("/") + plain if not default.startswith("file:") else "file://" + plain


def can_walk(uri: str) -> bool:
    """True if pyarrow knows the store; others are left to Spark's own file index."""
    try:
        fs.FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ValueError):
        return False
    return True


def _local_entries(folder: str):
    """(path, kind, size, created, modified) of one folder; links to folders are not followed."""
    with os.scandir(folder) as entries:
        for entry in entries:
            try:
                if entry.is_dir(follow_symlinks=False):
                    yield entry.path, "folder", None, None, None
                elif entry.is_file():
                    found = entry.stat()
                    yield entry.path, "file", found.st_size, int(found.st_ctime * 1e6), int(found.st_mtime * 1e6)
            except OSError:
                continue  # gone since it was listed


def _stored_entries(system: fs.FileSystem, folder: str):
    for entry in system.get_file_info(fs.FileSelector(folder)):
        if entry.type == fs.FileType.Directory:
            yield entry.path, "folder", None, None, None
        elif entry.type == fs.FileType.File:
            changed = entry.mtime_ns // 1000 if entry.mtime_ns is not None else None
            yield entry.path, "file", entry.size, changed, changed


def _list(uri: str, exclude: bool):
    def entered(path: str) -> bool:
        name = path.rstrip("/").rsplit("/", 1)[-1]
        return not exclude or not (name in S.EXCLUDED_DIRS or name.lower().endswith(tuple(S.EXCLUDED_DIR_SUFFIXES)))

    def run(batches):
        system, _ = fs.FileSystem.from_uri(uri)
        local = isinstance(system, fs.LocalFileSystem)
        held: list[tuple] = []

        def out():
            rows = pa.RecordBatch.from_pylist([dict(zip(_KINDS.names, r)) for r in held], _KINDS)
            held.clear()
            return rows

        for batch in batches:
            for folder in batch.column(0).to_pylist():
                try:
                    for entry in _local_entries(folder) if local else _stored_entries(system, folder):
                        if entry[1] == "file" or entered(entry[0]):
                            held.append(entry)
                        if len(held) >= _ROWS:
                            yield out()
                except OSError:
                    held.append((folder, "unreadable", None, None, None))
        if held:
            yield out()

    return run


def walk_folder(spark: SparkSession, root: str, recursive: bool = True, exclude: bool = True) -> DataFrame:
    """Listing of a folder with `raw_path`, the name that storage knows a file by.

    With `exclude` the folders that a scan shuts out are not entered; a check for orphans needs them. A
    folder that cannot be read is passed over, a missing root raises FileNotFoundError. Names that are not
    UTF-8 are passed over too. Links to files count as files, links to folders are not followed on local disks.
    """
    uri = storage_uri(spark, root)
    _, base = fs.FileSystem.from_uri(uri)
    level = spark.createDataFrame([(base.rstrip("/") or "/",)], "path string")
    found = None
    while True:
        entries = stage(level.mapInArrow(_list(uri, exclude), _FOUND))
        if found is None and not entries.filter((F.col("kind") == "unreadable") & (F.col("path") == (base.rstrip("/") or "/"))).isEmpty():
            raise FileNotFoundError(root)
        files = entries.filter(F.col("kind") == "file")
        found = files if found is None else found.unionByName(files)
        folders = entries.filter(F.col("kind") == "folder").select("path")
        if not recursive or folders.isEmpty():
            break
        # One folder a row: they are spread, whatever the level before looked like.
        tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        level = folders.repartition(tasks, "path")
    store = P.store_of(root)
    path = F.col("path") if not store else F.concat(F.lit(store), F.regexp_replace("path", r"^(?!/)", "/"))
    if store and base and not base.startswith("/"):  # object stores name the bucket in the path
        path = F.concat(F.lit(store), F.regexp_replace("path", "^[^/]*", ""))
    rows = found.select(
        path.alias("file_path"), F.col("path").alias("raw_path"), F.col("size").alias("file_size"),
        F.col("created").alias("file_created_at"), F.col("modified").alias("file_modified_time"),
    )
    return as_listing(rows, keep=["raw_path"])


def read_files(files: DataFrame, uri: str, most_bytes: int | None = None) -> DataFrame:
    """(file_path, content, text) of listed files (file_path, file_size, raw_path) in the store of `uri`.

    A file that is gone, unreadable or longer than `most_bytes` gives no row.
    """
    def run(batches):
        system, _ = fs.FileSystem.from_uri(uri)
        names, held, size = [], [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(held, pa.binary())], ["file_path", "content"])

        for batch in batches:
            for name, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    with system.open_input_stream(path) as source:
                        data = source.read()
                except OSError:
                    continue
                names.append(name)
                held.append(data)
                size += len(data)
                if size >= _BYTES or len(names) >= _ROWS:
                    yield out()
                    names, held, size = [], [], 0
        if names:
            yield out()

    wanted = files if most_bytes is None else files.filter(F.col("file_size") <= most_bytes)
    # Spread by name: changed files of one folder often lie together.
    tasks = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = wanted.select("file_path", "raw_path").repartition(tasks, "file_path")
    read = spread.mapInArrow(run, "file_path string, content binary")
    return read.withColumn("text", decode_utf8(F.col("content")))
