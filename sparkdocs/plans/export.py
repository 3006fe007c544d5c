"""Conversion of a tree into Markdown files, without the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdocs import schemas as S
from sparkdocs.convert.default import default_registry
from sparkdocs.convert.registry import ConverterRegistry
from sparkdocs.functions import paths as P
from sparkdocs.session import stage


def select_for_export(
    listing: DataFrame, root: str, extensions: list[str] | None = None, recursive: bool = True
) -> DataFrame:
    """Files of the wanted types below `root`; folder exclusions of a scan do not apply."""
    wanted = [e.strip().lower().lstrip(".") for e in (extensions or S.EXTENSIONS)]
    found = listing.filter(P.under(F.col("file_path"), root) & F.lower(P.extension(F.col("file_path"))).isin(wanted))
    return found if recursive else found.filter(P.at_top(P.relative(F.col("file_path"), root)))


def export_paths(files: DataFrame, root: str) -> DataFrame:
    """(out_path, file_path, candidates): relative target of each file; of several sources with one
    target the last by path wins. An aggregate, so copies never meet in a window."""
    rel = P.relative(F.col("file_path"), root)
    targets = files.select("file_path", F.concat(P.stem(rel), F.lit(".md")).alias("out_path"))
    return targets.groupBy("out_path").agg(
        F.max("file_path").alias("file_path"), F.count("*").alias("candidates")
    )


def export_markdown(
    files: DataFrame, contents: DataFrame, root: str, out: str, registry: ConverterRegistry | None = None
) -> DataFrame:
    """Write one .md per converted file under `out` (a path or URI that every executor reaches) and
    return (total, success, failed).

    Each file is written under a temporary name and then moved, so a repeated task does no harm.
    """
    rows = files.select("file_path", "file_name", "file_type").join(contents, "file_path", "left")
    # Written once: the targets, their contents and the counts all read it.
    converted = stage((registry or default_registry()).convert(rows))
    good = converted.filter("success")
    chosen = export_paths(good, root).join(good.select("file_path", "markdown_content"), "file_path")

    def write(rows) -> None:
        import uuid

        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(out)
        made = set()
        for row in rows:
            target = f"{base.rstrip('/')}/{row.out_path}"
            folder = target.rsplit("/", 1)[0]
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            part = f"{folder}/.{uuid.uuid4().hex}.part"
            with system.open_output_stream(part) as sink:
                sink.write((row.markdown_content or "").encode("utf-8"))
            system.move(part, target)

    chosen.select("out_path", "markdown_content").foreachPartition(write)
    return converted.agg(
        F.count("*").alias("total"), F.count_if("success").alias("success"), F.count_if(~F.col("success")).alias("failed")
    )
