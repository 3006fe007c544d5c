"""Folder walks and file reads in tasks."""

import os

import pytest
from pyspark.sql import functions as F

from sparkdocs import schemas as S
from sparkdocs.operators.maintain import orphans
from sparkdocs.sources.walk import can_walk, read_files, storage_uri, walk_folder


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    names = ["a.md", ".dot.md", "_under.txt", ".hid/b.md", "x/y/z/deep.py", "x/.git/no.md", "p.ASSETS/no.md", "é ü/c d.md", "e%20.md", "build/no.md"]
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("text of " + name)
    (root / "empty").mkdir()
    os.symlink(root, root / "x" / "loop")
    os.symlink(root / "a.md", root / "link.md")
    return root


def names_of(df, root):
    return {r.file_path.removeprefix(f"{root}/") for r in df.collect()}


def test_walk_finds_every_name(spark, tree):
    kept = {"a.md", ".dot.md", "_under.txt", ".hid/b.md", "x/y/z/deep.py", "é ü/c d.md", "e%20.md", "link.md"}
    assert names_of(walk_folder(spark, str(tree)), tree) == kept
    assert names_of(walk_folder(spark, f"file://{tree}/x/.."), tree) == kept
    assert names_of(walk_folder(spark, str(tree), recursive=False), tree) == {n for n in kept if "/" not in n}
    whole = walk_folder(spark, str(tree), exclude=False)
    assert names_of(whole, tree) == kept | {"x/.git/no.md", "p.ASSETS/no.md", "build/no.md"}
    row = whole.filter("file_name = 'deep.py'").first()
    assert (row.file_type, row.file_size) == ("py", len("text of x/y/z/deep.py"))
    assert abs(row.file_modified_time.timestamp() - (tree / "x/y/z/deep.py").stat().st_mtime) < 1e-3


def test_walk_of_nothing(spark, tree):
    assert walk_folder(spark, str(tree / "empty")).count() == 0
    for missing in ("nowhere", "a.md"):
        with pytest.raises(FileNotFoundError):
            walk_folder(spark, str(tree / missing))
    assert can_walk(storage_uri(spark, str(tree))) and not can_walk("viewfs://store/x")


def test_files_are_read_by_name(spark, tree):
    listed = walk_folder(spark, str(tree))
    uri = storage_uri(spark, str(tree))
    got = {r.file_path.removeprefix(f"{tree}/"): r for r in read_files(listed, uri).collect()}
    assert len(got) == 8 and all(r.text == "text of " + n and bytes(r.content).decode() == r.text for n, r in got.items() if n != "link.md")
    assert {r.text for r in read_files(listed, uri, most_bytes=14).collect()} == {"text of a.md"}
    gone = listed.withColumn("raw_path", F.concat("raw_path", F.lit("x")))
    assert read_files(gone, uri).count() == 0


def test_orphans_of_a_walked_folder(spark, tree):
    rows = [(i, f"{tree}/{n}") for i, n in enumerate(["a.md", ".dot.md", "gone.md", "x/.git/no.md", ".hid/gone.md"])]
    docs = spark.createDataFrame(
        [tuple({"id": i, "file_path": p}.get(f.name) for f in S.DOCUMENTS) for i, p in rows], S.DOCUMENTS
    )
    lost = orphans(docs, walk_folder(spark, str(tree), exclude=False), str(tree))
    assert {r.id for r in lost.collect()} == {2, 4}
