import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sparkdocs import schemas as S
from sparkdocs.convert.default import default_registry
from sparkdocs.operators.changes import merge_documents
from sparkdocs.operators.maintain import delete_documents, orphans
from sparkdocs.operators.search import SearchParams, search
from sparkdocs.plans.export import export_markdown, select_for_export
from sparkdocs.plans.ingest import IngestOptions, ingest, ingest_folders
from sparkdocs.plans.notes_import import import_notes
from sparkdocs.plans.reprocess import retry_failed
from sparkdocs.plans.store import DocumentStore
from sparkdocs.sources.files import list_files, read_contents
from sparkdocs.sources.notes import read_folders, read_notes
from sparkdocs.sources.walk import read_files, walk_folder
from sparkdocs.streaming.ingest_stream import start_ingest_stream

T0 = datetime.now(timezone.utc) + timedelta(hours=1)


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "sub dir").mkdir(parents=True)
    (root / ".git").mkdir()
    (root / "note.md").write_text("# Title\nContent")
    (root / "plain.txt").write_text("hello text")
    (root / "code.py").write_text('print("hi")')
    (root / "raw.xyz").write_text("unsupported")
    (root / "sub dir" / "页.html").write_text("<h1>Deep</h1>")
    (root / "sub dir" / "skip.tmp").write_text("x")
    (root / ".git" / "x.md").write_text("x")
    (root / "plain.txt.meta.json").write_text('{"source_url": "https://example.org/p"}')
    (root / "code.py.meta.json").write_text("{broken")
    return root


def run(spark, store, root, at, types="md,txt,py,xyz,html", **options):
    return ingest_folders(spark, store, [str(root)], at, IngestOptions(file_types=types, **options))


def state_of(store):
    return {r.scope_key: r for r in store.state().collect()}


def test_folder_runs(spark, folder, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"), buckets=4)
    first = run(spark, store, folder, T0)
    docs = {r.file_name: r for r in store.documents().collect()}
    assert {n: d.conversion_type for n, d in docs.items()} == {
        "note.md": 0, "plain.txt": 1, "code.py": 2, "raw.xyz": None, "页.html": 8,
    }
    assert docs["raw.xyz"].status == "failed" and docs["raw.xyz"].error_message == "Unsupported file type: xyz"
    assert docs["plain.txt"].source_url == "https://example.org/p" and docs["code.py"].source_url is None
    assert docs["页.html"].file_path == str(folder / "sub dir" / "页.html")
    row = state_of(store)[str(folder)]
    assert (row.total_files, row.processed, row.skipped, row.errors) == (5, 4, 0, 1)
    stages = {r.stage for r in first.events(T0).collect()}
    assert {"scan_start", "scan_complete", "file_processing", "file_success", "file_error", "done"} == stages

    # Nothing changed: a full run skips every file, the failed one too.
    again = run(spark, store, folder, T0 + timedelta(hours=1), full=True)
    assert {r.outcome for r in again.outcomes.collect()} == {"skipped"}
    # By the cursor nothing is scanned, and the cursor moves on.
    run(spark, store, folder, T0 + timedelta(hours=2))
    row = state_of(store)[str(folder)]
    assert row.total_files == 0 and row.cursor_updated_at == (T0 + timedelta(hours=2)).replace(tzinfo=None)
    assert {r.id for r in store.documents().collect()} == {d.id for d in docs.values()}

    # A changed file replaces content, keeps id and creation time; one that now fails keeps its content.
    import os
    (folder / "plain.txt").write_text("new text")
    later = (T0 + timedelta(hours=3)).timestamp()
    os.utime(folder / "plain.txt", (later, later))
    run(spark, store, folder, T0 + timedelta(hours=4))
    changed = {r.file_name: r for r in store.documents().collect()}["plain.txt"]
    assert changed.markdown_content == "# plain.txt\n\nnew text"
    assert (changed.id, changed.created_at) == (docs["plain.txt"].id, docs["plain.txt"].created_at)
    found = search(store.documents(), SearchParams(keyword="hello")).collect()
    assert found == []


def test_missing_folder_is_reported(spark, folder, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"), buckets=2)
    out = ingest_folders(spark, store, [str(tmp_path / "nowhere"), str(folder)], T0)
    rows = {r.scope_key: r for r in out.runs.collect()}
    assert rows[str(tmp_path / "nowhere")].last_error_message == "invalid_directory"
    assert rows[str(tmp_path / "nowhere")].cursor_updated_at is None
    assert rows[str(folder)].processed >= 4
    assert "critical_error" in {r.stage for r in out.events(T0).collect()}


def test_folders_by_uri(spark, folder, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"), buckets=2)
    out = ingest_folders(spark, store, [f"file://{folder}/"], T0, IngestOptions(file_types="md,html"))
    assert {r.file_path for r in store.documents().collect()} == {str(folder / "note.md"), str(folder / "sub dir" / "页.html")}
    row = out.runs.collect()[0]
    assert (row.scope_key, row.processed, row.last_error_message) == (str(folder), 2, None)


def test_changed_file_keeps_an_old_sidecar(spark, folder, tmp_path):
    import os

    store = DocumentStore(spark, str(tmp_path / "store"), buckets=2)
    run(spark, store, folder, T0)
    # Changed at the very second of the cursor; the sidecar is older.
    os.utime(folder / "plain.txt", (T0.timestamp(), T0.timestamp()))
    (folder / "plain.txt.meta.json").touch()
    os.utime(folder / "plain.txt.meta.json", (1, 1))
    exact = T0.replace(microsecond=0)
    os.utime(folder / "plain.txt", (exact.timestamp(), exact.timestamp()))
    store = DocumentStore(spark, str(tmp_path / "second"), buckets=2)
    os.utime(folder / "note.md", (1, 1))
    run(spark, store, folder, exact)
    (folder / "plain.txt").write_text("newer")
    os.utime(folder / "plain.txt", (exact.timestamp(), exact.timestamp()))
    out = run(spark, store, folder, exact + timedelta(hours=1))
    docs = {r.file_name: r for r in store.documents().collect()}
    assert docs["plain.txt"].source_url == "https://example.org/p" and docs["plain.txt"].status == "completed"
    assert out.runs.collect()[0].total_files == 1 and out.runs.collect()[0].errors == 0


def test_excluded_and_oversized_files(spark, folder, tmp_path):
    (folder / "node_modules").mkdir()
    (folder / "node_modules" / "big.js").write_text("x" * 5000)
    (folder / "huge.md").write_text("x" * 5000)
    limit = "spark.sql.sources.binaryFile.maxLength"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "4000")
    try:
        store = DocumentStore(spark, str(tmp_path / "store"), buckets=2)
        run(spark, store, folder, T0, types="md")
        docs = {r.file_name: r.status for r in store.documents().collect()}
    finally:
        spark.conf.set(limit, before)
    assert docs == {"note.md": "completed", "huge.md": "failed"}


def test_emptied_folder(spark, folder, tmp_path):
    import shutil

    store = DocumentStore(spark, str(tmp_path / "store"), buckets=2)
    run(spark, store, folder, T0)
    shutil.rmtree(folder)
    folder.mkdir()
    out = run(spark, store, folder, T0 + timedelta(hours=1))
    row = out.runs.collect()[0]
    assert row.last_error_message is None and row.cursor_updated_at == (T0 + timedelta(hours=1)).replace(tzinfo=None)
    listing = list_files(spark, str(folder))
    docs = store.documents()
    assert orphans(docs, listing, str(folder), folder_exists=True).count() == docs.count() == 5
    assert orphans(docs, listing, str(folder)).count() == 0
    assert orphans(docs, listing, str(folder), folder_exists=False).count() == 0


def test_stream_state_of_several_folders(spark, tmp_path):
    rows = tmp_path / "rows"
    for k, paths in enumerate([["/r/a.md", "/r/b.md"], ["/q/c.md"], ["/r/d.md"]]):
        spark.createDataFrame([listing_row(p, 1) for p in paths], LISTING).coalesce(1).write.mode("append").parquet(str(rows))
    store = DocumentStore(spark, str(tmp_path / "store"), buckets=2)
    stream = spark.readStream.schema(LISTING).option("maxFilesPerTrigger", 1).parquet(str(rows))
    text = lambda batch: batch.select("file_path", F.lit("text").alias("text"))
    start_ingest_stream(stream, text, store, ["/r", "/q", "/none"], "s", str(tmp_path / "o")).awaitTermination()
    state = {r.scope_key: r for r in store.state().collect()}
    assert store.version() == 3 and set(state) == {"/r", "/q"}
    assert (state["/r"].total_files, state["/r"].processed, state["/q"].processed) == (3, 3, 1)
    assert all(r.last_error_message is None for r in state.values())


def test_scan_depth(spark, folder):
    assert {r.file_name for r in list_files(spark, str(folder), recursive=False).collect()} == {
        "note.md", "plain.txt", "code.py", "raw.xyz", "plain.txt.meta.json", "code.py.meta.json",
    }


def listing_row(path, hour):
    t = datetime(2025, 1, 1, hour, tzinfo=timezone.utc)
    name = path.rsplit("/", 1)[-1]
    return (name, name.rsplit(".", 1)[-1], 1, t, t, path)


LISTING = "file_name string, file_type string, file_size long, file_created_at timestamp, file_modified_time timestamp, file_path string"


def test_failed_again_keeps_content_and_merge_is_idempotent(spark):
    schema = f"{LISTING}, markdown_content string, conversion_type int, success boolean, error_message string, source string, source_url string"
    good = spark.createDataFrame([(*listing_row("/a/x.md", 1), "text", 0, True, None, "local_fs", None)], schema)
    bad = spark.createDataFrame([(*listing_row("/A/X.md", 2), None, None, False, "boom", "other", "u")], schema)
    docs = merge_documents(spark.createDataFrame([], S.DOCUMENTS), good, T0)
    after = merge_documents(docs, bad, T0)
    row = after.collect()[0]
    assert (row.markdown_content, row.status, row.error_message, row.source) == ("text", "failed", "boom", "other")
    assert row.file_modified_time.hour == 1 and row.file_path == "/a/x.md"
    assert merge_documents(after, bad, T0).collect() == after.collect()


def test_stream_replays_do_no_harm(spark, tmp_path):
    rows = tmp_path / "rows"
    spark.createDataFrame([listing_row("/r/a.md", 1), listing_row("/r/b.txt", 1)], LISTING).coalesce(1).write.parquet(str(rows))
    store = DocumentStore(spark, str(tmp_path / "store"), buckets=2)

    def contents(batch):
        return batch.select("file_path", F.concat(F.lit("text of "), "file_name").alias("text")).distinct()

    def go(offsets, hour):
        stream = spark.readStream.schema(LISTING).parquet(str(rows))
        at = T0 + timedelta(hours=hour)
        start_ingest_stream(stream, contents, store, ["/r"], "s", str(tmp_path / offsets), clock=lambda: at).awaitTermination()

    go("o1", 0)
    assert store.version() == 1 and store.documents().count() == 2
    # The last batch comes again after a failure: its commit mark is gone, its number is known.
    for mark in (tmp_path / "o1" / "commits").iterdir():
        mark.unlink()
    go("o1", 1)
    assert store.version() == 1
    # A new checkpoint folder numbers its batches from 0 again and loses nothing.
    spark.createDataFrame([listing_row("/r/NEW.md", 2)], LISTING).coalesce(1).write.mode("append").parquet(str(rows))
    go("o2", 2)
    assert {r.file_name for r in store.documents().collect()} == {"a.md", "b.txt", "NEW.md"}
    assert store.version() == 2
    go("o1", 3)
    assert store.version() == 3
    # A later batch changes one file.
    spark.createDataFrame([listing_row("/r/a.md", 5), listing_row("/r/b.txt", 1)], LISTING).coalesce(1).write.mode("append").parquet(str(rows))
    go("o1", 4)
    assert store.version() == 4
    times = {r.file_name: r.file_modified_time.hour for r in store.documents().collect()}
    assert times == {"a.md": 5, "b.txt": 1, "NEW.md": 2}
    state = store.state().collect()[0]
    assert (state.processed, state.skipped) == (1, 1)


def test_store_rewrites_only_touched_buckets(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"), buckets=16)
    paths = [f"/r/{i}.md" for i in range(40)]
    state = spark.createDataFrame([], S.INGEST_STATE)
    listing = spark.createDataFrame([listing_row(p, 1) for p in paths], LISTING)
    contents = listing.select("file_path", F.lit("x").alias("text"))
    store.merge(ingest(listing, contents, store.documents(), state, ["/r"], T0).converted, T0)
    one = spark.createDataFrame([listing_row("/r/7.md", 2)], LISTING)
    store.merge(ingest(one, contents, store.documents(), state, ["/r"], T0).converted, T0)
    assert store.documents().count() == 40
    assert len(list((tmp_path / "store" / "documents" / "v=2").glob("bucket=*"))) == 1
    left, deleted = delete_documents(store.documents(), store.documents().select("id"))
    assert deleted.first().deleted == 40
    store.replace(left, T0)
    assert store.documents().count() == 0 and store.version() == 3


def test_orphans_need_a_separator_and_a_listing(spark):
    docs = spark.createDataFrame([(1, "/a/b/x", "md"), (2, "/a/bc/y", "md"), (3, "/a/b/z", "txt")], "id long, file_path string, file_type string")
    disk = spark.createDataFrame([("/a/b/x",)], "file_path string")
    assert [r.id for r in orphans(docs, disk, "/a/b").collect()] == [3]
    assert orphans(docs, disk, "/a/b", file_type="md").count() == 0
    assert orphans(docs, disk, "/a/bc").count() == 0  # not listed at all


def test_notes(spark, tmp_path):
    def write(name, rows):
        (tmp_path / name).write_text("\n".join(json.dumps(r) for r in rows))
        return str(tmp_path / name)

    def note(i, parent, updated, body="<b>x</b> y", **kw):
        return {"id": i, "parent_id": parent, "title": f"n{i}", "body": body, "created_time": 0, "updated_time": updated, "markup_language": 1, **kw}

    cursor = datetime(2025, 1, 1, tzinfo=timezone.utc)
    ms = int(cursor.timestamp() * 1000)
    folders = read_folders(spark, write("f.json", [
        {"id": "a", "parent_id": "", "title": "A"}, {"id": "b", "parent_id": "a", "title": "B"},
        {"id": "o", "parent_id": "gone", "title": "O"},
    ]))
    notes = read_notes(spark, write("n.json", [
        note("1", "b", ms), note("2", "o", ms + 1, body=""), note("3", "missing", ms + 2, markup_language=2), note("4", "a", ms - 1),
        note("5", "a", 0),
    ]))
    empty = spark.createDataFrame([], S.DOCUMENTS)
    run = import_notes(notes, folders, empty, cursor)
    got = {r.file_path: r for r in run.converted.collect()}
    assert set(got) == {"joplin://A/B/n1__1", "joplin://O/n2__2", "joplin:///n3__3", "joplin://A/n5__5"}
    assert (got["joplin://A/B/n1__1"].markdown_content, got["joplin://A/B/n1__1"].conversion_type) == ("**x** y", 3)
    assert (got["joplin://O/n2__2"].markdown_content, got["joplin://O/n2__2"].conversion_type) == ("", 0)
    assert got["joplin:///n3__3"].file_type == "md" and got["joplin://A/B/n1__1"].file_type == "html"
    assert got["joplin://A/n5__5"].file_modified_time is None and got["joplin://A/B/n1__1"].file_created_at is None
    assert sorted(r.outcome for r in run.outcomes.collect()) == ["processed"] * 4 + ["skipped"]
    docs = merge_documents(empty, run.converted, T0)
    assert import_notes(notes, folders, docs, cursor).converted.count() == 0


def test_retry(spark, folder, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"), buckets=2)
    run(spark, store, folder, T0)
    docs = store.documents()
    ids = docs.select("id").unionByName(spark.createDataFrame([(5,)], "id long"))
    after, told = retry_failed(docs, ids, read_contents(spark, str(folder)), T0 + timedelta(days=1))
    outcomes = sorted(r.outcome for r in told.collect())
    assert outcomes == ["failed", "not_failed", "not_failed", "not_failed", "not_failed", "not_found"]
    failed = after.filter("status = 'failed'").first()
    assert failed.error_message == "Unsupported file type: xyz" and failed.updated_at > failed.created_at


def test_export(spark, folder, tmp_path):
    (folder / "plain.md").write_text("second")
    out = tmp_path / "out"
    files = select_for_export(list_files(spark, str(folder)), str(folder))
    counts = export_markdown(files, read_contents(spark, str(folder)), str(folder), f"file://{out}").first()
    assert (counts.total, counts.success, counts.failed) == (5, 5, 0)
    written = {str(p.relative_to(out)): p.read_text() for p in out.rglob("*.md")}
    assert written == {
        "note.md": "# Title\nContent", "code.md": '# code.py\n\n```py\nprint("hi")\n```', "sub dir/页.md": "# Deep",
        "plain.md": "# plain.txt\n\nhello text",
    }
    assert not list(out.rglob("*.part"))


def test_store_changes_touch_their_buckets_only(spark, tmp_path):
    schema = f"{LISTING}, markdown_content string, conversion_type int, success boolean, error_message string, source string, source_url string"
    rows = [(*listing_row(f"/r/{i}.md", 1), f"text {i}", 0, True, None, "local_fs", None) for i in range(60)]
    store = DocumentStore(spark, str(tmp_path / "store"), buckets=16)
    store.merge(spark.createDataFrame(rows, schema), T0)
    docs = store.documents()
    one = docs.filter("file_path = '/r/7.md'").select("id")
    before = {f for f in docs.inputFiles()}
    assert store.delete(one, T0) == 2
    after = {f for f in store.documents().inputFiles()}
    assert store.documents().count() == 59 and store.documents().join(one, "id", "left_semi").count() == 0
    assert len(before - after) == 1 and len(before & after) == len(before) - 1
    assert store.delete(one, T0) == 2  # nothing to do, nothing committed
    store.change(docs.select("id").limit(1), lambda d: d.withColumn("status", F.lit("failed")), T0)
    assert 1 <= store.documents().filter("status = 'failed'").count() < 59


def test_contents_of_files_are_not_broadcast(spark, folder):
    # Spark sizes them by their listing, so a broadcast would bring all of them to the driver.
    listed = walk_folder(spark, str(folder))
    files = lambda some: read_files(listed.join(some.select("file_path"), "file_path", "left_semi"), f"file://{folder}")
    beside = files(listed.filter("file_path LIKE '%.meta.json'")).select("file_path", "text")
    none = spark.createDataFrame([], S.DOCUMENTS), spark.createDataFrame([], S.INGEST_STATE)

    class Seen:
        def converter_of(self, kind):
            return F.lit("columns")

        def convert(self, rows):
            self.rows = rows
            return default_registry().convert(rows)

    seen, options = Seen(), IngestOptions(file_types="md,txt")
    made = ingest(listed.drop("raw_path"), files, *none, [str(folder)], T0, options, beside, seen, staged=False)
    plan = seen.rows._jdf.queryExecution().sparkPlan().toString().splitlines()
    joins = [line.split("Join")[0].split()[-1] for line in plan if "Join [file_path" in line and "LeftOuter" in line]
    assert set(joins) == {"SortMerge"}
    assert {(r.file_name, r.source_url) for r in made.converted.collect()} == {("note.md", None), ("plain.txt", "https://example.org/p")}


def test_files_of_a_check_are_written_by_tasks(spark, tmp_path):
    from checks.ingest import _write_files

    rows = spark.createDataFrame([(f"name=d-{i}/text.txt", f"text {i}") for i in range(5)], "rel string, text string")
    _write_files(rows, str(tmp_path / "in"))
    assert {(p.parent.name, p.read_text()) for p in (tmp_path / "in").rglob("*.txt")} == {(f"name=d-{i}", f"text {i}") for i in range(5)}
