"""Jobs as a whole: cancelled runs, streams stopped between batches, notes with errors, images."""

import threading
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from sparkdocs import schemas as S
from sparkdocs.convert.default import default_registry
from sparkdocs.convert.image import ImageSources
from sparkdocs.plans import notes_job
from sparkdocs.plans.ingest import IngestOptions
from sparkdocs.plans.layered_store import LayeredStore
from sparkdocs.plans.notes_job import moved_notes, notes_cursor, run_notes_import
from sparkdocs.plans.run_control import RunCancelled, RunControl, ingest_cancellable
from sparkdocs.plans.store import DocumentStore
from sparkdocs.streaming.ingest_stream import start_ingest_stream

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)


@pytest.fixture
def store(spark, tmp_path):
    return DocumentStore(spark, str(tmp_path / "store"), buckets=4)


def test_running_jobs_are_interrupted(spark):
    control = RunControl(spark, "slow")

    def slow(batches):
        for batch in batches:
            time.sleep(60)
            yield batch

    threading.Timer(4, control.cancel).start()
    began = time.monotonic()
    assert control.run(lambda: spark.range(4).mapInArrow(slow, "id long").count()) is None
    assert time.monotonic() - began < 40 and control.cancelled
    # A job after the cancel does not start; other runs are not touched.
    assert control.run(lambda: spark.range(3).count()) is None
    assert RunControl(spark, "other").run(lambda: spark.range(3).count()) == 3
    with pytest.raises(ZeroDivisionError):
        RunControl(spark, "bad").run(lambda: 1 // 0)


def test_cancelled_run_leaves_the_store(spark, store, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text("one")
    run, _ = ingest_cancellable(RunControl(spark, "one"), store, [str(folder)], T0)
    assert run.outcomes.count() == 1
    (folder / "b.md").write_text("two")
    before = store.state().collect(), store.version()

    class StopsLate(RunControl):
        steps = 0

        def check(self):
            self.steps += 1
            if self.steps == 3:  # the last step before the commit
                self.cancel()
            super().check()

    control = StopsLate(spark, "two")
    run, events = ingest_cancellable(control, store, [str(folder)], T0 + timedelta(days=1))
    assert run is None and [r.stage for r in events.orderBy("event_no").collect()] == ["scan_start", "cancelled", "done"]
    assert (store.state().collect(), store.version()) == before
    run, _ = ingest_cancellable(RunControl(spark, "three"), store, [str(folder)], T0 + timedelta(days=2))
    assert {r.file_name for r in store.documents().collect()} == {"a.md", "b.md"}


def test_stream_stops_between_batches_and_goes_on(spark, store, tmp_path):
    rows = str(tmp_path / "rows")
    schema = "file_name string, file_type string, file_size long, file_created_at timestamp, file_modified_time timestamp, file_path string"
    for i in range(3):
        spark.createDataFrame([(f"{i}.md", "md", 1, T0, T0, f"/in/{i}.md")], schema).coalesce(1).write.mode("append").parquet(rows)
    listing = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(rows)
    merged = []

    def contents(batch):
        merged.append(1)
        return batch.select("file_path", F.lit("text").alias("text"))

    def start(check):
        return start_ingest_stream(listing, contents, store, ["/in"], "s", str(tmp_path / "offsets"), clock=lambda: T0, check=check)

    def stop_after_one():
        if store.documents().count() == 1:
            raise RunCancelled("s")

    with pytest.raises(StreamingQueryException, match="RunCancelled"):
        start(stop_after_one).awaitTermination()
    assert store.documents().count() == 1 and store.state().first().total_files == 1
    start(lambda: None).awaitTermination()
    assert store.documents().count() == 3 and len(merged) == 3  # the merged batch is not done again
    assert store.state().first().processed == 3


def notes_of(spark, rows):
    """Notes in folder `f` from (id, title, body, updated_time)."""
    def cells(i, title, body, updated):
        return {"id": i, "parent_id": "f", "title": title, "body": body, "created_time": 1, "updated_time": updated, "markup_language": 1}

    return spark.createDataFrame([tuple(cells(*r).get(f.name) for f in S.NOTES) for r in rows], S.NOTES)


def test_notes_job_keeps_its_cursor_on_failure(spark, store, monkeypatch):
    folders = spark.createDataFrame([("f", "", "Folder")], S.FOLDERS)
    run_notes_import(store, notes_of(spark, [("n1", "One", "<p>a</p>", 1000), ("n2", "Two", "", 1000)]), folders, T0)
    docs = {r.file_path: r for r in store.documents().collect()}
    assert docs["joplin://Folder/One__n1"].conversion_type == S.STRUCTURED and docs["joplin://Folder/Two__n2"].conversion_type == S.DIRECT
    row = store.state().first()
    assert (row.total_files, row.processed, row.skipped, row.errors) == (2, 2, 0, 0) and notes_cursor(store.state()) is not None
    cursor = notes_cursor(store.state())

    def broken(*args):
        raise OSError("no folders")

    with monkeypatch.context() as patch:
        patch.setattr(notes_job, "import_notes", broken)
        with pytest.raises(OSError):
            run_notes_import(store, notes_of(spark, []), folders, T0 + timedelta(days=1))
    row = store.state().first()
    assert row.last_error_message == "OSError: no folders" and notes_cursor(store.state()) == cursor and store.documents().count() == 2
    late = int((T0 + timedelta(days=2)).timestamp() * 1000)
    run_notes_import(store, notes_of(spark, [("n1", "Renamed", "b", late), ("n2", "Two", "", 1000)]), folders, T0 + timedelta(days=3))
    row = store.state().first()
    assert (row.total_files, row.processed, row.skipped, row.last_error_message) == (2, 1, 1, None)
    assert [(r.file_path, r.new_path) for r in moved_notes(store.documents()).collect()] == [("joplin://Folder/One__n1", "joplin://Folder/Renamed__n1")]


def test_images_by_provider(spark):
    rows = spark.createDataFrame(
        [(f"/i/{n}.PNG", f"{n}.PNG", "PNG", 3, T0, b"abc") for n in "abcde"],
        "file_path string, file_name string, file_type string, file_size long, file_modified_time timestamp, content binary",
    )
    attempts = spark.createDataFrame([
        ("/i/a.PNG", "local", 1, True, " read text \n", None), ("/i/b.PNG", "Local", 1, False, None, "no library"),
        ("/i/b.PNG", "cloud", 2, True, "a cat", None), ("/i/c.PNG", "local", 1, False, None, "x"), ("/i/c.PNG", "cloud", 2, False, None, None),
        ("/i/d.PNG", "cloud", 1, True, "  ", None),
    ], "path string, provider string, attempt_no long, ok boolean, content string, error string")
    exif = spark.createDataFrame([("/i/a.PNG", {"Model": "M"}), ("/i/d.PNG", {"Model": "N"})], "file_path string, exif map<string,string>")
    made = default_registry(images=ImageSources(attempts, "local", ["cloud"], exif)).convert(rows)
    got = {r.file_name[0]: r for r in made.collect()}
    assert len(got) == 5
    assert got["a"].markdown_content.endswith("---\n\n# a.PNG\n\nread text\n") and "  Model: M\n" in got["a"].markdown_content
    assert (got["b"].markdown_content, got["d"].markdown_content) == ("a cat", "# d.PNG\n\n")
    assert got["c"].error_message == "Image OCR/caption extraction failed: provider=local error=x; provider=cloud error=None"
    assert got["e"].error_message == "Image OCR/caption extraction failed: no providers attempted" and not got["e"].success
    off = default_registry().convert(rows).collect()
    assert {r.markdown_content for r in off} == {f"# {n}.PNG\n" for n in "abcde"}


def files_below(folder):
    return {str(p): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_layers_equal_buckets(spark, store, tmp_path):
    """The same merges, failures, changes and deletes in both kinds of store."""
    layered = LayeredStore(spark, str(tmp_path / "layered"))
    schema = "file_path string, file_name string, file_type string, file_size long, file_created_at timestamp, file_modified_time timestamp, " \
             "markdown_content string, conversion_type int, success boolean, error_message string, source string, source_url string"

    def batch(names, text, ok=True):
        rows = [(f"/C/{n}", n, "md", 1, T0, T0, text if ok else None, 0, ok, None if ok else "bad", "local_fs", None) for n in names]
        return spark.createDataFrame(rows, schema)

    def same():
        order = ["id", "file_path"]
        assert layered.documents().orderBy(order).collect() == store.documents().orderBy(order).collect()

    same()
    steps = [
        lambda s: s.merge(batch("abcdef", "one"), T0, stream="s/1", batch_id=0),
        lambda s: s.merge(batch("bcx", "two"), T0 + timedelta(days=1)),
        lambda s: s.merge(batch("cy", "three", ok=False), T0 + timedelta(days=2)),
        lambda s: s.delete(s.documents().filter("file_name IN ('a', 'x')").select("id"), T0),
        lambda s: s.merge(batch("a", "again"), T0 + timedelta(days=3)),
        lambda s: s.merge(batch("", "none"), T0 + timedelta(days=4)),
        lambda s: s.change(s.documents().filter("file_name = 'd'").select("id"), lambda d: d.withColumn("source", F.lit("z")), T0),
    ]
    for step in steps:
        before = files_below(tmp_path / "layered")
        step(store)
        step(layered)
        same()
        after = files_below(tmp_path / "layered")
        assert {k: after[k] for k in before} == before  # nothing is rewritten
    assert layered.has_batch("s/1", 0) and not layered.has_batch("s/1", 1)
    state = spark.createDataFrame([tuple("local_fs" if f.name == "source" else None for f in S.INGEST_STATE)], S.INGEST_STATE)
    layered.set_state(state, T0)
    assert layered.state().count() == 1
    held = layered.layers()
    layered.compact(T0)
    same()
    assert len(held) > 4 and len(layered.layers()) == 1 and layered.vacuum() == held and layered.vacuum() == []
    same()
    assert layered.compact(T0) == layered.version() and layered.state().count() == 1


def test_folder_run_on_layers(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text("one")
    layered = LayeredStore(spark, str(tmp_path / "layered"))
    for day, text in enumerate(["one", "two"]):
        (folder / "a.md").write_text(text)
        run, _ = ingest_cancellable(RunControl(spark, f"d{day}"), layered, [str(folder)], T0 + timedelta(days=day), IngestOptions(full=True))
        assert run.outcomes.first().outcome == "processed"
    assert [r.markdown_content for r in layered.documents().collect()] == ["two"] and layered.state().count() == 1


def test_large_batches_are_joined_once(spark, tmp_path, monkeypatch):
    from sparkdocs.operators import changes
    from sparkdocs.plans import layered_store, store as plain_store
    from sparkdocs.plans.layered_store import LayeredStore

    at, later = datetime(2025, 1, 1, tzinfo=timezone.utc), datetime(2025, 2, 1, tzinfo=timezone.utc)
    held = [(i, f"n{i}", "md", 1, at, at, f"/a/n{i}", f"old {i}", 0, "completed", None, "s", None, at, at) for i in range(6)]
    held.append((99, "none", "md", 1, at, at, None, "no path", 0, "completed", None, "s", None, at, at))
    rows = [
        (100, "N1", "md", 2, later, later, "/A/N1", "new 1", 1, True, None, "t", "u"),
        (101, "n2", "md", 2, later, later, "/a/n2", None, None, False, "boom", "t", "u"),
        (102, "n3", "md", 2, later, later, "/a/n3", "odd", 1, None, None, "t", "u"),
        (103, "m1", "md", 2, later, later, "/a/m1", "added", 1, True, None, "t", "u"),
        (104, "m2", "md", 2, later, later, "/a/m2", "x", 1, False, "boom", "t", "u"),
        (105, "m3", "md", 2, later, later, None, "no path", 1, True, None, "t", "u"),
    ]
    schema = (
        "id long, file_name string, file_type string, file_size long, file_created_at timestamp, file_modified_time timestamp, file_path string, "
        "markdown_content string, conversion_type int, success boolean, error_message string, source string, source_url string"
    )
    docs = spark.createDataFrame(held, S.DOCUMENTS)
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "batch"))
    batch = spark.read.schema(schema).parquet(str(tmp_path / "batch"))

    def shown(df):
        return sorted(map(str, df.collect()))

    want = changes.merge_documents(docs, batch, later)
    once = changes.merge_documents(docs, batch, later, one_join="full")
    assert shown(once) == shown(want) and len(shown(want)) == 10
    scans = [df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") for df in (want, once)]
    assert scans == [2, 1]
    paths = ("/a/n1", "/a/n2", "/a/n3", "/a/m1", "/a/m2")
    right = shown(changes.merge_documents(docs, batch, later, one_join="right").filter(F.col("file_path").isin(*paths)))
    assert right == shown(want.filter(F.col("file_path").isin(*paths)))
    # Both stores take that join for a large batch.
    monkeypatch.setattr(plain_store, "LARGE_BATCH", 2)
    monkeypatch.setattr(layered_store, "LARGE_BATCH", 2)
    used = []

    def noted(docs, batch, run_ts, replaced, one_join=None):
        used.append(one_join)
        return changes.merge_documents(docs, batch, run_ts, replaced, one_join)

    monkeypatch.setattr(plain_store, "merge_documents", noted)
    monkeypatch.setattr(layered_store, "merge_documents", noted)
    with_path = docs.filter("file_path IS NOT NULL")
    for store in (plain_store.DocumentStore(spark, str(tmp_path / "s"), buckets=4), LayeredStore(spark, str(tmp_path / "l"))):
        store.replace(with_path, at)
        store.merge(batch.filter("file_path IS NOT NULL"), later)
        assert shown(store.documents()) == shown(want.filter("file_path IS NOT NULL"))
    assert used == ["full", "right"]


def test_notes_job_converts_each_body_once(spark, store, monkeypatch):
    from sparkdocs.plans import notes_import

    seen, plain = spark.sparkContext.accumulator(0), notes_import.convert_html

    def counting(rows, column):
        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return plain(rows.mapInArrow(count, rows.schema), column)

    monkeypatch.setattr(notes_import, "convert_html", counting)
    folders = spark.createDataFrame([("f", "", "Folder")], S.FOLDERS)
    run_notes_import(store, notes_of(spark, [(f"n{i}", f"T{i}", f"<p>{i}</p>", 1000) for i in range(5)]), folders, T0)
    row = store.state().first()
    assert (row.total_files, row.processed, seen.value) == (5, 5, 5)
