"""Index rows as packed blocks: whole rows, ordered and even ranges, nothing left behind; masks as bits."""

import random
from datetime import datetime, timezone
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from checks.tables import VIEWS, Tables
from sparkdocs.operators import blocks
from sparkdocs.operators.fulltext import build_postings, write_postings
from sparkdocs.operators.indexed import build_trigrams, write_trigrams
from sparkdocs.operators.sizes import IdSet
from sparkdocs.plans.index_store import IndexStore
from sparkdocs.session import shared_dir, stage

NOW = datetime(2025, 1, 1, tzinfo=timezone.utc)


def as_tuples(rows):
    batches = list(blocks.row_batches(rows, ["key", "id", "tf", "positions"][: 2 + 2 * (rows.tf is not None)]))
    return [tuple(r.values()) for b in batches for r in b.to_pylist()]


def made(n, placed=True, seed=1):
    rng = random.Random(seed)
    keys = ["the", "a", "zz", "日本", "é", "", "𠀀x"]
    rows = []
    for _ in range(n):
        places = sorted(rng.sample(range(5000), rng.choice([1, 1, 2, 40])))
        rows.append((rng.choice(keys[: rng.randint(1, 7)]), rng.choice([rng.randint(0, 500), rng.randint(-(2**63), 2**63 - 1)]), len(places), places))
    keys, ids, tf, places = zip(*rows) if rows else ((), (), (), ())
    extra = (np.array(tf, np.int64), pa.array(places, pa.list_(pa.int32()))) if placed else ()
    return rows, blocks.sorted_rows(pa.array(keys, pa.string()), np.arange(n), np.array(ids, np.int64), *extra)


@pytest.mark.parametrize("n", [0, 1, 700])
@pytest.mark.parametrize("placed", [True, False])
def test_blocks_hold_their_rows(n, placed):
    rows, packed = made(n, placed)
    want = [r if placed else r[:2] for r in sorted(rows, key=lambda r: (r[0].encode(), r[1]))]
    assert [r[:2] for r in as_tuples(packed)] == [r[:2] for r in want] and sorted(as_tuples(packed)) == sorted(want)
    if not n:
        return
    assert as_tuples(blocks.unpack(blocks.pack(packed))) == as_tuples(packed)
    borders = sorted({r[:2] for r in want[:: max(1, n // 9)]} | {("b", 0), ("the", 250)})
    block = pa.RecordBatch.from_arrays([pa.array([blocks.pack(packed)], pa.binary())], ["block"])
    pieces = [(b.column(0)[0].as_py(), as_tuples(blocks.unpack(b.column(1)[0].as_py()))) for b in blocks._cut_at(borders)([block])]
    assert [r for _, piece in pieces for r in piece] == as_tuples(packed)
    for part, piece in pieces:
        assert all((part == 0 or borders[part - 1] <= r[:2]) and (part == len(borders) or r[:2] < borders[part]) for r in piece)


def test_ranges_are_ordered_and_even(spark, tmp_path):
    # Half of the rows are of one term, and ids are hashes.
    table = spark.range(60_000).select(
        F.when(F.col("id") % 2 == 0, "the").otherwise(F.concat(F.lit("w"), F.col("id") % 997)).alias("term"),
        F.xxhash64("id").alias("id"), (F.col("id") % 3 + 1).alias("tf"),
    )
    write_postings(table, str(tmp_path / "p"), partitions=6)
    files = sorted((tmp_path / "p").glob("*.parquet"))
    read = [[tuple(r.values()) for r in pq.read_table(f).to_pylist()] for f in files]
    assert [r for part in read for r in part] == sorted(map(tuple, table.collect()))
    assert len(files) == 6 and max(map(len, read)) < 2 * 60_000 / 6
    narrow = table.select("term", (F.col("tf") * 7).cast("int").alias("id"), F.col("tf").cast("int").alias("tf")).limit(50)
    write_postings(stage(narrow), str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "n")).count() == 50


def test_a_segment_is_made_of_packed_blocks_and_leaves_no_copies(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, "completed", f"f{i}.md", " ".join(f"w{min(rng.randint(0, 4000), rng.randint(0, 4000))}" for _ in range(80))) for i in range(3000)]
    docs = stage(spark.createDataFrame(rows, "id long, status string, file_name string, markdown_content string"))
    before = set(Path(shared_dir(spark).removeprefix("file:")).iterdir())
    store = IndexStore(spark, str(tmp_path / "index"))
    store.build(docs, NOW)
    store.update(docs, docs.filter("id < 2000"), NOW)
    store.compact(NOW)
    # Only lists of touched ids may stay: texts, postings and trigrams were kept there as copies before.
    left = set(Path(shared_dir(spark).removeprefix("file:")).iterdir()) - before
    assert sum(f.stat().st_size for d in left for f in d.rglob("*.parquet")) < 50_000
    index = store.index()
    assert sorted(map(str, index.postings.collect())) == sorted(map(str, build_postings(docs, positions=True).collect()))
    assert sorted(map(tuple, index.trigrams.collect())) == sorted(map(tuple, build_trigrams(docs).collect()))
    n, size = blocks.packed(index.postings).agg(F.sum("n"), F.sum(F.length("block"))).first()
    assert n == index.postings.count() and size < 6 * n  # a row each takes some eighty bytes


def test_what_a_task_counts_in_one_pass(spark, tmp_path):
    texts = {5: "a b a 日本語 b", -2: None, 3: "", 4: "Ab, a-b 東 x1", 9: "--", 7: "gone", 8: "日本"}
    rows = [(i, t, None if i == 9 else f"f{i}.md", "failed" if i == 7 else "completed") for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "id long, markdown_content string, file_name string, status string")
    store = IndexStore(spark, str(tmp_path / "index"))
    store.build(docs, NOW)
    index = store.index()
    assert sorted(map(str, index.postings.collect())) == sorted(map(str, build_postings(docs, positions=True).collect()))
    assert sorted(map(tuple, index.trigrams.collect())) == sorted(map(tuple, build_trigrams(docs).collect()))
    assert sorted(r.id for r in index.ids.collect()) == [3, 4, 5, 8, 9]
    write_trigrams(index.trigrams, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == index.trigrams.count()


def test_id_sets(spark):
    edge = [-(2**63), -65, -64, -1, 0, 1, 63, 64, 2**62, 2**63 - 1]
    ids = spark.createDataFrame([(i,) for i in [*edge, 64, None]], "id long")
    table = spark.createDataFrame([(i + d,) for i in edge for d in (-1, 0, 1) if -(2**63) <= i + d < 2**63] + [(None,)], "id long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for how in ("left_semi", "left_anti"):
            want = sorted(str(r) for r in table.join(ids, "id", how).collect())
            for most in (1000, 0):
                found = IdSet(ids, most).join(table, how)
                assert sorted(str(r) for r in found.collect()) == want and found.columns == ["id"]
            plan = IdSet(ids).join(table, how)._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_batch_is_that_of_its_sql(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    want = spark.sql(VIEWS["batch"], docs=t.docs, listing=t.listing)
    assert t.batch.dtypes == want.dtypes
    assert sorted(map(str, t.batch.collect())) == sorted(map(str, want.collect()))


def test_older_segments_are_masked_without_a_shuffle(spark, tmp_path):
    docs = stage(spark.range(2000).select("id", F.lit("completed").alias("status"), F.lit("a.md").alias("file_name"), F.concat(F.lit("the w"), F.col("id") % 50).alias("markdown_content")))
    store = IndexStore(spark, str(tmp_path / "index"))
    store.build(docs, NOW)
    store.update(docs.filter("id % 3 <> 0"), docs.filter("id % 3 = 0"), NOW)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for table in (store.index().postings, store.index().trigrams):
            plan = table._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "Exchange hashpartitioning(id" not in plan
        assert {r.id for r in store.index().postings.collect()} == {i for i in range(2000) if i % 3}
        store.compact(NOW)
        assert store.vacuum() == [1, 2] and store.index().postings.count() == 2 * sum(1 for i in range(2000) if i % 3)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
