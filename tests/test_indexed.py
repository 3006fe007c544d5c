"""Index tables: pages, trigram candidates, segments, and what their plans read."""

import contextlib
import io
import random
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkdocs import schemas as S
from sparkdocs.functions import tokens
from sparkdocs.operators.fulltext import build_postings, searchable_ids
from sparkdocs.operators.indexed import (
    CorpusIndex, build_trigrams, indexed_matches, needed_trigrams, search_indexed, trigram_candidates, write_trigrams,
)
from sparkdocs.operators.search import SearchParams, matches, search
from sparkdocs.plans.index_store import IndexStore
from sparkdocs.session import fresh_dir, stage

NOW = datetime(2025, 1, 1, tzinfo=timezone.utc)

WORDS = ["alpha", "beta", "gamma", "delta", "Al", "x", "the", "中文搜索", "é1", "alphabet"]


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def read_columns(df):
    return "\n".join(line for line in plan(df).splitlines() if line.startswith("ReadSchema"))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        text = None if i % 40 == 7 else rng.choice([" ", "-", ". "]).join(rng.choices(WORDS, k=rng.randint(0, 25)))
        row = dict(id=i, file_name=f"{rng.choice(WORDS)}_{i}.md", file_type=rng.choice(["md", "PDF"]), markdown_content=text,
                   status="failed" if i % 11 == 0 else "completed", source=rng.choice(["a", "b"]))
        rows.append(tuple(row.get(f.name) for f in S.DOCUMENTS))
    return stage(spark.createDataFrame(rows, S.DOCUMENTS).repartitionByRange(3, "id"))


@pytest.fixture(scope="module")
def index(docs):
    return CorpusIndex(stage(build_postings(docs, positions=True)), stage(build_trigrams(docs)), stage(searchable_ids(docs)))


@pytest.mark.parametrize("params", [
    dict(keyword="alpha -beta"), dict(keyword='"alpha beta" OR gamma', page=2, per_page=7), dict(keyword="-the", sort_by="filename"),
    dict(keyword="alph*", sort_by="mtime", sort_order="asc", source="a"), dict(keyword="中文 (x OR é1)", file_types=["pdf"]),
    dict(keyword=None, sort_by="filename", sort_order="asc"), dict(keyword="alpha", page=90), dict(keyword="..."),
    dict(keyword="lph", search_type="trigram"), dict(keyword="A", search_type="trigram", per_page=50), dict(keyword="beta. Al", search_type="trigram"),
    dict(keyword="文搜", search_type="trigram"), dict(keyword="nowhere", search_type="trigram"), dict(keyword="a_a", search_type="trigram", like_wildcards=True),
])
def test_pages_equal_the_scan(docs, index, params):
    p = SearchParams(**params)
    assert search_indexed(index, docs, p).collect() == search(docs, p).collect()


def test_matching_reads_no_text(docs, index):
    for keyword in ('"alpha beta" -gamma', "-(the x)", "alph* OR x"):
        found = indexed_matches(index, docs, SearchParams(keyword=keyword, source="a"))
        assert "term:string" in read_columns(found) and "markdown_content" not in read_columns(found)
    with pytest.raises(ValueError):
        indexed_matches(CorpusIndex(), docs, SearchParams(keyword="x"))


def test_page_rows_are_read_by_id(docs, index):
    page = search_indexed(index, docs, SearchParams(keyword="alpha", per_page=3))
    assert "PushedFilters: [In(id" in plan(page) or "PushedFilters: [IsNotNull(id), In(id" in plan(page)


@pytest.mark.parametrize("keyword", ["in it", "the", "a", "e-t", "x the y", "ab12", "--", "文搜索", "Ünï"])
def test_needed_trigrams_are_in_every_match(spark, keyword):
    rng = random.Random(len(keyword))
    texts = ["".join(rng.choices([keyword, keyword.upper(), " ", "q", "-", "é"], k=6)) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from sparkdocs.functions import tokens

    for r in df.select("t", tokens.trigram_set(F.col("t")).alias("g")).collect():
        if keyword.lower() in r.t.lower():
            assert set(needed_trigrams(keyword.lower())) <= set(r.g), r.t


def test_candidates_are_few_and_whole(spark, docs, index):
    found = {r.id for r in trigram_candidates(index.trigrams, "alphabet").collect()}
    want = {r.id for r in matches(docs, SearchParams(keyword="alphabet", search_type="trigram")).collect()}
    assert want <= found < {r.id for r in docs.collect()}
    assert trigram_candidates(index.trigrams, "of") is None
    path = fresh_dir(spark, "trigrams")
    write_trigrams(index.trigrams, path, partitions=3)
    stored = spark.read.parquet(path)
    assert stored.count() == index.trigrams.count()
    assert {r.id for r in trigram_candidates(stored, "ALPHAbet").collect()} == found


def files_of(folder):
    return sorted(str(p.relative_to(folder)) for p in Path(folder).rglob("*.parquet"))


def test_segments_follow_the_documents(spark, docs, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    assert store.segments() == [] and store.index().postings.count() == 0 and store.compact(NOW) == 0

    def same(current):
        index = store.index()
        fresh = CorpusIndex(build_postings(current, positions=True), build_trigrams(current), searchable_ids(current))
        for name in ("postings", "trigrams", "ids"):
            got, want = getattr(index, name), getattr(fresh, name)
            assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())), name
        for keyword in ("-the", '"alpha beta" OR x'):
            p = SearchParams(keyword=keyword, per_page=200)
            assert search_indexed(index, current, p).collect() == search(current, p).collect()

    store.build(docs, NOW)
    same(docs)
    base = files_of(tmp_path)
    changed = F.when(F.col("id") % 5 == 0, F.lit("the new alpha text")).otherwise(F.col("markdown_content"))
    failed = F.when(F.col("id") % 7 == 0, "failed").otherwise(F.col("status"))
    second = docs.withColumn("markdown_content", changed).withColumn("status", failed)
    second = stage(second.unionByName(second.limit(3).withColumn("id", F.col("id") + 1000).withColumn("status", F.lit("completed"))))
    store.update(second, second.filter("id % 5 = 0 OR id % 7 = 0 OR id >= 1000"), NOW)
    same(second)
    assert store.segments() == [1, 2] and set(base) <= set(files_of(tmp_path))
    third = second.filter("id % 3 <> 0")
    store.update(third, second.filter("id % 3 = 0"), NOW)
    same(third)
    again = stage(docs.filter("id IN (0, 3, 5)").withColumn("status", F.lit("completed")))
    fourth = third.filter("id NOT IN (0, 3, 5)").unionByName(again)
    store.update(fourth, again, NOW)
    same(fourth)
    store.compact(NOW)
    same(fourth)
    assert store.segments() == [5] and store.vacuum() == [1, 2, 3, 4] and store.vacuum() == []
    same(fourth)
    store.build(docs, NOW)
    same(docs)
    assert len(store.segments()) == 1


def test_placed_postings_and_trigrams_are_made_without_a_shuffle(spark):
    from pyspark.sql import functions as F

    texts = {1: "a b a 日本語 b", 2: None, 3: "", 4: "Ab, a-b 東 x1", 5: "gone"}
    rows = [(i, t, f"f{i}.md", "failed" if i == 5 else "completed") for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "id long, markdown_content string, file_name string, status string")
    made, grams = build_postings(docs, positions=True), build_trigrams(docs)
    for table in (made, grams):
        assert "Exchange" not in table._jdf.queryExecution().sparkPlan().toString()
    cut = docs.filter("status = 'completed'").select("id", tokens.placed_tokens(F.col("markdown_content")).alias("w")).collect()
    want = {}
    for r in cut:
        for i, w in enumerate(r.w or []):
            if w != tokens.RUN_START:
                want.setdefault((w, r.id), []).append(i)
    assert {(r.term, r.id): (r.tf, list(r.positions)) for r in made.collect()} == {k: (len(v), v) for k, v in want.items()}
    sets = [tokens.trigram_set(F.coalesce(F.col(c), F.lit(""))) for c in ("markdown_content", "file_name")]
    old = docs.filter("status = 'completed'").select("id", F.explode(F.array_union(*sets)).alias("gram"))
    assert sorted((r.id, r.gram) for r in grams.collect()) == sorted((r.id, r.gram) for r in old.collect())
