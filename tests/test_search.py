import re
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from sparkdocs import schemas as S
from sparkdocs.functions import present
from sparkdocs.operators.search import SearchParams, matches, search, search_info
from sparkdocs.operators.search import page_of, sort_keys


def documents(spark, rows):
    """rows: dicts of document columns."""
    return spark.createDataFrame([tuple(r.get(f.name) for f in S.DOCUMENTS) for r in rows], S.DOCUMENTS)


@pytest.fixture(scope="module")
def three(spark):
    t = datetime(2025, 1, 1, tzinfo=timezone.utc)
    names = [("a.md", "MD", 0), ("b.txt", "TXT", 1), ("c.py", "PY", 2)]
    return documents(spark, [
        dict(id=i, file_name=n, file_type=k, file_size=10, file_created_at=t, file_modified_time=t, file_path=f"/tmp/{n}",
             markdown_content=f"# {n[0].upper()}", conversion_type=c, status="completed")
        for i, (n, k, c) in enumerate(names)
    ])


def test_conversion_filter(three):
    def names(types):
        return {r.filename for r in search(three, SearchParams(conversion_types=types)).collect()}

    assert names([2]) == {"c.py"}
    assert names([0, 1]) == {"a.md", "b.txt"}
    assert search_info(three, SearchParams(conversion_types=[2])).first().total_results == 1


def test_type_filter_ignores_case(three):
    assert [r.filename for r in search(three, SearchParams(file_types=["md"])).collect()] == ["a.md"]


def test_params():
    p = SearchParams.from_args({
        "keyword": "x", "sort_by": "size", "sort_order": "UP", "search_type": "fuzzy", "page": "0", "per_page": "x",
        "file_types": "PDF, md,", "conversion_types": "1,a, 3",
    })
    assert (p.sort_by, p.sort_order, p.search_type, p.page, p.per_page) == ("relevance", "desc", "full_text", 1, 20)
    assert p.file_types == ["pdf", "md"] and p.conversion_types == [1, 3]
    assert SearchParams.from_args({"page": "3", "sort_order": "ASC"}).page == 3


def test_null_order(spark):
    t = datetime(2025, 1, 1, tzinfo=timezone.utc)
    df = documents(spark, [
        dict(id=1, file_name="a", file_modified_time=t, status="completed"),
        dict(id=2, file_name="b", file_modified_time=None, status="completed"),
    ])

    def ids(**kw):
        return [r.id for r in search(df, SearchParams(**kw)).collect()]

    assert ids(sort_by="mtime", sort_order="asc") == [1, 2]
    assert ids(sort_by="mtime", sort_order="desc") == [2, 1]
    assert ids(sort_by="filename", sort_order="desc") == [2, 1]


def test_pages_part_the_result(spark):
    df = documents(spark, [dict(id=i, file_name="same", status="completed") for i in range(25)])
    p = SearchParams(sort_by="filename", per_page=10)
    found = matches(df, p)
    pages = [[r.id for r in page_of(found, sort_keys(p), n, 10).collect()] for n in (1, 2, 3, 4)]
    assert pages == [list(range(10)), list(range(10, 20)), list(range(20, 25)), []]


def test_wildcards_are_literal_unless_asked(spark):
    df = documents(spark, [
        dict(id=1, file_name="x", markdown_content="50% off", status="completed"),
        dict(id=2, file_name="x", markdown_content="50 or off", status="completed"),
    ])

    def ids(**kw):
        p = SearchParams(keyword="50% off", search_type="trigram", **kw)
        return sorted(r.id for r in matches(df, p).collect())

    assert ids() == [1]
    assert ids(like_wildcards=True) == [1, 2]


def brute_snippet(content, keyword, n=200):
    words = [k for k in re.split(r"[\s+]+", keyword) if k]
    at = next((content.lower().find(w.lower()) for w in words if w.lower() in content.lower()), None)
    if at is None:
        return content[:n] + ("..." if len(content) > n else "")
    start, end = max(0, at - 100), min(len(content), at + len(words[0]) + 100)
    if start == 0:
        end = min(len(content), n)
    if end == len(content):
        start = max(0, len(content) - n)
    text = ("..." if start else "") + content[start:end] + ("..." if end < len(content) else "")
    return re.sub("(" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + ")", r"<mark>\1</mark>", text, flags=re.I)


@pytest.mark.parametrize("keyword", ["needle", "missing", "Needle pin", "pin needle", "a+b", "(x", "Ünï"])
def test_snippet(spark, keyword):
    texts = ["", "needle", "x" * 90 + "NEEDLE" + "y" * 300, "y" * 500 + "needle" + "z" * 40, "w" * 300, "w" * 200, "pin " * 80,
             "é" * 150 + "needle (x ünï" + "è" * 150, "a b " * 100]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", present.snippet(F.col("t"), keyword).alias("s")).collect()
    for r in rows:
        assert r.s == brute_snippet(r.t, keyword), r.t


def test_highlight(spark):
    df = spark.createDataFrame([("The cartel's ar\\E x$1",)], "t string")

    def mark(k):
        return df.select(present.highlight(F.col("t"), k)).first()[0]

    assert mark("ar mark") == "The c<mark>ar</mark>tel's <mark>ar</mark>\\E x$1"
    assert mark("the\tX$1") == "<mark>The</mark> cartel's ar\\E <mark>x$1</mark>"
    assert mark("\\E") == "The cartel's ar<mark>\\E</mark> x$1"
    assert mark("") == "The cartel's ar\\E x$1"
