import random
import re

import pytest
from pyspark.sql import functions as F

from sparkdocs.functions import tokens as T
from sparkdocs.operators.fulltext import build_postings, search_batch, search_postings
from sparkdocs.operators.search import SearchParams, matches, query_clauses, query_leaves, with_search_columns

PIECES = ["the", "of", "thé", "x1", "中", "文", "搜索", "ひ", "に", " ", "  ", "-", "_", "'", "中文", "\n", "Of", "THE"]
QUERIES = [
    "the", "of the", "the OR 中文", "中文", "中", "中文搜", '"the of"', '"中文 the"', "th*", "中*", "-the", "文* OR x1", "the -中文 of",
    '"of 中"', "搜索", "ひに", '"the the"', "搜", '-"the of" the',
]

GROUPS = ["(the OR 中文) x1", "-(the of) x1", 'the -(x1 OR "of the")', "((the) OR (of -(x1 OR th*))) -文*", "-(-(the))", "() the", "-(... of)"]


def corpus(spark, n=400):
    rng = random.Random(7)
    rows = [(i, "completed", "n.md", "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, status string, file_name string, markdown_content string")


def brute_tokens(text):
    out = []
    for run in re.findall(r"[぀-ヿ㐀-䶿一-鿿豈-﫿가-힯]+|[^\W_぀-ヿ㐀-䶿一-鿿豈-﫿가-힯]+", text.lower()):
        if re.match("[぀-ヿ㐀-䶿一-鿿]", run) and len(run) > 1:
            out += [run[i : i + 2] for i in range(len(run) - 1)]
        else:
            out.append(run)
    return out


def brute_count(text, term):
    toks, want = brute_tokens(text), brute_tokens(term)
    hits = 0
    for i in range(len(toks) - len(want) + 1):
        same = toks[i : i + len(want) - 1] == want[:-1]
        last = toks[i + len(want) - 1]
        hits += same and (last.startswith(want[-1]) if term.endswith("*") else last == want[-1])
    return hits


def brute_clauses(text, clauses):
    found = None
    for joiner, negated, item in clauses:
        held = brute_clauses(text, item) if isinstance(item, list) else brute_count(text, item) > 0
        test = held != negated
        found = test if found is None else (found or test if joiner == "or" else found and test)
    return found


def brute_search(text, keyword):
    clauses = query_clauses(keyword)
    found = brute_clauses(text, clauses)
    score = sum(brute_count(text, term) for negated, term in query_leaves(clauses) if not negated)
    return score if found else None


def test_groups_are_read():
    assert query_clauses("a (b OR -c) -(d)") == [
        ("and", False, "a"), ("and", False, [("and", False, "b"), ("or", True, "c")]), ("and", True, [("and", False, "d")]),
    ]
    assert query_leaves(query_clauses("a -(b -c -(d))")) == [(False, "a"), (True, "b"), (False, "c"), (False, "d")]
    assert query_clauses("f(x) ( ) -( ... ) OR") == [("and", False, "f(x)")]
    assert query_clauses('"a (b" (c)') == [("and", False, "a (b"), ("and", False, [("and", False, "c")])]
    for bad in ("(a", "a)", "a (b OR (c)", "(a))", "a)b", "f(x y)"):
        with pytest.raises(ValueError):
            query_clauses(bad)


def test_tokens(spark):
    df = corpus(spark)
    for row in df.select("markdown_content", T.tokens(F.col("markdown_content")).alias("t")).collect():
        assert row.t == brute_tokens(row.markdown_content), repr(row.markdown_content)


def test_three_ways_to_search_agree_with_brute_force(spark):
    df = corpus(spark)
    texts = {r.id: r.markdown_content for r in df.collect()}
    stored = with_search_columns(df).cache()
    postings = build_postings(df).cache()
    placed = build_postings(df, positions=True).cache()
    for keyword in QUERIES + GROUPS:
        want = {i: float(s) for i, t in texts.items() if (s := brute_search(t, keyword)) is not None}
        p = SearchParams(keyword=keyword)
        for way, found in {
            "text": matches(df, p).select("id", "score"),
            "stored": matches(stored, p).select("id", "score"),
            "postings": search_postings(postings, keyword, df),
            "positions": search_postings(placed, keyword, df.drop("markdown_content")),
        }.items():
            assert {r.id: r.score for r in found.collect()} == want, (keyword, way)


def test_batch_agrees_with_brute_force(spark):
    df = corpus(spark)
    texts = {r.id: brute_tokens(r.markdown_content) for r in df.collect()}
    asked = [(1, "the of"), (2, "中文"), (3, "the missing"), (4, "the the x1"), (5, "...")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    got = {(r.query_id, r.id): r.score for r in search_batch(build_postings(df), queries).collect()}
    want = {}
    for q, text in asked:
        words = set(brute_tokens(text))
        for i, toks in texts.items():
            if words and words <= set(toks):
                want[q, i] = float(sum(toks.count(w) for w in words))
    assert got == want


def test_trigrams(spark):
    def grams(text):
        out = set()
        for w in re.findall(r"[^\W_]+", text.lower()):
            p = f"  {w} "
            out |= {p[i : i + 3] for i in range(len(p) - 2)}
        return out

    df = corpus(spark)
    rows = df.select(
        "markdown_content", T.trigram_count(F.col("markdown_content")).alias("n"),
        T.trigram_similarity(F.col("markdown_content"), "the of").alias("s"),
        T.trigram_similarity(F.lit("The of"), "the OF").alias("same"),
    ).collect()
    key = grams("the of")
    for r in rows:
        own = grams(r.markdown_content)
        assert r.n == len(own)
        assert abs(r.s - len(own & key) / len(own | key)) < 1e-12
        assert 0 <= r.s <= 1 and r.same == 1.0
