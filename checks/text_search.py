"""Full text, trigram and substring search; scores, snippets, highlights; batches over postings."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from checks.tables import query
from sparkdocs.functions import present, tokens
from sparkdocs.operators.fulltext import build_postings, search_batch, search_postings
from sparkdocs.operators.indexed import (
    CorpusIndex, build_trigrams, indexed_matches, search_indexed, search_info_indexed,
)
from sparkdocs.operators.search import SearchParams, matches, search, search_info
from sparkdocs.operators.changes import merge_documents
from sparkdocs.operators.sizes import IdSet
from sparkdocs.plans.index_store import IndexStore
from sparkdocs.session import fresh_dir, stage, staged

RUN_TS = datetime(2024, 6, 1, tzinfo=timezone.utc)

_TOK = (
    "CASE WHEN trim(regexp_replace(lower({0}), '[^\\p{{{{L}}}}\\p{{{{N}}}}]+', '  ', 'g')) = '' THEN '' "
    "ELSE ' ' || trim(regexp_replace(lower({0}), '[^\\p{{{{L}}}}\\p{{{{N}}}}]+', '  ', 'g')) || ' ' END"
).format("markdown_content")

# Searchable documents with their token string.
_T = f"(SELECT *, {_TOK} AS tok FROM {{docs}} WHERE status = 'completed') t"


def _occ(term: str) -> str:
    return f"((length(tok) - length(replace(tok, '{term}', ''))) // {len(term)})"


def _mark(text: str, words: list[str]) -> str:
    longest = sorted(words, key=len, reverse=True)
    return f"regexp_replace({text}, '({'|'.join(longest)})', '<mark>\\1</mark>', 'gi')"


def _snippet(words: list[str], text: str = "markdown_content") -> str:
    """Select expression over a table with that text column."""
    at = "coalesce(" + ", ".join(f"nullif(strpos(lower({text}), '{w}'), 0)" for w in words) + ") - 1"
    n = f"length({text})"
    start0 = f"greatest(0, {at} - 100)"
    end = f"CASE WHEN {start0} = 0 THEN least({n}, 200) ELSE least({n}, {at} + {len(words[0])} + 100) END"
    start = f"CASE WHEN ({end}) = {n} THEN greatest(0, {n} - 200) ELSE {start0} END"
    cut = (
        f"CASE WHEN ({start}) > 0 THEN '...' ELSE '' END || substr({text}, ({start}) + 1, ({end}) - ({start})) "
        f"|| CASE WHEN ({end}) < {n} THEN '...' ELSE '' END"
    )
    plain = f"substr({text}, 1, 200) || CASE WHEN {n} > 200 THEN '...' ELSE '' END"
    return f"CASE WHEN ({at}) IS NULL THEN {plain} ELSE {_mark('(' + cut + ')', words)} END"


def _result(source: str, words: list[str], score: str, order: str, page: str) -> str:
    return f"""
        SELECT id, {_mark('file_name', words)} AS filename, file_path AS filepath, file_type AS filetype,
               file_size AS filesize, strftime(file_modified_time, '%Y-%m-%dT%H:%M:%SZ') AS file_modified_time,
               {_snippet(words)} AS snippet, source, source_url, round(score, 3) AS relevance
        FROM (SELECT *, ({score})::DOUBLE AS score FROM {source}) s
        ORDER BY {order} {page}
    """


@query(
    "search_fulltext",
    _result(
        f"(SELECT * FROM {_T} WHERE contains(tok, ' the ') AND contains(tok, ' with ')) m",
        ["the", "with"], f"{_occ(' the ')} + {_occ(' with ')}", "score DESC, id", "LIMIT 20",
    ),
)
def _(t):
    return search(t.docs, SearchParams(keyword="the with"))


@query(
    "search_page",
    _result(
        f"(SELECT * FROM {_T} WHERE contains(tok, ' que ')) m",
        ["que"], _occ(" que "), "file_name ASC NULLS LAST, id", "LIMIT 10 OFFSET 20",
    ),
)
def _(t):
    return search(t.docs, SearchParams(keyword="que", sort_by="filename", sort_order="asc", page=3, per_page=10))


@query(
    "search_page_info",
    "SELECT 3 AS page, 10 AS per_page, ceil(count(*) / 10.0)::BIGINT AS total_pages, 3 < ceil(count(*) / 10.0) AS has_next, "
    f"true AS has_prev, count(*) AS total_results FROM {_T} WHERE contains(tok, ' que ')",
)
def _(t):
    return search_info(t.docs, SearchParams(keyword="que", page=3, per_page=10))


@query(
    "search_filtered",
    _result(
        f"(SELECT * FROM {_T} WHERE contains(tok, ' the ') AND source = 'src7' AND conversion_type IN (1, 3, 8)) m",
        ["the"], _occ(" the "), "file_modified_time ASC NULLS LAST, id", "LIMIT 20",
    ),
)
def _(t):
    p = SearchParams(keyword="the", source="src7", conversion_types=[1, 3, 8], sort_by="mtime", sort_order="asc")
    return search(t.docs, p)


_BOOL = f"SELECT id, ({{score}})::DOUBLE AS score FROM {_T} WHERE "


def _bool(where: str, *terms: str) -> str:
    score = " + ".join(_occ(x) for x in terms) or "0"
    return f"SELECT id, ({score})::DOUBLE AS score FROM {_T} WHERE {where}"


def _found(t, keyword):
    return matches(t.docs, SearchParams(keyword=keyword)).select("id", "score")


@query("search_bool_and", _bool("contains(tok, ' the ') AND contains(tok, ' with ')", " the ", " with "))
def _(t):
    return _found(t, "the with")


@query("search_bool_or", _bool("contains(tok, ' und ') OR contains(tok, ' que ')", " und ", " que "))
def _(t):
    return _found(t, "und OR que")


@query("search_bool_not", _bool("contains(tok, ' the ') AND NOT contains(tok, ' with ')", " the "))
def _(t):
    return _found(t, "The -with")


@query(
    "search_phrase",
    f"SELECT id, count(*)::DOUBLE AS score FROM (SELECT id, w[i] AS a, w[i + 1] AS b FROM "
    f"(SELECT id, w, unnest(range(1, len(w))) AS i FROM (SELECT id, string_split(trim(tok), '  ') AS w FROM {_T}) x) y) z "
    "WHERE a = 'of' AND b = 'the' GROUP BY id",
)
def _(t):
    return _found(t, '"of the"')


@query("search_prefix", _bool("contains(tok, ' thi')", " thi"))
def _(t):
    return _found(t, "thi*")


@query(
    "search_mixed",
    _bool(
        "(contains(tok, ' of  the ') OR contains(tok, ' und ')) AND NOT contains(tok, ' with ') AND contains(tok, ' e')",
        " of  the ", " und ", " e",
    ),
)
def _(t):
    return _found(t, '"of the" OR und -with e*')


_GROUPS = "(the OR (und -que)) -(with OR \"of the\") (e* OR -(in der))"
_GROUPS_SQL = _bool(
    "(contains(tok, ' the ') OR (contains(tok, ' und ') AND NOT contains(tok, ' que '))) "
    "AND NOT (contains(tok, ' with ') OR contains(tok, ' of  the ')) "
    "AND (contains(tok, ' e') OR NOT (contains(tok, ' in ') AND contains(tok, ' der ')))",
    " the ", " und ", " e",
)


@query("search_groups", _GROUPS_SQL)
def _(t):
    return _found(t, _GROUPS)


@query(
    "search_substring",
    "SELECT id FROM {docs} WHERE status = 'completed' AND (contains(lower(markdown_content), 'in it') OR contains(lower(file_name), 'in it'))",
)
def _(t):
    return matches(t.docs, SearchParams(keyword="In It", search_type="trigram")).select("id")


@query(
    "search_highlight",
    "SELECT id, " + _mark("markdown_content", ["the", "then", "und"]) + " AS marked FROM {docs}",
)
def _(t):
    return t.docs.select("id", present.highlight(F.col("markdown_content"), "the+then und").alias("marked"))


@query("search_snippet", "SELECT id, " + _snippet(["with", "que"]) + " AS snippet FROM {docs}")
def _(t):
    return t.docs.select("id", present.snippet(F.col("markdown_content"), "with que").alias("snippet"))


def _grams(keyword: str) -> str:
    return "(" + ", ".join(f"'{g}'" for g in tokens.keyword_trigrams(keyword)) + ")"


def _similar(keyword: str, text: str) -> str:
    """Trigram similarity by words: (id, sim)."""
    n = len(tokens.keyword_trigrams(keyword))
    return f"""
        SELECT id, CASE WHEN own + {n} - shared = 0 THEN 0 ELSE shared / (own + {n} - shared) END AS sim FROM (
            SELECT d.id, count(DISTINCT g) AS own, count(DISTINCT g) FILTER (WHERE g IN {_grams(keyword)}) AS shared
            FROM {{docs}} d LEFT JOIN (
                SELECT id, unnest(list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))) AS g
                FROM (SELECT id, unnest(string_split_regex(lower({text}), '[^\\p{{{{L}}}}\\p{{{{N}}}}]+')) AS w FROM {{docs}}) x
                WHERE w <> ''
            ) y ON y.id = d.id
            GROUP BY d.id
        ) z
    """


def _trigram(keyword: str) -> str:
    return (
        f"(SELECT d.*, greatest(a.sim, b.sim) AS sim FROM {{docs}} d JOIN ({_similar(keyword, 'markdown_content')}) a ON a.id = d.id "
        f"JOIN ({_similar(keyword, 'file_name')}) b ON b.id = d.id WHERE d.status = 'completed' "
        f"AND (contains(lower(d.markdown_content), '{keyword}') OR contains(lower(d.file_name), '{keyword}'))) g"
    )


@query("search_trigram", _result(_trigram("ation"), ["ation"], "sim", "round(score, 9) DESC, id", "LIMIT 20"))
def _(t):
    return search(t.docs, SearchParams(keyword="ation", search_type="trigram"))


@query("trigram_scores", f"SELECT id, round(sim, 6) AS score FROM {_trigram('hand')}")
def _(t):
    found = matches(t.docs, SearchParams(keyword="hand", search_type="trigram"))
    return found.select("id", F.round("score", 6).alias("score"))


_WORDS = f"(SELECT id, unnest(string_split(trim(tok), '  ')) AS term FROM {_T} WHERE tok <> '') w"


@query(
    "postings",
    f"SELECT term, count(DISTINCT id) AS df, count(*) AS total, max(n) AS top_tf FROM "
    f"(SELECT term, id, count(*) OVER (PARTITION BY term, id) AS n FROM {_WORDS}) c GROUP BY term",
)
def _(t):
    made = build_postings(t.docs)
    return made.groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("total"), F.max("tf").alias("top_tf")
    )


@query(
    "postings_boolean",
    _bool(
        "(contains(tok, ' of  the ') OR contains(tok, ' und ')) AND NOT contains(tok, ' with ') AND contains(tok, ' e')",
        " of  the ", " und ", " e",
    ),
)
def _(t):
    return search_postings(build_postings(t.docs), '"of the" OR und -with e*', t.docs)


@query("postings_not", _bool("NOT contains(tok, ' the ')"))
def _(t):
    return search_postings(build_postings(t.docs), "-the", t.docs)


_BTOK = "string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')"


@query(
    "search_batch",
    f"""
    WITH q AS (SELECT DISTINCT item_id AS query_id, unnest({_BTOK}) AS term FROM {{benchmark}}),
         qt AS (SELECT query_id, term, count(*) OVER (PARTITION BY query_id) AS n FROM q WHERE term <> ''),
         tf AS (SELECT id, term, count(*) AS tf FROM {_WORDS} GROUP BY id, term)
    SELECT query_id, id, sum(tf)::DOUBLE AS score FROM qt JOIN tf USING (term)
    GROUP BY query_id, id, n HAVING count(*) = n
    """,
)
def _(t):
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    return search_batch(stage(build_postings(t.docs)), queries)


@query(
    "search_batch_top",
    f"""
    WITH q AS (SELECT DISTINCT unnest({_BTOK}) AS term FROM {{benchmark}}),
         tf AS (SELECT id, term, count(*) AS tf FROM {_WORDS} GROUP BY id, term),
         r AS (SELECT term, id, tf, row_number() OVER (PARTITION BY term ORDER BY tf DESC, id) AS n
               FROM (SELECT * FROM q WHERE term <> '') q JOIN tf USING (term))
    SELECT term AS query_id, id, tf::DOUBLE AS score FROM r WHERE n <= 20
    """,
)
def _(t):
    # Every word of the passages, common ones too, as a query of its own; a page of documents each.
    words = t.benchmark.select(F.explode(tokens.tokens(F.col("text"))).alias("text")).distinct()
    queries = words.select(F.col("text").alias("query_id"), "text")
    return search_batch(stage(build_postings(t.docs)), queries, top=20)


@query("postings_groups", _GROUPS_SQL)
def _(t):
    return search_postings(stage(build_postings(t.docs, positions=True)), _GROUPS, t.docs)


@query(
    "postings_phrase",
    f"SELECT id, count(*)::DOUBLE AS score FROM (SELECT id, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM "
    f"(SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT id, string_split(trim(tok), '  ') AS w FROM {_T}) x) y) z "
    "WHERE a = 'of' AND b = 'the' AND starts_with(c, 'th') GROUP BY id",
)
def _(t):
    # No documents are given: places alone tell phrases.
    return search_postings(stage(build_postings(t.docs, positions=True)), '"of the th*"')


# Requests over an index: full text with filters, every order, a first and a deep page; similarity.
_REQUESTS = [
    (SearchParams(keyword="the with"), _result(
        f"(SELECT * FROM {_T} WHERE contains(tok, ' the ') AND contains(tok, ' with ')) m",
        ["the", "with"], f"{_occ(' the ')} + {_occ(' with ')}", "score DESC, id", "LIMIT 20")),
    (SearchParams(keyword="que", sort_by="filename", sort_order="asc", page=3, per_page=10), _result(
        f"(SELECT * FROM {_T} WHERE contains(tok, ' que ')) m", ["que"], _occ(" que "), "file_name ASC NULLS LAST, id", "LIMIT 10 OFFSET 20")),
    (SearchParams(keyword="the", sort_by="filename", sort_order="desc", page=7, per_page=15), _result(
        f"(SELECT * FROM {_T} WHERE contains(tok, ' the ')) m", ["the"], _occ(" the "), "file_name DESC NULLS FIRST, id", "LIMIT 15 OFFSET 90")),
    (SearchParams(keyword="the", source="src7", conversion_types=[1, 3, 8], sort_by="mtime", sort_order="asc"), _result(
        f"(SELECT * FROM {_T} WHERE contains(tok, ' the ') AND source = 'src7' AND conversion_type IN (1, 3, 8)) m",
        ["the"], _occ(" the "), "file_modified_time ASC NULLS LAST, id", "LIMIT 20")),
    (SearchParams(keyword="und", file_types=["PDF", "md"], date_from="2024-01-01 00:30:00", sort_by="mtime"), _result(
        f"(SELECT * FROM {_T} WHERE contains(tok, ' und ') AND lower(file_type) IN ('pdf', 'md') "
        "AND file_modified_time >= TIMESTAMP '2024-01-01 00:30:00') m",
        ["und"], _occ(" und "), "file_modified_time DESC NULLS FIRST, id", "LIMIT 20")),
    (SearchParams(keyword="ation", search_type="trigram", page=2), _result(
        _trigram("ation"), ["ation"], "sim", "round(score, 9) DESC, id", "LIMIT 20 OFFSET 20")),
]


def _indexed(t):
    docs = stage(t.docs.repartitionByRange("id").sortWithinPartitions("id"))
    return CorpusIndex(stage(build_postings(docs, positions=True)), stage(build_trigrams(docs))), docs


@query("search_page_indexed", " UNION ALL ".join(f"SELECT {i} AS request, * FROM ({sql}) r{i}" for i, (_, sql) in enumerate(_REQUESTS)))
def _(t):
    index, docs = _indexed(t)
    pages = [search_indexed(index, docs, p).select(F.lit(i).alias("request"), "*") for i, (p, _) in enumerate(_REQUESTS)]
    found = pages[0]
    for page in pages[1:]:
        found = found.unionByName(page)
    return found


@query(
    "search_info_indexed",
    "SELECT 3 AS page, 10 AS per_page, ceil(count(*) / 10.0)::BIGINT AS total_pages, 3 < ceil(count(*) / 10.0) AS has_next, "
    f"true AS has_prev, count(*) AS total_results FROM {_T} WHERE contains(tok, ' que ')",
)
def _(t):
    return search_info_indexed(CorpusIndex(stage(build_postings(t.docs))), t.docs, SearchParams(keyword="que", page=3, per_page=10))


_SUBSTRINGS = ["in it", "and th", ". The", "hand", "e", "erheth"]


@query(
    "substring_indexed",
    " UNION ALL ".join(
        f"SELECT '{k}' AS keyword, id FROM {{docs}} WHERE status = 'completed' AND (contains(lower(markdown_content), lower('{k}')) "
        f"OR contains(lower(file_name), lower('{k}')))"
        for k in _SUBSTRINGS
    ),
)
def _(t):
    index = CorpusIndex(trigrams=stage(build_trigrams(t.docs)))
    found = None
    for k in _SUBSTRINGS:  # the single letter has no trigram and is looked for in all texts
        ids = indexed_matches(index, t.docs, SearchParams(keyword=k, search_type="trigram")).select(F.lit(k).alias("keyword"), "id")
        found = ids if found is None else found.unionByName(ids)
    return found


@query("trigram_indexed", f"SELECT id, round(sim, 6) AS score FROM {_trigram('hand')}")
def _(t):
    index = CorpusIndex(trigrams=stage(build_trigrams(t.docs)))
    found = indexed_matches(index, t.docs, SearchParams(keyword="hand", search_type="trigram"))
    return found.select("id", F.round("score", 6).alias("score"))


# Documents after a batch that adds, changes and fails some, and a delete.
_LATER = f"""
    (SELECT id, {_TOK} AS tok FROM (
        SELECT d.id, CASE WHEN b.success THEN b.markdown_content ELSE d.markdown_content END AS markdown_content,
               CASE WHEN b.success THEN 'completed' WHEN b.success IS NOT NULL THEN 'failed' ELSE d.status END AS status
        FROM {{docs}} d LEFT JOIN {{batch}} b ON lower(b.file_path) = lower(d.file_path) WHERE d.source <> 'src2'
        UNION ALL
        SELECT b.id, b.markdown_content, CASE WHEN b.success THEN 'completed' ELSE 'failed' END
        FROM {{batch}} b WHERE NOT EXISTS (SELECT 1 FROM {{docs}} d WHERE lower(d.file_path) = lower(b.file_path))
    ) m WHERE status = 'completed') t"""


def _followed(t):
    """An index of the documents that has followed a merge and a delete."""
    index = IndexStore(t.spark, fresh_dir(t.spark, "index"))
    # The batch is most of the corpus, so it is joined once; before there is an index, as the join takes most disk.
    with staged(merge_documents(t.docs, t.batch, RUN_TS, one_join="full"), compression="zstd") as merged:
        index.build(t.docs, RUN_TS)
        index.update(merged, t.batch, RUN_TS)
        gone = t.docs.filter(F.col("source") == "src2").select("id")
        index.update(IdSet(gone).join(merged, "left_anti"), gone, RUN_TS)
    return index


@query(
    "postings_after_merge",
    f"SELECT term, count(DISTINCT id) AS df, count(*) AS total, sum(id)::BIGINT AS ids FROM "
    f"(SELECT id, unnest(string_split(trim(tok), '  ')) AS term FROM {_LATER} WHERE tok <> '') w GROUP BY term",
)
def _(t):
    index = _followed(t).index()
    return index.postings.groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("total"), F.sum(F.col("id") * F.col("tf")).alias("ids")
    )


@query("postings_compacted", f"SELECT id, {_occ(' the ')}::DOUBLE AS score FROM {_LATER} WHERE contains(tok, ' the ') AND NOT contains(tok, ' with ')")
def _(t):
    index = _followed(t)
    index.compact(RUN_TS)
    index.vacuum()
    return search_postings(index.index().postings, "the -with")
