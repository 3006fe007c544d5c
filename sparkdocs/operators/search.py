"""Corpus search: parameters, filters, scores, order, pages and result rows."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdocs.functions import present, tokens
from sparkdocs.functions.text import iso_time
from sparkdocs.schemas import DEFAULT_PER_PAGE

SORTS = ("relevance", "filename", "mtime")
ORDERS = ("asc", "desc")
KINDS = ("full_text", "trigram")


@dataclass(frozen=True)
class SearchParams:
    keyword: str | None = None
    search_type: str = "full_text"
    sort_by: str = "relevance"
    sort_order: str = "desc"
    page: int = 1
    per_page: int = DEFAULT_PER_PAGE
    file_types: list[str] | None = None
    date_from: str | None = None
    date_to: str | None = None
    source: str | None = None
    conversion_types: list[int] | None = None
    like_wildcards: bool = False

    def normalized(self) -> SearchParams:
        def positive(value, default):
            return value if isinstance(value, int) and value > 0 else default

        return replace(
            self,
            search_type=self.search_type if self.search_type in KINDS else "full_text",
            sort_by=self.sort_by if self.sort_by in SORTS else "relevance",
            sort_order=self.sort_order if self.sort_order in ORDERS else "desc",
            page=positive(self.page, 1),
            per_page=positive(self.per_page, DEFAULT_PER_PAGE),
        )

    @classmethod
    def from_args(cls, args: Mapping) -> SearchParams:
        """Parameters from a request's string arguments; unusable values fall back to defaults."""

        def number(name, default):
            try:
                return int(args.get(name, default))
            except (TypeError, ValueError):
                return default

        def entries(name):
            return [part.strip() for part in str(args.get(name) or "").split(",") if part.strip()]

        types = [t.lower() for t in entries("file_types")]
        codes = [int(c) for c in entries("conversion_types") if c.isdigit()]
        return cls(
            keyword=args.get("keyword"),
            search_type=args.get("search_type", "full_text"),
            sort_by=args.get("sort_by", "relevance"),
            sort_order=str(args.get("sort_order", "desc")).lower(),
            page=number("page", 1),
            per_page=number("per_page", DEFAULT_PER_PAGE),
            file_types=types or None,
            date_from=args.get("date_from"),
            date_to=args.get("date_to"),
            source=args.get("source"),
            conversion_types=codes or None,
        ).normalized()


# --- predicates ---


def substring_match(text: Column, keyword: str, like_wildcards: bool = False) -> Column:
    """Case-insensitive substring; `%` and `_` are plain characters unless asked for."""
    if like_wildcards:
        return text.ilike(f"%{keyword}%")
    return F.contains(F.lower(text), F.lower(F.lit(keyword)))


def _word(line: str, at: int) -> tuple[str, int]:
    """Characters up to a blank or a bracket that closes a group; brackets inside a word belong to it."""
    end, opened = at, 0
    while end < len(line) and not line[end].isspace():
        if line[end] == ")" and not opened:
            break
        opened += {"(": 1, ")": -1}.get(line[end], 0)
        end += 1
    return line[at:end], end


def _read_group(line: str, at: int, inside: bool) -> tuple[list, int]:
    """Clauses from `at` to the end of the line or of the group, and the place behind it."""
    clauses, joiner = [], "and"
    while True:
        while at < len(line) and line[at].isspace():
            at += 1
        if at == len(line) or line[at] == ")":
            if inside != (at < len(line)):
                raise ValueError(f"unbalanced parentheses: {line!r}")
            return clauses, at + 1
        minus = line[at] == "-" and line[at + 1 : at + 2] in ("(", '"')
        start = at + minus
        if line[start] == "(":
            item, at = _read_group(line, start + 1, True)
            negated, useful = minus, bool(item)
        elif line[start] == '"' and '"' in line[start + 1 :]:
            end = line.index('"', start + 1)
            negated, item, at = minus, line[start + 1 : end], end + 1
            useful = tokens.has_tokens(item)
        else:
            item, at = _word(line, at)
            if item == "OR":
                joiner = "or"
                continue
            negated = item.startswith("-") and len(item) > 1
            item = item[1:] if negated else item
            useful = tokens.has_tokens(item)
        if useful:
            clauses.append((joiner, negated, item))
            joiner = "and"


def query_clauses(keyword: str) -> list[tuple]:
    """(`and`/`or`, negated, term or clauses of a group) in reading order.

    Words are joined by AND, `OR` joins its two neighbours, `-` negates, quotes make a phrase, `*` a
    prefix, parentheses a group, which may be nested and negated. Terms without a letter or digit and
    groups without a term are left out. Unbalanced parentheses raise an error.
    """
    return _read_group(keyword, 0, False)[0]


def query_leaves(clauses: list[tuple], negated: bool = False) -> list[tuple[bool, str]]:
    """(negated, term) of all terms in reading order; a minus on a group counts for all in it."""
    found = []
    for _, minus, item in clauses:
        sign = negated != minus
        found += query_leaves(item, sign) if isinstance(item, list) else [(sign, item)]
    return found


def _needle(term: str) -> Column:
    """Form of a term inside a token string; a prefix has an open end."""
    words = F.trim(tokens.token_string(F.lit(term)))
    tail = "" if term.endswith("*") else " "
    return F.concat(F.lit(" "), words, F.lit(tail))


def _holds(text: Column, token_str: Column | None, term: str) -> Column:
    if token_str is None:
        return tokens.matches_term(text, term)
    return F.contains(token_str, _needle(term))


def _count(text: Column, token_str: Column | None, term: str) -> Column:
    if token_str is None:
        return tokens.count_term(text, term)
    needle = _needle(term)
    return F.when(
        F.contains(needle, F.lit("  ")), tokens.phrase_occurrences(token_str, needle)
    ).otherwise(tokens.occurrences(token_str, needle))


def fold_clauses(tests, clauses: list[tuple]):
    """Join the tests of all terms from left to right, group by group; columns or plain truth values."""
    left, found = iter(tests), None
    for joiner, negated, item in clauses:
        test = fold_clauses(left, item) if isinstance(item, list) else next(left)
        if negated:
            test = (not test) if isinstance(test, bool) else ~test
        if found is None:
            found = test
        else:
            found = (found | test) if joiner == "or" else (found & test)
    return found


def boolean_match(text: Column, keyword: str, token_str: Column | None = None) -> Column:
    """Full-text predicate of a web-style keyword line; `token_str` is used where it is stored."""
    clauses = query_clauses(keyword)
    if not clauses:
        return F.lit(False)
    return fold_clauses([_holds(text, token_str, term) for _, term in query_leaves(clauses)], clauses)


def term_score(text: Column, keyword: str, token_str: Column | None = None) -> Column:
    """Occurrences of all terms that are not negated."""
    score = F.lit(0).cast("long")
    for negated, term in query_leaves(query_clauses(keyword)):
        if not negated:
            score = score + _count(text, token_str, term)
    return score.cast("double")


def filters(docs: DataFrame, p: SearchParams) -> DataFrame:
    out = docs.filter(F.col("status") == "completed")
    if p.file_types:
        out = out.filter(F.lower("file_type").isin([t.lower() for t in p.file_types]))
    if p.conversion_types:
        out = out.filter(F.col("conversion_type").isin(p.conversion_types))
    if p.date_from:
        out = out.filter(F.col("file_modified_time") >= F.lit(p.date_from).cast("timestamp"))
    if p.date_to:
        out = out.filter(F.col("file_modified_time") <= F.lit(p.date_to).cast("timestamp"))
    if p.source:
        out = out.filter(F.col("source") == p.source)
    return out


def with_search_columns(docs: DataFrame) -> DataFrame:
    """Store what a search would compute per text: the token string and the trigram counts."""
    return docs.withColumns({
        "token_str": tokens.token_string(F.col("markdown_content")),
        "content_trigrams": tokens.trigram_count(F.col("markdown_content")),
    })


def matches(docs: DataFrame, p: SearchParams) -> DataFrame:
    """Matching documents with a `score` column (null without a keyword)."""
    p = p.normalized()
    stored = set(docs.columns)
    out = filters(docs, p)
    content, name = F.col("markdown_content"), F.col("file_name")
    if not p.keyword:
        return out.withColumn("score", F.lit(None).cast("double"))
    if p.search_type == "full_text":
        token_str = F.col("token_str") if "token_str" in stored else None
        found = out.filter(boolean_match(content, p.keyword, token_str))
        return found.withColumn("score", term_score(content, p.keyword, token_str))
    found = out.filter(
        substring_match(content, p.keyword, p.like_wildcards)
        | substring_match(name, p.keyword, p.like_wildcards)
    )
    count = F.col("content_trigrams") if "content_trigrams" in stored else None
    return found.withColumn(
        "score",
        F.greatest(
            tokens.trigram_similarity(content, p.keyword, count),
            tokens.trigram_similarity(name, p.keyword),
        ),
    )


def sort_keys(p: SearchParams) -> list[Column]:
    """Relevance is always descending; nulls sort as the largest value; ties go by id."""
    p = p.normalized()
    ascending = p.sort_order == "asc"
    if p.sort_by == "relevance" and p.keyword:
        key = F.desc_nulls_last("score")
    elif p.sort_by == "filename":
        key = F.asc_nulls_last("file_name") if ascending else F.desc_nulls_first("file_name")
    elif p.sort_by == "mtime" and ascending:
        key = F.asc_nulls_last("file_modified_time")
    else:
        key = F.desc_nulls_first("file_modified_time")
    return [key, F.asc("id")]


def page_of(found: DataFrame, keys: list[Column], page: int, per_page: int) -> DataFrame:
    return found.orderBy(*keys).offset((page - 1) * per_page).limit(per_page)


def result_rows(rows: DataFrame, keyword: str | None) -> DataFrame:
    return rows.select(
        "id",
        present.highlight(F.col("file_name"), keyword).alias("filename"),
        F.col("file_path").alias("filepath"),
        F.col("file_type").alias("filetype"),
        F.col("file_size").alias("filesize"),
        iso_time(F.col("file_modified_time")).alias("file_modified_time"),
        present.snippet(F.col("markdown_content"), keyword).alias("snippet"),
        "source",
        "source_url",
        F.round("score", 3).alias("relevance"),
    )


def search(docs: DataFrame, params: SearchParams) -> DataFrame:
    """One page of results; snippets and highlights are made for that page only."""
    p = params.normalized()
    found = matches(docs, p).select(
        "id", "file_name", "file_path", "file_type", "file_size", "file_modified_time",
        "markdown_content", "source", "source_url", "score",
    )
    return result_rows(page_of(found, sort_keys(p), p.page, p.per_page), p.keyword)


def page_info(found: DataFrame, p: SearchParams) -> DataFrame:
    """Pagination of matching documents as one row."""
    counted = found.agg(F.count("*").alias("total_results"))
    pages = F.ceil(F.col("total_results") / p.per_page)
    return counted.select(
        F.lit(p.page).cast("long").alias("page"),
        F.lit(p.per_page).cast("long").alias("per_page"),
        pages.alias("total_pages"),
        (F.lit(p.page) < pages).alias("has_next"),
        F.lit(p.page > 1).alias("has_prev"),
        "total_results",
    )


def search_info(docs: DataFrame, params: SearchParams) -> DataFrame:
    """Pagination of a search as one row."""
    p = params.normalized()
    return page_info(matches(docs, p), p)
