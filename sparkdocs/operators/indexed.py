"""Search requests answered from index tables: a text is read only where a row of the page needs it.

Full text works on postings; substrings and similarity on a table of trigrams, whose documents are
checked exactly afterwards. Filters and order work on narrow columns of the documents. Texts are fetched
by id for the rows of the page alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdocs.functions import tokens
from sparkdocs.operators.blocks import BLOCKS, DRAWN, Rows, block_batch, distinct, row_batches, write_sorted
from sparkdocs.operators.fulltext import placed_rows, search_postings
from sparkdocs.operators.search import (
    SearchParams, filters, matches, page_info, page_of, result_rows, sort_keys,
)
from sparkdocs.operators.sizes import keyed_join

# Trigrams of a keyword that are read: the rarest ones.
READ_TRIGRAMS = 4


@dataclass(frozen=True)
class CorpusIndex:
    """Index tables of the completed documents; each may be left out if its kind of search is not asked for.

    `ids` has the documents with a text. Only lines that accept documents without any of their terms need
    it; where it is left out, they read which texts are null.
    """

    postings: DataFrame | None = None
    trigrams: DataFrame | None = None
    ids: DataFrame | None = None


# Documents, about how many bytes of words, and pairs of document and trigram that a task takes at a time.
_DOCS, _BYTES, _PAIRS = 500, 6_000_000, 1_000_000


def gram_rows(ids: np.ndarray, padded: pa.StringArray) -> Rows:
    """Distinct trigrams of documents by (gram, id), from their padded words: those of the distinct words."""
    n = max(1, len(ids))
    cells = pc.split_pattern(padded, " ")
    coded = cells.flatten().dictionary_encode()
    # Windows of three code points as numbers, which are ordered as the strings are; none for the empty word.
    lengths = pc.utf8_length(coded.dictionary).to_numpy().astype(np.int64)
    sizes = np.where(lengths > 0, lengths + 1, 0)
    text = "".join(f"  {word} " for word in coded.dictionary.to_pylist() if word)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    first = np.arange(sizes.sum()) + np.repeat(2 * (np.cumsum(sizes > 0) - (sizes > 0)), sizes)
    grams = (points[first] << 42) | (points[first + 1] << 21) | points[first + 2]
    known, flat = np.unique(grams, return_inverse=True)
    names = [chr(g >> 42) + chr(g >> 21 & 0x1FFFFF) + chr(g & 0x1FFFFF) for g in known.tolist()]
    by = np.argsort(ids, kind="stable")
    turn = np.empty(len(ids), np.int64)
    turn[by] = np.arange(len(ids))
    doc = np.repeat(turn, pc.list_value_length(cells).to_numpy())
    words = max(1, len(sizes))
    doc, word = np.divmod(distinct([doc * words + coded.indices.to_numpy()], n * words), words)
    # The trigrams of each word of each document, then once each.
    held, starts = sizes[word], np.cumsum(sizes) - sizes
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(held) // _PAIRS)) + 1).tolist(), len(held)]

    def pairs(some: slice) -> np.ndarray:
        many = held[some]
        inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return flat[np.repeat(starts[word[some]], many) + inside] * n + np.repeat(doc[some], many)

    gram, doc = np.divmod(distinct(map(pairs, map(slice, cuts, cuts[1:])), len(names) * n), n)
    return Rows(pa.array(names, pa.string()), np.bincount(gram, minlength=len(names)), ids[by][doc])


def _word_trigrams(batches):
    """Distinct trigrams of Arrow batches (id, padded words)."""
    for whole in batches:
        for batch in (whole.slice(i, _DOCS) for i in range(0, whole.num_rows, _DOCS)):
            for made in row_batches(gram_rows(np.arange(batch.num_rows), batch.column(1)), ["gram", "id"]):
                yield made.set_column(1, "id", batch.column(0).take(made.column(1)))


def build_trigrams(docs: DataFrame) -> DataFrame:
    """(gram, id): the distinct trigrams of text and file name of completed documents."""
    both = F.concat(*[tokens.word_string(F.coalesce(F.col(c), F.lit(""))) for c in ("markdown_content", "file_name")])
    done = docs.filter(F.col("status") == "completed").select(F.col("id").cast("long"), both.alias("words"))
    return done.mapInArrow(_word_trigrams, "gram string, id long")


def write_trigrams(trigrams: DataFrame, path: str, partitions: int | None = None) -> None:
    """Store trigrams in ranges of (gram, id), so that a gram filter skips files and row groups."""
    write_sorted(trigrams.select("gram", F.col("id").cast("long").alias("id")), path, partitions)


def _index_blocks(batches):
    """Rows of `index_blocks` from Arrow batches (id, placed tokens of CJK texts, padded words, those of the name, has a text)."""
    kinds = pa.schema([("kind", pa.string()), ("n", pa.int64()), ("drawn", DRAWN), ("block", pa.binary()),
                       ("ids", pa.list_(pa.int64())), ("texts", pa.list_(pa.bool_()))])
    none = [pa.nulls(1, f.type) for f in kinds]
    for whole in batches:
        share = np.cumsum(pc.binary_length(whole.column(2)).to_numpy(), dtype=np.int64) // _BYTES
        cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), whole.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            batch = whole.slice(start, end - start)
            ids, words = batch.column(0).to_numpy(), batch.column(2)
            # A text without CJK runs has its words as tokens; one without words has an empty one, which is left out.
            placed = pc.split_pattern(pc.utf8_trim(words, " "), "  ")
            if batch.column(1).null_count < len(ids):
                placed = pc.coalesce(batch.column(1).cast(placed.type), placed)
            pieces = placed_rows(ids, placed), gram_rows(ids, pc.binary_join_element_wise(words, batch.column(3), ""))
            for kind, rows in zip(("postings", "trigrams"), pieces):
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array([kind]), *block_batch(rows).columns, *none[4:]], schema=kinds)
            if len(ids):
                lists = [pa.ListArray.from_arrays([0, len(ids)], pa.concat_arrays([batch.column(i)])) for i in (0, 4)]
                yield pa.RecordBatch.from_arrays([pa.array(["ids"]), *none[1:4], *lists], schema=kinds)


def index_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of the postings with places and of the trigrams of completed documents, and their ids, in one pass.

    They hold the rows of `build_postings` and `build_trigrams`; see `blocks`. Rows without an id are left out.
    """
    done = docs.filter((F.col("status") == "completed") & F.col("id").isNotNull())
    text, name = (F.coalesce(F.col(c), F.lit("")) for c in ("markdown_content", "file_name"))
    words = done.select(
        F.col("id").cast("long"), F.when(tokens.has_cjk(text), tokens.placed_tokens(text)).alias("placed"),
        tokens.word_string(text).alias("words"), tokens.word_string(name).alias("name"), F.col("markdown_content").isNotNull().alias("has_text"),
    )
    return words.mapInArrow(_index_blocks, f"kind string, {BLOCKS}, ids array<long>, texts array<boolean>")


def needed_trigrams(keyword: str) -> list[str]:
    """Trigrams that every text with the lower-cased keyword as a substring holds.

    Words are padded with two blanks before and one after; a word at an edge of the keyword may go on
    there, so its padding counts only on the other side.
    """
    grams = set()
    for run in re.finditer(r"[^\W_]+", keyword):
        padded = ("  " if run.start() else "") + run.group() + (" " if run.end() < len(keyword) else "")
        grams.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return sorted(grams)


def trigram_candidates(trigrams: DataFrame, keyword: str) -> DataFrame | None:
    """Ids of documents with the rarest trigrams of a keyword; null if it is too short to have any."""
    low = trigrams.sparkSession.range(1).select(F.lower(F.lit(keyword))).first()[0]
    grams = needed_trigrams(low)
    if not grams:
        return None
    hits = trigrams.filter(F.col("gram").isin(grams))
    sizes = {r.gram: r.n for r in hits.groupBy("gram").agg(F.count("*").alias("n")).collect()}  # a few rows
    rarest = sorted(grams, key=lambda g: (sizes.get(g, 0), g))[:READ_TRIGRAMS]
    counted = trigrams.filter(F.col("gram").isin(rarest)).groupBy("id").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") == len(rarest)).select("id")


def indexed_matches(index: CorpusIndex, docs: DataFrame, params: SearchParams) -> DataFrame:
    """(id, score, file_name, file_modified_time) of the matching documents, as `matches` finds them."""
    p = params.normalized()
    narrow = ["id", "file_name", "file_modified_time"]
    if not p.keyword:
        return filters(docs, p).select(*narrow, F.lit(None).cast("double").alias("score"))
    if p.search_type == "full_text":
        if index.postings is None:
            raise ValueError("a full-text search needs postings")
        found = search_postings(index.postings, p.keyword, docs, index.ids)
        return filters(docs, p).select(*narrow).join(found, "id")
    if index.trigrams is None:
        raise ValueError("a substring search needs trigrams")
    candidates = None if p.like_wildcards else trigram_candidates(index.trigrams, p.keyword)
    # A keyword without a trigram of its own is looked for in all texts.
    checked = docs if candidates is None else keyed_join(docs, candidates, ["id"])
    return matches(checked, p).select(*narrow, "score")


def search_indexed(index: CorpusIndex, docs: DataFrame, params: SearchParams) -> DataFrame:
    """One page of results, equal to that of `search`.

    The page is found first, as at most `per_page` ids; their rows are then read by id, which reaches the
    Parquet scan as a filter: store documents in the order of their ids.
    """
    p = params.normalized()
    page = page_of(indexed_matches(index, docs, p), sort_keys(p), p.page, p.per_page).collect()
    spark = docs.sparkSession
    places = spark.createDataFrame([(i, r.id, r.score) for i, r in enumerate(page)], "place int, id long, score double")
    rows = docs.filter(F.col("id").isin([r.id for r in page])).join(F.broadcast(places), "id")
    return result_rows(rows.orderBy("place"), p.keyword)


def search_info_indexed(index: CorpusIndex, docs: DataFrame, params: SearchParams) -> DataFrame:
    """Pagination of a search as one row."""
    return page_info(indexed_matches(index, docs, params), params.normalized())
