"""Full-text search over stored postings: one keyword line, or a whole table of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdocs.functions import tokens
from sparkdocs.operators.blocks import Rows, row_batches, write_sorted
from sparkdocs.operators.search import fold_clauses, query_clauses, query_leaves
from sparkdocs.operators.sizes import keyed_join, top_per_group
from sparkdocs.session import cut_lineage, stage


# Documents that a task counts at a time.
_DOCS = 500


def placed_rows(ids: np.ndarray, words: pa.ListArray) -> Rows:
    """Postings of documents by (term, id); a document's words are all in its cell."""
    n = max(1, len(ids))
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    coded = words.flatten().dictionary_encode()
    terms = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(terms), np.int64)
    rank[terms] = np.arange(len(terms))
    code, doc = coded.indices.to_numpy(), np.repeat(np.arange(len(ids)), lengths)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    kept = ~pc.is_in(coded.dictionary, pa.array([tokens.RUN_START, ""])).to_numpy(zero_copy_only=False)[code]
    by = np.argsort(ids, kind="stable")
    turn = np.empty(len(ids), np.int64)
    turn[by] = np.arange(len(ids))
    key = (rank[code] * n + turn[doc])[kept]
    order = np.argsort(key, kind="stable")  # places stay ascending
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    term, doc = np.divmod(key[first], n)
    tf, sizes = np.diff(np.append(first, len(order))), np.bincount(term, minlength=len(terms))
    held = np.flatnonzero(sizes)
    return Rows(coded.dictionary.take(pa.array(terms[held])), sizes[held], ids[by][doc], tf, tf, place[kept][order].astype(np.int32))


def _placed(batches):
    """Postings of Arrow batches (id, words)."""
    for whole in batches:
        for batch in (whole.slice(i, _DOCS) for i in range(0, whole.num_rows, _DOCS)):
            rows = placed_rows(np.arange(batch.num_rows), batch.column(1))
            for made in row_batches(rows, ["term", "id", "tf", "positions"]):
                yield made.set_column(1, "id", batch.column(0).take(made.column(1)))


def build_postings(docs: DataFrame, positions: bool = False) -> DataFrame:
    """(term, id, tf) of completed documents; with `positions` also the sorted places of the term.

    A document's tokens leave its row in one task, so the map-side half of the count already brings
    them together and the shuffle moves one row per document and term. With places the rows are made
    in the task without a shuffle; ids are unique, as in a store. Places count the start of a CJK
    run as one, so that two terms are neighbours in the text if their places are.
    """
    done = docs.filter(F.col("status") == "completed")
    if not positions:
        words = done.select("id", F.explode(tokens.tokens(F.col("markdown_content"))).alias("term"))
        return words.groupBy("term", "id").agg(F.count("*").alias("tf"))
    words = done.select(F.col("id").cast("long"), tokens.placed_tokens(F.col("markdown_content")).alias("words"))
    return words.mapInArrow(_placed, "term string, id long, tf long, positions array<int>")


def write_postings(postings: DataFrame, path: str, partitions: int | None = None) -> None:
    """Store postings ordered by term, so that a term filter skips files and row groups.

    Ranges of (term, id) split a term that half of all documents hold over several files. The rows travel
    as sorted blocks; `partitions` asks for at least so many ranges if there are rows for them. Every row has an id.
    """
    more = [F.col("tf").cast("long").alias("tf")] + [F.col(c) for c in postings.columns if c == "positions"]
    write_sorted(postings.select("term", F.col("id").cast("long").alias("id"), *more), path, partitions)


def _token_lists(spark: SparkSession, terms: list[str]) -> list[list[tuple[int, str]]]:
    """(offset, token) of a query's few terms, by the same expression that cut the texts."""
    row = spark.range(1).select(*[tokens.placed_tokens(F.lit(t)).alias(f"t{i}") for i, t in enumerate(terms)])
    lists = []
    for cell in row.first():
        # A phrase may begin inside a CJK run.
        words = list(cell)[1:] if cell[0] == tokens.RUN_START else list(cell)
        lists.append([(i, w) for i, w in enumerate(words) if w != tokens.RUN_START])
    return lists


def searchable_ids(docs: DataFrame) -> DataFrame:
    """Ids of completed documents with a text: those that a line of negated terms may accept."""
    done = docs.filter(F.col("status") == "completed")
    return (done.filter(F.col("markdown_content").isNotNull()) if "markdown_content" in docs.columns else done).select("id")


def search_postings(
    postings: DataFrame, keyword: str, docs: DataFrame | None = None, ids: DataFrame | None = None
) -> DataFrame:
    """(id, score) of the documents a keyword line selects; see `query_clauses` for its form.

    Only postings of the line's terms are read. A term of several tokens needs them at neighbouring
    places: postings with `positions` tell that by themselves; without, the texts of those documents
    that hold all of them are read. A line that accepts documents without any of its terms needs all ids.
    The first needs `docs`, the documents the postings were built from, the second those or their
    `ids` (see `searchable_ids`).
    """
    clauses = query_clauses(keyword)
    if not clauses:
        return postings.select("id", F.lit(0.0).alias("score")).limit(0)
    leaves = query_leaves(clauses)
    lists = _token_lists(postings.sparkSession, [term for _, term in leaves])
    phrases = {i for i, words in enumerate(lists) if len(words) > 1}
    placed = "positions" in postings.columns
    negative = fold_clauses([False] * len(leaves), clauses)
    if docs is None and ((negative and ids is None) or (phrases and not placed)):
        raise ValueError("phrases without positions, and lines that accept documents without their terms, need the documents")

    def hit(word: str, prefix: bool) -> Column:
        return F.col("term").startswith(word) if prefix else F.col("term") == word

    wanted, aggregates, counts = F.lit(False), [], []
    for i, ((_, term), words) in enumerate(zip(leaves, lists)):
        hits = [hit(w, term.endswith("*") and k == len(words) - 1) for k, (_, w) in enumerate(words)]
        for h in hits:
            wanted = wanted | h
        if placed and i in phrases:
            for k, h in enumerate(hits):
                aggregates.append(F.flatten(F.collect_list(F.when(h, F.col("positions")))).alias(f"n{i}_{k}"))
            counts.append(_neighbours([f"n{i}_{k}" for k in range(len(hits))], [at for at, _ in words]))
            continue
        # For a phrase: the least count of its tokens, an upper bound.
        sums = [F.coalesce(F.sum(F.when(h, F.col("tf"))), F.lit(0)) for h in hits]
        aggregates.append((sums[0] if len(sums) == 1 else F.least(*sums)).alias(f"n{i}"))
        counts.append(F.col(f"n{i}"))
    per_doc = postings.filter(wanted).groupBy("id").agg(*aggregates)
    per_doc = per_doc.select("id", *[c.cast("long").alias(f"n{i}") for i, c in enumerate(counts)])
    if docs is not None:
        docs = docs.filter(F.col("status") == "completed")
    if negative:
        per_doc = (searchable_ids(docs) if ids is None else ids).join(per_doc, "id", "left").fillna(0)
    counts = [F.col(f"n{i}") for i in range(len(leaves))]
    if phrases and not placed:
        # A phrase that must be absent cannot rule out a document yet.
        bounds = [F.lit(False) if i in phrases and leaves[i][0] else n > 0 for i, n in enumerate(counts)]
        per_doc = cut_lineage(per_doc.filter(fold_clauses(bounds, clauses)))
        held = per_doc.filter(F.greatest(F.lit(0), *[counts[i] for i in phrases]) > 0).select("id")
        texts = keyed_join(docs.select("id", "markdown_content"), held, ["id"])
        exact = texts.select(
            "id", *[tokens.count_term(F.col("markdown_content"), leaves[i][1]).alias(f"p{i}") for i in phrases]
        )
        per_doc = per_doc.join(exact, "id", "left")
        counts = [F.coalesce(f"p{i}", F.lit(0)) if i in phrases else n for i, n in enumerate(counts)]
    score = F.lit(0).cast("long")
    for (negated, _), n in zip(leaves, counts):
        if not negated:
            score = score + n
    found = per_doc.filter(fold_clauses([n > 0 for n in counts], clauses))
    return found.select("id", score.cast("double").alias("score"))


def _shifted(places: str, by: int) -> Column:
    return F.transform(places, lambda p: p - F.lit(by))


def _neighbours(columns: list[str], offsets: list[int]) -> Column:
    """How many places hold the first token with all others at their offsets from it."""
    starts = F.col(columns[0])
    for name, at in zip(columns[1:], offsets[1:]):
        starts = F.array_intersect(starts, _shifted(name, at - offsets[0]))
    return F.size(starts)


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct (query_id, term, n_terms) of queries (query_id, text)."""
    words = queries.select("query_id", F.array_distinct(tokens.tokens(F.col("text"))).alias("terms"))
    return words.select("query_id", F.explode("terms").alias("term"), F.size("terms").alias("n_terms"))


def search_batch(postings: DataFrame, queries: DataFrame, top: int | None = None) -> DataFrame:
    """(query_id, id, score): documents holding all words of each query, all queries in one job.

    Each query starts from the postings of its rarest word; only those documents are checked for its
    other words, by an equi-join on (term, id). With `top` each query keeps its best documents, by score
    and then by id; they are cut per salt before a query's documents meet. Without it queries of common
    words give as many rows as they have documents.
    """
    terms = query_terms(queries)
    vocabulary = terms.select("term").distinct()
    # Read three times below, so the postings of the queries' words are picked once.
    used = stage(keyed_join(postings.select("term", "id", "tf"), vocabulary, ["term"]))
    frequency = used.groupBy("term").agg(F.count("*").alias("df"))
    known = terms.join(frequency, "term")
    rarest = known.groupBy("query_id", "n_terms").agg(
        F.min_by("term", F.struct("df", "term")).alias("term"), F.count("*").alias("_known")
    )
    # One row per query, written once because the size check below reads it too.
    seeds = cut_lineage(rarest.filter(F.col("_known") == F.col("n_terms")).select("query_id", "term"))
    candidates = keyed_join(used.select("term", "id"), seeds, ["term"]).select("query_id", "id")
    checks = keyed_join(candidates, terms, ["query_id"])
    found = (
        checks.join(used, ["term", "id"])
        .groupBy("query_id", "id", "n_terms")
        .agg(F.count("*").alias("_held"), F.sum("tf").alias("_sum"))
        .filter(F.col("_held") == F.col("n_terms"))
        .select("query_id", "id", F.col("_sum").cast("double").alias("score"))
    )
    return found if top is None else top_per_group(found, ["query_id"], [F.desc("score"), F.asc("id")], top, ["id"])
