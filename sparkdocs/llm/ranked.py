"""Ranked lexical search: bundles of items pass the owners of their terms one after another.

Terms are dealt to owners. A bundle holds, for one shard of documents, the scores that a block of items
has gathered so far, only those above 0. At each stage it meets the postings that one owner has for the
shard, adds their contributions in 64-bit integers and moves on; after the last owner the best documents
of every item are picked.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdocs.operators.sizes import top_per_group
from sparkdocs.session import stage

# Stages of the pipeline, each the owner of an even share of the terms.
OWNERS = 4
# Documents and text bytes of a shard at most (a single document may be longer).
SHARD_DOCS = 2_048
SHARD_BYTES = 16_000_000
# Items and (item, term) pairs of a block, as expected sizes: blocks are dealt by hash.
BLOCK_ITEMS = 400
BLOCK_TERMS = 100_000
TOP = 50

_UPPER = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# The same split on UTF-8 bytes: a byte that no term holds becomes a blank, A-Z become small.
_BYTES = bytes(ord(chr(b).lower()) if b > 127 or chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))

_NO_OWNER = -1  # of the row that describes a shard's documents
_POSTINGS = "shard long, owner int, terms binary, docs binary, tf binary, ids array<long>, n_terms binary, held long, total long"
_BUNDLE = "shard long, ids array<long>, n_terms binary, items binary, docs binary, scores binary"
_FOUND = "item int, doc_id long, score long"


def lexical_terms(text: Column) -> Column:
    """Terms of a text in order, only A-Z lower-cased; null for a null text."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _UPPER.lower()), F.lit(TERM), F.lit(0))


def _shards(batches):
    """Arrow batches of (doc_id, text), cut to the sizes of a shard."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and (i - start == SHARD_DOCS or held + size > SHARD_BYTES):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def _index(shared):
    """Postings of the terms asked for, one row per shard and owner, and a row for the shard itself."""

    def run(batches):
        number = shared.value  # term -> number from 1
        base = TaskContext.get().partitionId() << 32
        for seq, part in enumerate(_shards(batches)):
            found, held, sizes = [], [], []
            for text in part.column(1).to_pylist():
                words = [] if text is None else text.encode("utf-8", "surrogatepass").translate(_BYTES).split()
                known = [*filter(None, map(number.get, words))]
                found += known
                held.append(len(known))
                sizes.append(len(words))
            n = part.num_rows
            keys = (np.array(found, np.int64) - 1) * n + np.repeat(np.arange(n), held)
            keys, tf = np.unique(keys, return_counts=True)
            terms, docs = (keys // n).astype(np.int32), (keys % n).astype(np.int32)
            length = np.array(sizes, np.int64)
            ids = part.column(0).to_pylist()
            rows = [(base + seq, _NO_OWNER, None, None, None, ids, length.tobytes(), int((length > 0).sum()), int(length.sum()))]
            for owner in range(OWNERS):
                own = terms % OWNERS == owner
                if own.any():
                    rows.append((base + seq, owner, terms[own].tobytes(), docs[own].tobytes(), tf[own].astype(np.int64).tobytes(), None, None, None, None))
            yield pa.RecordBatch.from_pylist([dict(zip(_names(_POSTINGS), r)) for r in rows], _arrow(_POSTINGS))

    return run


def _names(schema: str) -> list[str]:
    return [x.split(" ")[0] for x in schema.split(", ")]


_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([pa.field(name, _TYPES[kind]) for name, kind in (x.split(" ") for x in schema.split(", "))])


def _document_counts(batches):
    """(term, df) over all postings a task reads."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for cell in batch.column(0):
            counts = np.bincount(np.frombuffer(cell.as_py(), np.int32))
            wide = max(len(counts), len(total))
            total = np.pad(total, (0, wide - len(total))) + np.pad(counts, (0, wide - len(counts)))
    term = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(total[term])], ["term", "df"])


def _add(shared, n_docs: int, n_all: int):
    """One stage: a bundle and its next owner's postings of the same shard give the bundle's new scores."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = shared.value  # term number -> (item numbers, weight)
        ids, n_items = left.column("ids")[0].as_py(), asked["n_items"]
        acc = np.zeros((n_items, len(ids)), np.int64)
        items, docs, scores = (left.column(c)[0].as_py() for c in ("items", "docs", "scores"))
        if items:
            acc[np.frombuffer(items, np.int32), np.frombuffer(docs, np.int32)] = np.frombuffer(scores, np.int64)
        n_terms = left.column("n_terms")[0].as_py()
        if right.num_rows:
            length = np.frombuffer(n_terms, np.int64)
            m = 50 + (50 * length * n_docs) // n_all
            terms, doc, tf = (np.frombuffer(right.column(c)[0].as_py(), k) for c, k in (("terms", np.int32), ("docs", np.int32), ("tf", np.int64)))
            part = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
            cuts = np.flatnonzero(np.diff(terms)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(terms)]):
                who, weight = asked[int(terms[a])]
                acc[who[:, None], doc[a:b]] += weight * part[a:b]
        items, docs = np.nonzero(acc)
        row = (
            left.column("shard")[0].as_py(), ids, n_terms, items.astype(np.int32).tobytes(), docs.astype(np.int32).tobytes(),
            acc[items, docs].tobytes(),
        )
        return pa.Table.from_pylist([dict(zip(_names(_BUNDLE), row))], _arrow(_BUNDLE))

    return run


def _best(top: int):
    """Each item's best documents of all bundles that a task reads."""

    def run(batches):
        kept = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
        for batch in batches:
            for ids, items, docs, scores in zip(*(batch.column(i) for i in range(4))):
                number = ids.as_py()
                absent = np.array([x is None for x in number])
                number = np.array([x or 0 for x in number], np.int64)
                docs = np.frombuffer(docs.as_py(), np.int32)
                new = np.frombuffer(items.as_py(), np.int32).astype(np.int64), np.frombuffer(scores.as_py(), np.int64), number[docs], absent[docs]
                item, score, doc, null = (np.concatenate(x) for x in zip(kept, new))
                order = np.lexsort((doc, ~null, -score, item))
                item = item[order]
                first = np.searchsorted(item, item)
                order = order[np.arange(len(item)) - first < top]
                kept = tuple(x[order] for x in (np.concatenate((kept[0], new[0])), score, doc, null))
        item, score, doc, null = kept
        yield pa.RecordBatch.from_arrays(
            [pa.array(item.astype(np.int32)), pa.array(doc, mask=null), pa.array(score)], _names(_FOUND)
        )

    return run


def _block(docs: DataFrame, pairs: DataFrame, top: int) -> DataFrame:
    """(item_id, doc_id, score) for a block of items: at most `top` documents each."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    # A block has a bounded number of items and terms; they come to the driver to be numbered.
    rows = pairs.groupBy("item_id").agg(F.collect_set("term").alias("terms")).collect()
    number = {t: i + 1 for i, t in enumerate(sorted({t.encode() for r in rows for t in r.terms}))}
    postings = stage(docs.mapInArrow(_index(sc.broadcast(number)), _POSTINGS))
    shards = postings.filter(F.col("owner") == _NO_OWNER)
    df = postings.filter(F.col("owner") >= 0).select("terms").mapInArrow(_document_counts, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    total = shards.agg(F.sum("held").alias("docs"), F.sum("total").alias("terms")).first()
    n_docs, n_all = total["docs"] or 0, total["terms"] or 1
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1)))
    weights = {r.term: r.w for r in df.select("term", weight.alias("w")).collect()}
    held: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        for t in r.terms:
            held.setdefault(number[t.encode()] - 1, []).append(i)
    asked = {t: (np.array(who), weights[t]) for t, who in held.items() if t in weights}
    asked["n_items"] = len(rows)
    shared = sc.broadcast(asked)
    empty = F.lit(b"")
    bundles = shards.select("shard", "ids", "n_terms", empty.alias("items"), empty.alias("docs"), empty.alias("scores"))
    for owner in range(OWNERS):
        own = postings.filter(F.col("owner") == owner).select("shard", "terms", "docs", "tf")
        bundles = bundles.groupBy("shard").cogroup(own.groupBy("shard")).applyInArrow(_add(shared, n_docs, n_all), _BUNDLE)
    found = bundles.select("ids", "items", "docs", "scores").mapInArrow(_best(top), _FOUND)
    best = top_per_group(found, ["item"], [F.desc("score"), F.asc("doc_id")], top, ["doc_id"])
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item int, item_id {pairs.schema['item_id'].dataType.simpleString()}")
    return best.join(F.broadcast(names), "item").select("item_id", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's `top` documents with a score above 0, best first.

    `docs` needs doc_id and text, `items` item_id and text; other columns are not read. N documents hold a
    term, L terms in all, n in one, df hold a given term, tf times. A term weighs w = floor(1000 ln((2 N +
    2) / (2 df + 1))); with m = 50 + 50 n N div L a document scores the sum of w * (10^9 tf div (1000 tf +
    20 m)) over the item's distinct terms. Equal scores go by ascending doc_id, a null id first.

    A null or empty text has no terms: such a document is never found, such an item finds none. Rows that
    repeat an item_id are one item with the terms of all, a null item_id is an item too; every row of
    `docs` is a document, repeated ones too. Empty tables give no rows. A term above 2^31 occurrences in
    one text is beyond the integers used.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    terms = F.explode(F.array_distinct(lexical_terms(F.col("text").cast("string")))).alias("term")
    pairs = stage(items.select("item_id", terms).distinct())
    size = pairs.agg(F.count("*").alias("pairs"), F.count_distinct(F.struct("item_id")).alias("items")).first()
    blocks = max(math.ceil(size["pairs"] / BLOCK_TERMS), math.ceil(size["items"] / BLOCK_ITEMS))
    found = spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, doc_id long, score long")
    for block in range(blocks):
        own = pairs.filter(F.pmod(F.xxhash64(F.col("item_id"), F.lit(3)), F.lit(blocks)) == block)
        found = found.unionByName(_block(docs, own, top))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return found.select("item_id", F.row_number().over(order).alias("rank"), "doc_id", "score")


_TERMS_SQL = (
    "regexp_extract_all(translate(text, '{0}', '{1}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
).format(_UPPER, _UPPER.lower())

RANKED_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS_SQL} AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n, sum(len(t)) AS l FROM d WHERE len(t) > 0),
p AS (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * s.n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, s.n),
q AS (SELECT DISTINCT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark),
c AS (
    SELECT item_id, r, doc_id,
           sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (50 + (50 * tf.n * s.n) // s.l))))::BIGINT AS score
    FROM q JOIN tf USING (term) JOIN w USING (term), s GROUP BY ALL
),
o AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM c WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= {TOP}
"""
