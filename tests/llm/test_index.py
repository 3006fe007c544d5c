"""Repeat removal, ranked search and the Merkle manifest against brute force and SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter
from math import floor, log

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkdocs.llm import ranked, registry, suffix
from sparkdocs.llm.manifest import manifest, lower_ascii
from sparkdocs.llm.ranked import RANKED_SQL, rank_documents
from sparkdocs.llm.suffix import REPEATS_SQL, remove_repeats

DOCS = "doc_id long, text string"


def _same(got, want):
    key = lambda r: tuple((v is not None, v) for v in r)
    return sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


# --- repeat removal ---


def removed(rows):
    """{doc: (bytes, removed, spans, kept)} by remembering every window of the texts in order."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        mark = bytearray(len(data))
        for i in range(len(data) - suffix.LENGTH + 1):
            window = data[i : i + suffix.LENGTH]
            if window in seen:
                mark[i : i + suffix.LENGTH] = b"\1" * suffix.LENGTH
            seen.add(window)
        spans = sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))
        out[doc] = len(data), sum(mark), spans, bytes(b for b, m in zip(data, mark) if not m)
    return out


def _found(df, **how):
    out = {}
    for r in remove_repeats(df, ["doc_id", "text"], **how).collect():
        spans = [(s.start, s.end) for s in r.spans]
        out[r.doc_id] = len((r.text or "").encode()), sum(b - a for a, b in spans), len(spans), bytes(r.kept)
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    parts = ["".join(rng.choice("abcd efé") for _ in range(rng.randint(80, 500))) for _ in range(15)]
    rows = []
    for i in range(120):
        text = ""
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(parts)
            start = rng.randint(0, len(part) - 1)
            text += part[start : start + rng.randint(0, 300)] + "x" * rng.randint(0, 2)
        rows.append((3 * i - 40, text))
    rows += [(900, None), (901, ""), (902, "a" * 99), (903, "a" * 700), (904, "ab" * 300 + "a" * 130), (905, "a" * 100)]
    rows.append((906, "".join(parts) * 2))
    return rows


def test_repeats_equal_brute_force(spark, texts):
    df = spark.createDataFrame(texts, DOCS).repartition(5)
    assert _found(df) == removed(texts)
    assert _found(df, batches=1) == removed(texts)


def test_frequent_grams_meet_by_shuffle(spark, texts, monkeypatch):
    monkeypatch.setattr(suffix, "HOT_STRETCHES", 1)
    assert _found(spark.createDataFrame(texts, DOCS)) == removed(texts)


def test_equal_windows_name_equal_places():
    rng = random.Random(2)
    middle = bytes(rng.randrange(97, 101) for _ in range(suffix.LENGTH))
    import numpy as np

    def named(before, after):
        data = before + middle + after
        _, _, place, lo, hi = suffix.stretches(np.frombuffer(data, np.uint8), np.array([len(data)]))
        at = next(i for i in range(len(lo)) if lo[i] <= len(before) <= hi[i])
        return place[at] - len(before)

    places = {named(bytes(rng.randrange(97, 101) for _ in range(rng.randrange(200))), b"zz") for _ in range(20)}
    assert len(places) == 1


def test_long_texts_go_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SLICE_BYTES", 500)
    rng = random.Random(3)
    text = "".join(rng.choice("abc") for _ in range(3000))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([b"short", text.encode(), b""], pa.binary())], ["doc", "text"])
    parts = list(suffix._pieces(batch))
    # Every window lies in exactly one piece.
    assert sum(max(0, len(d) - suffix.LENGTH + 1) for docs, _, d, _ in parts if docs[0] == 2) == 3000 - suffix.LENGTH + 1
    assert [(s, len(d)) for docs, s, d, _ in parts if docs[0] == 2][:2] == [(0, 599), (500, 599)]


def test_levels_merge_geometrically(spark):
    family = suffix.IndexFamily()
    for i in range(5):
        rows = [(i * 10 + j, 1, i, j) for j in range(4)] + [(7, 7, i, 9)]
        copies = family.add(spark.createDataFrame(rows, "gram long, span long, doc long, place long"))
        assert copies.count() == (0 if i == 0 else 1)
    assert [merges for merges, _ in family.levels] == [2, 0]
    assert family.entries().count() == 21


def test_repeated_ids_and_rows(spark):
    rng = random.Random(4)
    shared = "".join(rng.choice("abcdefgh") for _ in range(150))
    a, b = shared + "q" * 20, "r" * 30 + shared + "s"
    rows = [(1, a, 0), (1, a, 1), (1, b + "t", 2), (None, b, 3), (2, None, 4), (2, shared, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int").withColumnRenamed("spans", "kept")
    got = {r[0]: (len(r[1]), bytes(r[2])) for r in remove_repeats(df, ["kept"]).toDF("no", "cut", "left").collect()}
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    order = sorted({(r[0] is not None, r[0] or 0, digest(r[1]), r[1]) for r in rows}, key=lambda x: x[:3])
    want = removed([(i, x[3]) for i, x in enumerate(order)])
    place = {x[:3]: i for i, x in enumerate(order)}
    for doc, text, no in rows:
        _, _, spans, kept = want[place[doc is not None, doc or 0, digest(text)]]
        assert got[no] == (spans, kept)
    assert remove_repeats(spark.createDataFrame([], DOCS), ["doc_id"]).count() == 0


def test_repeats_sql_equals_brute_force(texts):
    rows = [r for r in texts if r[0] > 100]
    documents = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    got = {r[0]: r[1:] for r in duckdb.sql(REPEATS_SQL).fetchall()}
    assert documents.num_rows == len(got)
    assert got == {d: (n, m, s, hashlib.sha256(k).hexdigest()) for d, (n, m, s, k) in removed(rows).items()}


# --- ranked search ---


def scored(docs, items, top=ranked.TOP):
    pattern = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    low = {c: c + 32 for c in range(65, 91)}
    split = lambda t: pattern.findall((t or "").translate(low))
    held = [(d, Counter(split(t))) for d, t in docs]
    n_docs = sum(bool(c) for _, c in held)
    n_all = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(split(text))
    out = []
    for item, terms in asked.items():
        found = []
        for d, c in held:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_all if n_all else 50
            score = sum(
                floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t]
            )
            if score > 0:
                found.append((-score, d is not None, d))
        found.sort()
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(found[:top])]
    return out


@pytest.fixture(scope="module")
def library():
    rng = random.Random(9)
    words = ["Alpha", "beta", "GAMMA", "é3", "ÉA", "delta_9", "x-y", "日本", "omega", "1"]
    docs = [(rng.randint(0, 60), " ".join(rng.choices(words, weights=range(1, 11), k=rng.randint(0, 30)))) for _ in range(150)]
    docs += [(None, "alpha alpha"), (None, None), (5, ""), (7, "!!! ---"), (8, "beta " * 5000), (9, "beta\x00omega")]
    items = [(1, "alpha BETA x"), (2, "éa 日本"), (3, None), (4, "nothing here"), (1, "omega"), (None, "1 Delta"), (6, "")]
    return docs, items


def test_ranking_equals_brute_force(spark, library, monkeypatch):
    docs, items = library
    d, i = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = rank_documents(d.withColumn("score", F.lit("x")), i.withColumn("rank", F.lit(0))).collect()
    assert _same(got, scored(docs, items))
    monkeypatch.setattr(ranked, "BLOCK_ITEMS", 2)
    assert _same(rank_documents(d, i, top=3).collect(), scored(docs, items, 3))


def test_ranking_of_empty_tables(spark, library):
    docs, items = library
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    assert rank_documents(d.limit(0), i).count() == 0
    assert rank_documents(d, i.limit(0)).count() == 0
    assert rank_documents(spark.createDataFrame([(1, None)], DOCS), i).count() == 0


def test_ranking_sql_equals_brute_force(library):
    docs, items = library
    docs, items = [r for r in docs if r[1] != "beta\x00omega"], [r for r in items if r[0]]
    documents = pa.table({"doc_id": [r[0] for r in docs], "text": [r[1] for r in docs]})
    benchmark = pa.table({"item_id": [r[0] for r in items], "text": [r[1] for r in items]})
    assert documents.num_rows and benchmark.num_rows
    assert _same(duckdb.sql(RANKED_SQL).fetchall(), scored(docs, items))


def test_bundles_pass_every_owner(spark, library):
    docs, _ = library
    number = {t.encode(): i + 1 for i, t in enumerate(["alpha", "beta", "gamma", "omega", "1", "delta"])}
    rows = spark.createDataFrame(docs, DOCS).coalesce(1).mapInArrow(
        ranked._index(spark.sparkContext.broadcast(number)), ranked._POSTINGS
    ).collect()
    assert {r.owner for r in rows} == {-1, *range(ranked.OWNERS)}


# --- manifest ---


def proved(rows):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h("".join(field(v) for v in (*r[:4], text)))
    low = {c: c + 32 for c in range(65, 91)}
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, i):
        for nodes in levels[:-1]:
            start = i // 16 * 16
            yield "".join(nodes[start:i]), "".join(nodes[i + 1 : start + 16])
            i //= 16

    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[name] = tree([leaf(r, r[4]) for r in groups[name]])
    top = tree([trees[name][-1][0] for name in names])
    for k, name in enumerate(names):
        for i, r in enumerate(groups[name]):
            steps = [*path(trees[name], i), *path(top, k)]
            own = trees[name][0][i]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                own = leaf(r, r[4].translate(low))
            for a, b in steps:
                own = h(a + own + b)
            root = top[-1][0]
            yield r[0], trees[name][0][i], trees[name][-1][0], root, h("".join(a + b for a, b in steps)), own, own == root


_FULL = "doc_id long, source string, lang string, n_chars long, text string"


def _proof(df):
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(df, tampered={"text": lower_ascii(F.col("text"))}, changed=changed)


@pytest.fixture(scope="module")
def leaves():
    rows = [
        (i % 7 if i % 3 else None, None if i % 5 == 0 else ["", "a", "é", "=z"][i % 4], "en" if i % 2 else None, i, None if i % 11 == 0 else f"AbC {i % 4}")
        for i in range(200)
    ]
    rows += [(5, "a", "en", 1, "X")] * 40 + [(i, "large", "en", i, "T" * (i % 9)) for i in range(-300, 300)]
    rows += [(-64, "neg", "x", 2, "N"), (-65, "neg", "x", 2, "N"), (63, "neg", "x", 2, ""), (1 << 62, "neg", "x", None, "Z"), (99, "one", "e", 1, "L" * 200_000)]
    return rows


def test_manifest_equals_trees_built_by_hand(spark, leaves):
    df = spark.createDataFrame(leaves, _FULL).withColumn("pos", F.lit(1)).withColumn("leaf", F.lit("x"))
    assert _same(_proof(df.repartition(3)).collect(), proved(leaves))


def test_manifest_of_one_row_and_of_none(spark):
    one = [(3, None, None, None, "B")]
    got = _proof(spark.createDataFrame(one, _FULL)).collect()
    assert _same(got, proved(one)) and got[0]["leaf"] == got[0]["subroot"] == got[0]["root"]
    assert _proof(spark.createDataFrame([], _FULL)).count() == 0


def test_manifest_sql_equals_trees_built_by_hand(leaves):
    rows = [r for r in leaves if r[0] is not None and r[0] >= 0]
    documents = pa.table(dict(zip(["doc_id", "source", "lang", "n_chars", "text"], map(list, zip(*rows)))))
    assert documents.num_rows == len(rows)
    assert _same(duckdb.sql(registry.ORACLES["op13_bitmap_manifest"]).fetchall(), proved(rows))
