"""Near-duplicate operators against brute force on small tables."""

import collections
import random

import numpy as np
import pytest

from sparkdocs.llm.components import connected_components
from sparkdocs.llm.embed_dedup import near_vectors, plan_tables
from sparkdocs.llm.minhash import exact_forest, near_duplicates, shingle_sets
from sparkdocs.llm.common import WordHashes


class Union:
    def __init__(self):
        self.up = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def expected_links(rows, percent=85):
    rows = [(i, shingles(t)) for i, t in rows]
    union = Union()
    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                union.join(i, j)
    return sorted(
        ((i, len(a), union.root(i) if i is not None else None, i is None or union.root(i) == i) for i, a in rows), key=str
    )


def corpus():
    draw = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(25):
        base = [draw.choice(words) for _ in range(draw.choice([3, 8, 60, 150]))]
        texts.append(" ".join(base))
        for _ in range(draw.choice([0, 1, 4])):
            other = list(base)
            for _ in range(draw.choice([0, 1, 2])):
                other[draw.randrange(len(other))] = draw.choice(words)
            texts.append("  \n".join(other).upper() if draw.random() < 0.3 else " ".join(other))
    texts += [None, "", " \t\n", "one two", "ONE two", texts[0], "x" * 50_000, "x" * 50_000, "ä b c d e f", "Ä b c d e f"]
    rows = list(zip(random.Random(5).sample(range(10_000), len(texts)), texts))
    return rows + [rows[0], (None, texts[0]), (None, None)]


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_equal_brute_force(spark, percent):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, rep string, n_shingles int")
    got = sorted((tuple(r) for r in near_duplicates(docs, percent).collect()), key=str)
    assert got == expected_links(rows, percent)


def test_one_large_group_is_dealt_to_blocks(spark, monkeypatch):
    from sparkdocs.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 8)
    draw = random.Random(1)
    base = [f"w{draw.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(60):
        other = list(base)
        other[i] = f"z{i}"
        rows.append((i, " ".join(other)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in near_duplicates(docs).collect()), key=str)
    assert got == expected_links(rows)
    assert {r[2] for r in got} == {0}


def test_texts_that_share_an_id_are_linked_each(spark):
    draw = random.Random(8)
    texts = [[f"w{draw.randrange(10**6)}" for _ in range(80)] for _ in range(6)]
    copies = [[*t[:-1], "other"] for t in texts]
    rows = [(10, " ".join(t)) for t in texts]  # six texts of one id
    rows += [(20 + k, " ".join(c)) for k, c in enumerate(copies[:5])] + [(3, " ".join(copies[5])), (10, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter(tuple(r) for r in near_duplicates(docs).collect())
    want = collections.Counter({(10, 76, 10, True): 5, (10, 76, 3, False): 1, (3, 76, 3, True): 1, (10, 0, 10, True): 1})
    want.update({(20 + k, 76, 10, False): 1 for k in range(5)})
    assert got == want


def test_pipeline_keeps_rows_by_id_and_text(spark):
    import corpus_pipeline

    draw = random.Random(9)
    a, b, c = ([f"w{draw.randrange(10**6)}" for _ in range(80)] for _ in range(3))
    near = lambda t: " ".join([*t[:-1], "other"])
    a, b, c, a2, b2, c2 = *(" ".join(t) for t in (a, b, c)), near(a), near(b), near(c)
    rows = [(3, a), (10, a2), (10, b), (10, b), (11, b2), (12, c), (12, c2), (13, None), (13, ""), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted((r for r in got if r[0] != 12), key=str) == sorted([(3, a), (10, b), (13, None), (13, ""), (None, a)], key=str)
    assert len(got) == 6 and {r for r in got if r[0] == 12} < {(12, c), (12, c2)}


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).collect() == []
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in near_duplicates(docs).collect()] == [(1, 0, 1, True)]


def test_exact_forest_links_all_pairs():
    draw = random.Random(2)
    for _ in range(20):
        texts = [" ".join(draw.choice("abcdef") for _ in range(draw.choice([4, 9, 30]))) for _ in range(12)]
        sets = shingle_sets(texts, WordHashes())
        union, want = Union(), Union()
        for a, b in exact_forest(sets, 50):
            union.join(a, b)
        plain = [shingles(t) for t in texts]
        for i in range(12):
            for j in range(i):
                if 100 * len(plain[i] & plain[j]) >= 50 * len(plain[i] | plain[j]):
                    want.join(i, j)
        assert [union.root(i) for i in range(12)] == [want.root(i) for i in range(12)]


def test_components(spark):
    draw = random.Random(4)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)]
    edges += [(1000 + i, 1001 + i) for i in range(40)] + [(5000, i) for i in range(6000, 6040)] + [(7, 7), (None, 3), (3, None)]
    union = Union()
    for a, b in edges:
        if a is not None and b is not None and a != b:
            union.join(a, b)
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: union.root(x) for x in union.up}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def vectors():
    draw = np.random.default_rng(6)
    rows = []
    for k in range(40):
        base = draw.standard_normal(16)
        for _ in range(int(draw.choice([1, 1, 2, 6]))):
            v = base + draw.standard_normal(16) * float(draw.choice([0.0, 0.1, 0.25]))
            rows.append([float(x) for x in v.astype(np.float32)])
    rows += [rows[0], [2 * x for x in rows[1]], [0.0] * 16, None, [], [float("nan")] * 16, [None] + [1.0] * 15, [1.0] * 3, [2.0] * 3]
    return [(100 + i, v) for i, v in enumerate(rows)]


def expected_vectors(rows):
    ok = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            a = np.array(v, np.float64)
            ok[i] = a / np.linalg.norm(a)
    union, links = Union(), {i: 0 for i, _ in rows}
    ids = list(ok)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= 0.95:
                links[i] += 1
                links[j] += 1
                union.join(i, j)
    return sorted((i, links[i], union.root(i), union.root(i) == i) for i, _ in rows)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_near_vectors_equal_brute_force(spark, kind, monkeypatch):
    from sparkdocs.llm import embed_dedup

    monkeypatch.setattr(embed_dedup, "MISSED", 1e-9)
    monkeypatch.setattr(embed_dedup, "BLOCK_MEMBERS", 16)
    monkeypatch.setattr(embed_dedup, "plan_tables", lambda n, c: plan_tables(n, c, 1e-9))
    rows = vectors()
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, rep int")
    assert sorted(tuple(r) for r in near_vectors(frame).collect()) == expected_vectors(rows)


def test_vectors_without_rows_or_ids(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_vectors(empty).collect() == []
    rows = [(None, [1.0, 2.0]), (4, [1.0, 2.0]), (4, [1.0, 2.0])]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((tuple(r) for r in got), key=str) == [(4, 1, 4, True), (4, 1, 4, True), (None, 0, None, True)]


def test_recall_follows_from_the_plan():
    for n in (100, 10_000, 10**9):
        bits, tables = plan_tables(n, 0.95)
        agree = (1 - np.arccos(0.95) / np.pi) ** bits
        assert (1 - agree) ** tables <= 1e-4
