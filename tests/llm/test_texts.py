"""Quality, language, packing, tokenizing, scoring and licence operators against brute force."""

import collections
import functools
import hashlib
import itertools
import math
import random
import re
import tracemalloc
import uuid
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tokenizers

from sparkdocs.llm import bpe, langid, license, packing, ppm, quality

ODD = [
    None, "", "   \n\t", "word", "it's WE'LL 'S x", "a\x85b\x1cc\xa0d\x0be", "ΑΣ ΟΔΟΣ Σ İ ẞ Ⱥ", "日本語 テスト 1234 ½²", "😀😀 ok",
    "<|endoftext|> x <|startoftext|>y <|endof", "aaaa aaaaa aaa", "\x00\x01 '' !!!??? $$$", "ab " * 3000, "q" * 4000, "é ạ 한국어",
]


def docs_of(spark, texts, first=0):
    rows = [(first + i, t, "x", -1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string, n_words int")


def base_counts(text):
    text = text or ""
    words = text.encode().split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return (
        len(words), len(b"".join(words).decode()), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    )


def test_quality_counts_equal_brute_force(spark):
    draw = random.Random(1)
    texts = ODD + [
        "".join(draw.choice(["a", "b", " ", "\n", "  ", "\t", "#", "a b c\n", "é", "\r", "a b a b a "]) for _ in range(draw.choice([5, 40, 300])))
        for _ in range(60)
    ]
    got = quality.judged(docs_of(spark, texts), "n_words")  # a name that is taken
    assert got.columns == ["doc_id", "text", "length", "n_words", "_n_words"]
    rows = got.select("doc_id", "_n_words.*").collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def prose(draw, n):
    return " ".join(
        "".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(2, 8))) + ("." if draw.random() < 0.1 else "") for _ in range(n)
    )


def test_quality_keeps_prose_and_rejects_defects(spark):
    draw = random.Random(2)
    good = [prose(draw, 150) for _ in range(160)]
    symbols = [re.sub(" ", "$$$ ", prose(draw, 150)) for _ in range(12)]
    capitals = [re.sub(" ", "!! ", prose(draw, 150)).upper() for _ in range(12)]
    got = {r.doc_id: r.kept for r in quality.judged(docs_of(spark, good + symbols + capitals), "q").select("doc_id", "q.kept").collect()}
    assert all(got[i] for i in range(160))
    assert not any(got[i] for i in range(160, 184))


def test_quality_posterior_is_the_mixture_by_hand(spark):
    """One E step over two rules from shares that the M step gives, computed in plain Python."""
    rules = quality.RULES[:2]
    patterns = {"gg": 80, "gb": 10, "bg": 8, "--": 2}
    frame = spark.createDataFrame(list(patterns.items()), "votes string, n long")
    got, _ = quality.posteriors(frame, rules, rounds=1)
    share = {p: [0.95, 0.025, 0.025] if "b" not in p else [0.1, *[0.9 if x == "b" else 0.0 for x in p]] for p in patterns}
    size = [sum(n * share[p][c] for p, n in patterns.items()) for c in range(3)]
    logs = {}
    for c in range(3):
        for j in range(2):
            seen = [sum(n * share[p][c] for p, n in patterns.items() if p[j] == k) for k in "gb"]
            lean = [1 - quality.STRAY, quality.STRAY] if c == 0 else [0.5, 0.5]
            weight = sum(seen) * (1 if c == 0 else 0.01)
            for k, x, y in zip("gb", seen, lean):
                logs[c, j, k] = math.log((x + weight * y) / (sum(seen) + weight))
            logs[c, j, "-"] = 0.0
    for r in got.collect():
        odds = [math.log(size[c] / 100) + sum(logs[c, j, r.votes[j]] for j in range(2)) for c in range(3)]
        want = math.exp(odds[0]) / sum(map(math.exp, odds))
        assert r.p_quality == pytest.approx(want, abs=1e-4)


def test_quality_of_nothing(spark):
    assert quality.judged(docs_of(spark, [])).collect() == []


LANGS = {
    "aa": ["bado", "luma", "kiro", "sedu", "nolba", "tumi"], "bb": ["xarth", "vrong", "skelt", "drimf", "plast", "zwerg"],
    "cc": ["éoui", "aïeu", "oeiê", "uéa", "ieoua", "ayie"],
}


def language_rows():
    draw = random.Random(3)
    rows = []
    for i in range(240):
        lang = draw.choice(list(LANGS))
        rows.append((i, " ".join(draw.choice(LANGS[lang]) for _ in range(draw.choice([6, 30, 80]))).capitalize() + ".", lang))
    return rows


def test_languages_are_told_apart(spark):
    rows = language_rows()
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 ² !?", "bb"), (1003, "bado luma", None), (None, "vrong skelt xarth", None)]
    docs = spark.createDataFrame([(*r, "s") for r in rows + odd], "doc_id long, text string, lang string, score string")
    from pyspark.sql import functions as F

    held_out = F.coalesce(F.col("doc_id") % 4 == 2, F.lit(False))
    got = langid.identify(docs, langid.learn(docs, held_out), "score")
    assert got.columns == ["doc_id", "text", "lang", "score", "_score"]
    found = {r.doc_id: r for r in got.select("doc_id", "_score.*").collect()}
    held = [(i, lang) for i, _, lang in rows if i % 4 == 2]
    assert all(found[i].lang_pred == lang for i, lang in held)
    assert all(not found[i].rejected and 0.5 <= found[i].score <= 1 for i, _ in held)
    for i in (1000, 1001, 1002):
        assert (found[i].lang_pred, found[i].score, found[i].rejected) == ("und", 0.0, True)
    assert found[1003].lang_pred == "aa" and found[None].lang_pred == "bb"


def test_language_without_labels_or_rows(spark):
    from pyspark.sql import functions as F

    for rows in ([], [(1, "some text", None)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        got = langid.identify(docs, langid.learn(docs, F.lit(False)), "found").select("found.lang_pred").collect()
        assert [r.lang_pred for r in got] == ["und"] * len(rows)


def test_kneser_ney_is_a_distribution():
    """Over the whole alphabet the chances after any context add up to one."""
    words, counts = ["abca", "abd", "bca", "aa", "cab"], np.array([3, 1, 2, 4, 1])
    signs = "abcd"
    alphabet = len(signs) + 2
    scorer = langid.Scorer({"x": langid.kneser_ney(words, counts, alphabet)}, alphabet)

    def log(word):
        return scorer.words([word])[0][0, 0]

    total = sum(math.exp(log("".join(w))) for n in range(1, 6) for w in itertools.product(signs, repeat=n))
    assert 0.9 < total <= 1.0 + 1e-9


def kneser_ney_by_hand(words, counts, alphabet, order):
    """Probability of every character of a word, from counts in dictionaries."""
    raw, before = collections.Counter(), collections.defaultdict(set)
    for word, count in zip(words, counts):
        signs = "<" + word + ">"
        for end in range(1, len(signs)):
            for n in range(1, min(order + 1, end + 1) + 1):
                gram = signs[end - n + 1 : end + 1]
                raw[gram] += int(count)
                before[gram[1:]].add(gram[0])
    levels = {}
    for n in range(1, order + 1):
        c = {g: k if n == order or g[0] == "<" else max(1, len(before[g])) for g, k in raw.items() if len(g) == n}
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount = min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.05), 0.95)
        total, kinds = collections.Counter(), collections.Counter()
        for g, k in c.items():
            total[g[:-1]] += k
            kinds[g[:-1]] += 1
        levels[n] = c, discount, total, kinds

    def chance(context, sign):
        n = len(context) + 1
        c, discount, total, kinds = levels[n]
        below = chance(context[1:], sign) if n > 1 else 1 / alphabet
        if not total[context]:
            return below
        rest = discount * kinds[context] / total[context] * below
        return max(c.get(context + sign, discount) - discount, 0) / total[context] + rest

    def score(word):
        signs = "<" + word + ">"
        return sum(math.log(chance(signs[max(0, i - order + 1) : i], signs[i])) for i in range(1, len(signs)))

    return score


@pytest.mark.parametrize("order", [2, 5])
def test_kneser_ney_equals_counts_by_hand(order, monkeypatch):
    draw = random.Random(12)
    words = sorted({"".join(draw.choices("abcde", weights=[5, 4, 3, 2, 1], k=draw.randint(1, 9))) for _ in range(120)})
    counts = np.array([draw.choice([1, 1, 1, 2, 3, 9]) for _ in words])
    monkeypatch.setattr(langid, "gram_hashes", functools.partial(langid.gram_hashes, order=order))
    tables = kneser_ney_tables(words, counts, 7, order)
    scorer = langid.Scorer({"x": tables}, 7)
    by_hand = kneser_ney_by_hand(words, counts, 7, order)
    for word in [*words[:40], "abcabc", "eee", "zzz", "a", "edcba" * 4, "az"]:
        assert scorer.words([word])[0][0, 0] == pytest.approx(by_hand(word))


def kneser_ney_tables(words, counts, alphabet, order):
    plain = langid.gram_hashes
    langid.gram_hashes = getattr(plain, "func", plain)
    try:
        return langid.kneser_ney(words, counts, alphabet, order)
    finally:
        langid.gram_hashes = plain


def test_scores_follow_accuracy_and_distance():
    """Close languages on short texts: the score tells how often the best one is right; odd texts get little."""
    draw = np.random.default_rng(1)
    n = draw.choice([9, 25, 100], 6000)
    truth = draw.integers(0, 2, 6000)
    entropy = 2.0 + draw.normal(0, 1, (6000, 2)) / np.sqrt(n)[:, None]
    entropy[np.arange(6000), 1 - truth] += 0.15
    sharp = langid.fit_sharpness(entropy[:3000], n[:3000], truth[:3000])
    model = langid.LanguageModel({"a": [], "b": []}, 10, sharp, {"a": 4.0, "b": 4.0})
    lang, score, _ = model.judge(entropy[3000:], n[3000:])
    right = np.array([x == "ab"[t] for x, t in zip(lang, truth[3000:])])
    for low, high in ((0.5, 0.7), (0.7, 0.85), (0.85, 1.0)):
        part = (score >= low) & (score < high)
        assert abs(right[part].mean() - score[part].mean()) < 0.06
    _, score, rejected = model.judge(np.array([[2.0, 5.0], [4.6, 7.0], [9.0, 12.0]]), np.array([100, 100, 100]))
    assert score[0] > 0.9 > 0.5 > score[1] > score[2] and rejected.tolist() == [False, True, True]


def test_languages_with_few_rows_long_and_repeated_texts(spark):
    from pyspark.sql import functions as F

    rows = [(r[0], r[1], r[2]) for r in language_rows()] + [(2001, "ghtry qwerp zxcvb " * 3, "dd")]
    rows += [(3000, "bado luma kiro " * 200_000, None)] + [(3001, "vrong skelt plast", "bb")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs, F.lit(False))
    assert set(model.models) == {"aa", "bb", "cc", "dd"}
    found = langid.identify(docs, model, "found", keep=["doc_id"]).select("doc_id", "found.*").collect()
    assert len(found) == len(rows)
    assert {r.lang_pred for r in found if r.doc_id == 2001} == {"dd"}
    assert {r.lang_pred for r in found if r.doc_id == 3000} == {"aa"}
    assert len({(r.score, r.lang_pred) for r in found if r.doc_id == 3001}) == 1


def model(name):
    return packing.tokenizer_text(public_tokenizers.path(name))


def test_packed_pieces(spark):
    draw = random.Random(4)
    texts = ODD + [prose(draw, draw.choice([5, 60, 300, 900, 2500])) for _ in range(60)] + [prose(draw, 12_000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "x y"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(*r, "q", 0) for r in rows], "doc_id long, text string, sequence_id string, item int")
    text = model("byte_bpe_50k.json")
    got = packing.pack_documents(docs, text).collect()
    library = tokenizers.Tokenizer.from_str(text)
    want = collections.Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    plain = packing.best_fit(np.array([r.length for r in got]), 1024)
    assert len(places) <= len(plain)


def test_assignment_over_several_rounds(spark):
    draw = random.Random(5)
    items = [(i, draw.randint(1, 1024)) for i in range(3000)]
    got = packing.assign(spark.createDataFrame(items, "item long, length long"), group_pieces=400).collect()
    size = dict(items)
    assert sorted(r.item for r in got) == list(range(3000))
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, size[r.item]))
    for parts in places.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 1024
    assert len(places) <= 1.02 * sum(size.values()) / 1024 + 1


def test_assignment_of_short_items_ends(spark, monkeypatch):
    real, rounds = packing._pack_group, []

    def counted(capacity, round_no, last):
        assert round_no < 20, "the rounds do not shrink"
        rounds.append(round_no)
        return real(capacity, round_no, last)

    monkeypatch.setattr(packing, "_pack_group", counted)
    items = spark.range(30_000).selectExpr("id AS item", "3L AS length")
    got = packing.assign(items).collect()
    assert sorted(r.item for r in got) == list(range(30_000)) and len(rounds) > 1
    assert len({r.sequence_id for r in got}) <= -(-30_000 // 341) + 2


def test_local_search_empties_bins():
    # Best fit leaves three bins where two are enough.
    sizes = np.array([6, 5, 5, 4, 7, 3])
    bins = [[0, 5], [1], [2], [4], [3]]
    out = packing.local_search(sizes, bins, 10)
    assert sorted(i for b in out for i in b) == [0, 1, 2, 3, 4, 5]
    assert all(sizes[b].sum() <= 10 for b in out) and len(out) < len(bins)
    draw = random.Random(6)
    for _ in range(20):
        sizes = np.array([draw.randint(1, 100) for _ in range(150)])
        first = packing.best_fit(sizes, 100)
        better = packing.local_search(sizes, first, 100)
        assert sorted(i for b in better for i in b) == list(range(150))
        assert all(sizes[b].sum() <= 100 for b in better) and len(better) <= len(first)


def test_local_search_tries_all_pairs_of_a_bin():
    # Only 30 and 19, the ends of a bin of five, can be exchanged for 50.
    sizes = np.array([50, 30, 18, 16, 16, 19, 80, 70])
    out = packing.local_search(sizes, [[0], [1, 2, 3, 4, 5], [6], [7]], 100)
    assert sorted(i for b in out for i in b) == list(range(8))
    assert all(sizes[b].sum() <= 100 for b in out) and len(out) == 3


def test_packing_nothing(spark):
    assert packing.pack_documents(docs_of(spark, []), model("byte_bpe_50k.json")).collect() == []


@pytest.fixture(scope="module")
def word_model():
    return model("word_bpe_49k.json")


def test_automaton_equals_the_library(spark, word_model):
    draw = random.Random(7)
    texts = ODD + [prose(draw, 80) for _ in range(20)] + ["".join(draw.choice("aab ißÉ'1.") for _ in range(200)) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    coded = bpe.encode(docs, word_model)
    assert coded.columns == ["doc_id", "text", "ids", "_ids"]
    library = tokenizers.Tokenizer.from_str(word_model)
    rows = bpe.decode(coded, word_model, "_ids", "out").collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r["_ids"] == ids, texts[r.doc_id]
        assert r.out == library.decode(ids, skip_special_tokens=False)
    assert bpe.decode(spark.createDataFrame([([1, 10**6, -1],), (None,)], "ids array<int>"), word_model).filter("decoded IS NULL").count() == 1


def test_merge_gadgets_on_all_short_words():
    """A small vocabulary with a double letter merge, against merging step by step."""
    letters = "ab"
    merges = [["a", "a"], ["a", "b"], ["aa", "b</w>"], ["b", "a"], ["a", "a</w>"], ["aa", "aa"], ["b", "b"], ["a", "b</w>"], ["ab", "ab</w>"]]
    vocab = {}
    for t in [*letters, *(c + "</w>" for c in letters), *(u + v for u, v in merges)]:
        vocab.setdefault(t, len(vocab))
    machine = bpe.compile_merges(vocab, merges)
    machine.open()

    def by_hand(word):
        parts = [*word[:-1], word[-1] + "</w>"]
        for u, v in merges:
            i = 0
            while i < len(parts) - 1:
                if parts[i] == u and parts[i + 1] == v:
                    parts[i : i + 2] = [u + v]
                i += 1
        return [vocab[p] for p in parts]

    for n in range(1, 11):
        for w in itertools.product(letters, repeat=n):
            assert machine.read("".join(w)) == by_hand("".join(w))



def test_ppm_blocks_add_slices_without_sorting_themselves(monkeypatch):
    monkeypatch.setattr(ppm, "PENDING_GRAMS", 50_000)
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 123, 40_000, np.uint8)).decode() for _ in range(30)]
    texts[7] = texts[3]
    use = [i % 5 != 4 for i in range(30)]
    block = ppm._Block(3, 5)
    tracemalloc.start()
    for t, u in zip(texts, use):
        block.add([u], [t])
    rows = [b for b in block.rows() if b.column("word").null_count]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = collections.Counter()
    for t, u in zip(texts, use):
        found, _ = ppm.grams([[t.encode()]], 5)
        want.update({g: 0 for g in set(found.tolist()) - want.keys()})
        if u:
            want.update(found.tolist())
    got = {g: n for b in rows for g, n in zip(b.column("gram").to_pylist(), b.column("n").to_pylist())}
    assert got == dict(want)
    # Twelve bytes a gram are kept; one copy of them and one slice come on top, not four sorted ones.
    assert peak < 48 * len(want), peak / len(want)


def test_gram_table_refuses_absent_grams():
    keys = np.array([5, 1 << 40, 77], np.int64)
    table = ppm.GramTable(keys, np.array([0.5, 1.5, 2.5]))
    assert table.get(np.array([77, 5, 77])).tolist() == [2.5, 0.5, 2.5]
    for absent in (6, 78, -1, 1 << 62):
        with pytest.raises(KeyError):
            table.get(np.array([5, absent]))
    with pytest.raises(KeyError):
        ppm.GramTable(np.zeros(0, np.int64), np.zeros(0)).get(np.array([3]))


def test_gram_table_searches_only_grams_that_lost_their_slot():
    rng = np.random.default_rng(6)
    keys = rng.permutation(np.unique(rng.integers(0, 1 << 48, 100_000)))
    values = rng.random(len(keys))
    table = ppm.GramTable(keys, values)
    asked = rng.integers(0, len(keys), 300_000)
    assert np.array_equal(table.get(keys[asked]), values[asked])
    assert 0 < len(table.lost) < 0.25 * len(keys)
    for absent in (-1, 1 << 48, (1 << 63) - 1):
        with pytest.raises(KeyError):
            table.get(np.array([keys[0], absent]))


def ppm_by_hand(train, text, depth):
    """Method D with exclusion over contexts of a padded byte string."""
    counts = collections.defaultdict(collections.Counter)

    def padded(t):
        return b"\n" * depth + b" ".join([*(t or "").encode().lower().split(), b"\n"])

    for t in train:
        data = padded(t)
        for i in range(depth, len(data)):
            for j in range(depth + 1):
                counts[data[i - j : i]][data[i]] += 1
    data, total = padded(text), 0.0
    for i in range(depth, len(data)):
        out: set = set()
        for j in range(depth, -1, -1):
            seen = {s: n for s, n in counts[data[i - j : i]].items() if s not in out}
            if seen:
                room = 2 * sum(seen.values())
                if data[i] in seen:
                    total += math.log10((2 * seen[data[i]] - 1) / room)
                    break
                total += math.log10(len(seen) / room)
            out |= set(counts[data[i - j : i]])
        else:
            total -= math.log10(256 - len(out))
    return total


@pytest.mark.parametrize("depth", [2, 5])
def test_scores_equal_a_trie_by_hand(spark, depth, monkeypatch):
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 300)
    draw = random.Random(8)
    texts = [None, "", "Abra CADABRA\tabra", "zz é 日", "abra\x85kadabra"] + [
        " ".join(draw.choice(["abra", "kadabra", "ab", "bar", "arb", "x1"]) for _ in range(draw.choice([1, 5, 30]))) for _ in range(30)
    ]
    rows = [(i, t, i % 3 == 1, "s") for i, t in enumerate(texts)] + [(2, texts[2], False, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean, score string")
    from pyspark.sql import functions as F

    got = ppm.score_texts(docs, F.col("held_out"), ["doc_id", "held_out"], depth).collect()
    assert len(got) == len(rows)
    train = [t for _, t, held, _ in rows if not held]
    words = collections.Counter(w for t in train for w in [*(t or "").encode().lower().split(), None])
    n, v = sum(words.values()), len(words)
    for r in got:
        mine = [*(texts[r.doc_id] or "").encode().lower().split(), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(mine), sum(words[w] > 0 for w in mine), n)
        assert r.base_score == pytest.approx(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in mine))
        assert r.score == pytest.approx(ppm_by_hand(train, texts[r.doc_id], depth))


def test_ppm_moves_terms_and_texts_packed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 400_000)
    scored = ppm._score

    def weighed(depth, unknown):
        run = scored(depth, unknown)

        def each(batches, got):
            for b in batches:
                got[0] += b.num_rows
                got[1] += b.nbytes
                yield b

        def weigh(batches):
            got = [0, 0]
            yield from run(each(batches, got))
            (tmp_path / uuid.uuid4().hex).write_text(f"{got[0]} {got[1]}")

        return weigh

    monkeypatch.setattr(ppm, "_score", weighed)
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdefgh", k=draw.choice([3, 6, 9]))) for _ in range(20_000)]
    texts = [" ".join(draw.choices(words, k=500)) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    from pyspark.sql import functions as F

    got = ppm.score_texts(docs, F.col("doc_id") % 7 == 2, ["doc_id"]).collect()
    assert sorted(r.doc_id for r in got) == list(range(600)) and all(r.n_tokens == 501 for r in got)
    rows, size = map(sum, zip(*(map(int, f.read_text().split()) for f in tmp_path.iterdir())))
    # Not a row for each gram, word and text, and fewer bytes than two numbers a gram take without the texts.
    grams = sum(len(set(ppm.grams([t.encode().split() for t in texts[i : i + 100]], 5)[0].tolist())) for i in range(0, 600, 100))
    assert rows < 600 and size < 16 * grams, (rows, size, grams)


def test_scores_without_training_or_rows(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in ppm.score_texts(docs, F.lit(True), ["doc_id"]).collect()}
    assert got[1].train_tokens == 0 and got[1].n_known == 0 and got[1].base_score == 0.0
    assert got[1].score == pytest.approx(-4 * math.log10(256)) and got[2].score == pytest.approx(-math.log10(256))
    assert ppm.score_texts(docs.limit(0), F.lit(True), ["doc_id"]).collect() == []


def licence_text(sequence):
    return [license.SENTENCES[k][0].replace("{}", "Acme Widgets Inc") for k in sequence]


def layouts(sentences):
    plain = "\n".join(sentences)
    wrapped = "\n".join(re.sub(r"(.{30,60}?) ", r"\1\n  ", s) for s in sentences)
    yield "Some code here.\n" + plain + "\nfoo = 1"
    yield "Some code here.\n" + wrapped + "\nfoo = 1"
    yield "# Some code here.\n#\n" + "\n".join("# " + x for x in wrapped.split("\n")) + "\n\nfoo = 1"
    yield "/* Some code here.\n" + "\n".join(" *   " + x.strip() for x in wrapped.split("\n")) + "\n */ int x;"
    yield "Some code here.\n\n" + "\n\n".join("  * " + s for s in sentences) + "\n\nEnd.\n"
    yield "\n".join(f"{i + 1}. {s}" for i, s in enumerate(sentences))


def naive_licences(text):
    """(licence, sentences) by one pattern per rule over the words of the text, the longest rule first."""
    words = " ".join(license.normal_words(text))
    hole = r"(?:\w+ ){1,12}?"
    found = []
    sentences, rules = license.with_tags(license.SENTENCES, license.RULES)
    for name, sequence in sorted(rules, key=lambda r: -len(r[1])):
        parts = []
        for key in sequence:
            forms = []
            for form in sentences[key]:
                forms.append("".join(hole if w is license._HOLE else w + " " for w in license.pattern_words(form)))
            parts.append("(?:" + "|".join(forms) + ")")
        pattern = r"(?:\w{1,2} )?".join(parts)
        found += [(-len(sequence), m.start() - m.end(), m.start(), m.end(), name) for m in re.finditer(pattern, words + " ")]
    kept = []
    for _, _, start, end, name in sorted(found):
        if not any(a < end and start < b for a, b, _ in kept):
            kept.append((start, end, name))
    return sorted(n for _, _, n in kept)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="test tables not present")
def test_licences_of_documents_equal_the_naive_matcher():
    rules = license.Rules(*license.with_tags(license.SENTENCES, license.RULES))
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    for text in texts:
        if any(a in (text or "").lower() for a in license.ANCHORS):
            assert sorted(x[0] for x in rules.match(text)) == naive_licences(text)


def test_every_licence_text_is_recognised(spark):
    texts, want = [], []
    for name, sequence in license.RULES:
        for text in layouts(licence_text(sequence)):
            texts.append(text)
            want.append((name, len(sequence)))
    for name in sorted({n for n, _ in license.RULES}):
        texts.append(f"// SPDX-License-Identifier: {name}\nint x;")
        want.append((name, 1))
    rows = [(k, t, "l") for k, t in enumerate(texts)]
    rows += [(9000, None, "l"), (9001, "", "l"), (9002, "no licensed thing", "l"), (9003, "licence " * 5000, "l")]
    got = license.recognise(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()
    found = collections.defaultdict(list)
    for r in got:
        found[r.doc_id].append((r.license, r.n_sentences))
        assert r.exact
    assert set(found) == set(range(len(texts)))
    for k, expected in enumerate(want):
        assert found[k] == [expected], texts[k]
        assert naive_licences(texts[k]) == [expected[0]], texts[k]


def test_licences_that_are_nearly_known():
    rules = license.Rules(*license.with_tags(license.SENTENCES, license.RULES))

    def names(text):
        return [(x[0], x[4]) for x in rules.match(text)]

    bsd = licence_text(["bsd-use", "bsd-source", "bsd-binary"])
    assert names("This project is licensed under the MIT License.") == [("MIT", True)]
    assert names("\n".join([bsd[0], *("* " + x for x in bsd[1:]), "* Neither the name of Acme Inc. nor the names of its contributors may be "
                             "used to endorse or promote products derived from this software without specific prior written permission."])) == [("BSD-3-Clause", True)]
    # A third clause in other words: not the licence of two clauses.
    assert names("\n".join([*bsd, "Neither the names of Acme nor of its contributors may be used to endorse or promote derived products without written permission."])) == [
        ("BSD-3-Clause", False)
    ]
    assert names("\n".join([*bsd, "All other words are about something else."])) == [("BSD-2-Clause", True)]
    assert names("SPDX-License-Identifier: BSD-2-Clause-Patent") == []
    assert names("SPDX-License-Identifier: GPL-3.0-or-later") == [("GPL-3.0-or-later", True)]
    assert names("the long and winding road to all the places where nobody has ever been is licensed under the MIT License.") == []


def test_licence_sentences_over_lines_and_of_the_caller(spark):
    docs = spark.createDataFrame(
        [(1, "This is free and unencumbered software released into the public\ndomain."), (2, "Free for all\nuses."), (3, "Licensed under CC BY-SA 4.0."), (4, "für Größen")],
        "doc_id long, text string",
    )
    assert [(r.doc_id, r.license) for r in license.recognise(docs).collect()] == [(1, "Unlicense"), (3, "CC-BY-SA-4.0")]
    own = license.recognise(docs, {"free": ["Free for all uses."]}, [("Own", ["free"])]).collect()
    assert [(r.doc_id, r.license) for r in own] == [(2, "Own")]
    assert [r.doc_id for r in license.recognise(docs, {"size": ["für Größen"]}, [("Own", ["size"])]).collect()] == [4]


def test_licence_rules_need_their_order(spark):
    one, two, three = licence_text(["bsd-use", "bsd-source", "bsd-binary"])
    clause = licence_text(["bsd-name"])[0]
    cases = [
        ("\n".join([one, two, three]), ["BSD-2-Clause"]), ("\n".join([one, three, two]), []), ("\n".join([one, two, "Other words.", three]), []),
        ("\n".join([one, two, three, clause]), ["BSD-3-Clause"]), ("Released under the MIT License. RELEASED under the mit license", ["MIT", "MIT"]),
        ("Released under the MIT Licenses.", []), ("Not, I think.\nReleased under the MIT License, or so.", []),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in license.recognise(docs).collect():
        got[r.doc_id].append(r.license)
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]
    assert license.recognise(docs.limit(0)).collect() == []


def test_digests_of_the_query(spark, tmp_path, word_model):
    from sparkdocs.llm.registry import op8_automaton

    docs_of(spark, ["Hello World", None]).write.parquet(f"{tmp_path}/documents.parquet")
    library = tokenizers.Tokenizer.from_str(word_model)
    got = {r.doc_id: r for r in op8_automaton(spark, str(tmp_path)).collect()}
    for i, t in enumerate(["Hello World", ""]):
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
