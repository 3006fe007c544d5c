"""Language identification: interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdocs.llm.common import CACHE_WORDS
from sparkdocs.llm.quality import free_name
from sparkdocs.operators.sizes import keyed_join
from sparkdocs.session import stage

ORDER = 5
# Labelled rows a language is learned from, and further ones that calibrate; both bounds are expected counts.
TRAIN_ROWS = 3_000
CALIBRATION_ROWS = 1_000
# Calibration texts of a language whose cross-entropy may lie above its limit, and the room added beyond.
LIMIT_QUANTILE = 0.995
LIMIT_ROOM = 1.5
LIMIT_SHORT = 4.0
LEAST_SCORE = 0.5
# Text bytes whose words a task holds at a time (a longer text goes alone).
SLICE_BYTES = 2_000_000
# Calibration texts are also scored as far as these many characters, so that scores fit short texts too.
CUTS = [20, 60, 200]
# A language with fewer labelled rows is learned from all of them and not calibrated.
LEAST_ROWS = 10

UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)
_START, _END = 1, 2  # code points that no word holds


def letter_words(text: str | None) -> list[str]:
    """Runs of letters in lower case; what has no letter at all is left out by `spell`."""
    return [] if text is None else _LETTERS.findall(text.lower())


def spell(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each between _START and _END, and the length of each spelled word."""
    codes = np.frombuffer("".join("\x01" + w + "\x02" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.array([len(w) + 2 for w in words])


def gram_hashes(codes: np.ndarray, lengths: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """For n = 1..order: hash of the n-gram that ends at each position, 0 where the word begins later."""
    start = np.repeat(np.cumsum(lengths) - lengths, lengths)
    depth = np.arange(len(codes)) - start
    out, wide = [], codes.astype(np.uint64)
    acc = np.zeros(len(codes), np.uint64)
    power = np.uint64(1)
    with np.errstate(over="ignore"):
        for n in range(1, order + 1):
            shifted = np.concatenate((np.zeros(n - 1, np.uint64), wide))[: len(wide)]
            acc = acc + (shifted + np.uint64(7)) * power
            power = power * _MUL
            h = acc ^ (acc >> np.uint64(29))
            h = h * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(32))) | np.uint64(1)
            out.append(np.where(depth >= n - 1, h, np.uint64(0)))
    return out


def kneser_ney(words: list[str], counts: np.ndarray, alphabet: int, order: int = ORDER):
    """(order, sorted hashes, log probability, log weight of the context when it backs off) per order.

    The highest order and grams that begin a word use their counts, others the number of distinct
    characters before them. One discount per order, n1 / (n1 + 2 n2). `alphabet` spreads what the first
    order leaves over all characters.
    """
    codes, lengths = spell(words)
    weight = np.repeat(counts, lengths).astype(np.float64)
    grams = gram_hashes(codes, lengths, order + 1)
    start = np.repeat(np.cumsum(lengths) - lengths, lengths)
    depth = np.arange(len(codes)) - start
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    lower: dict[int, np.ndarray] = {}
    for n in range(1, order + 1):
        # The start sign is context only: position 0 is never predicted.
        here = np.flatnonzero((depth >= n - 1) & (depth >= 1))
        h, first, inverse = np.unique(grams[n - 1][here], return_index=True, return_inverse=True)
        raw = np.bincount(inverse, weight[here], len(h))
        at = here[first]
        begins = depth[at] == n - 1
        if n < order:
            longer = here[depth[here] >= n]
            _, one = np.unique(grams[n][longer], return_index=True)
            index = np.searchsorted(h, grams[n - 1][longer[one]])
            c = np.where(begins, raw, np.bincount(index, minlength=len(h)))
        else:
            c = raw
        c = np.maximum(c, 1.0)
        ones, twos = (c == 1).sum(), (c == 2).sum()
        discount = ones / (ones + 2.0 * twos) if ones else 0.5
        discount = min(max(discount, 0.05), 0.95)
        if n == 1:
            total = c.sum()
            p = (c - discount) / total + discount * len(h) / total / alphabet
            rest_of = np.log(discount * len(h) / total)
            tables.append((h, np.log(p), np.full(1, rest_of)))
        else:
            context = grams[n - 2][at - 1]
            ctx, inv = np.unique(context, return_inverse=True)
            total = np.bincount(inv, c)
            rest = discount * np.bincount(inv) / total
            below, below_p = tables[-1][0], lower[n - 1]
            p = (c - discount) / total[inv] + rest[inv] * below_p[np.searchsorted(below, grams[n - 2][at])]
            tables.append((h, np.log(p), np.empty(0)))
            lower[-n] = (ctx, np.log(rest))
        lower[n] = p
    out = [(1, tables[0][0], tables[0][1], np.empty(0, np.uint64), tables[0][2])]
    for n in range(2, order + 1):
        ctx, rest = lower[-n]
        out.append((n, tables[n - 1][0], tables[n - 1][1], ctx, rest))
    return out


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Scorer:
    """Log probability of words under every language's model."""

    def __init__(self, models: dict[str, list], alphabet: int):
        self.langs = sorted(models)
        self.models = models
        self.alphabet = alphabet
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.langs)))
        self.sizes = np.zeros(0, np.int64)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log probabilities, predicted characters) per word; no characters for words without a letter."""
        codes, lengths = spell(words)
        grams = gram_hashes(codes, lengths)
        first = np.cumsum(lengths) - lengths
        inner = np.ones(len(codes), bool)
        inner[first] = False
        ask = np.flatnonzero(inner)
        out = np.zeros((len(words), len(self.langs)))
        for k, lang in enumerate(self.langs):
            value = np.zeros(len(codes))
            left = ask
            for n, hashes, logp, contexts, rest in reversed(self.models[lang]):
                deep = grams[n - 1][left] != 0
                at, hit = _find(hashes, grams[n - 1][left])
                hit &= deep
                value[left[hit]] += logp[at[hit]]
                miss = left[~hit]
                if n > 1:
                    at, seen = _find(contexts, grams[n - 2][miss - 1])
                    seen &= deep[~hit]
                    value[miss[seen]] += rest[at[seen]]
                else:
                    value[miss] += rest[0] - np.log(self.alphabet)
                left = miss
            out[:, k] = np.add.reduceat(value, first)
        size = np.array([len(w) + 1 if any(c.isalpha() for c in w) else 0 for w in words])
        out[size == 0] = 0
        return out, size

    def texts(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per predicted character of every text and language, and the characters."""
        if len(self.index) > CACHE_WORDS:
            self.reset()
        split = [letter_words(t) for t in texts]
        new = list({w for words in split for w in words if w not in self.index})
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            scores, sizes = self.words(part)
            self.index.update(zip(part, range(len(self.sizes), len(self.sizes) + len(part))))
            self.scores = np.concatenate((self.scores, scores))
            self.sizes = np.concatenate((self.sizes, sizes))
        entropy = np.zeros((len(texts), len(self.langs)))
        n = np.zeros(len(texts), np.int64)
        for i, words in enumerate(split):
            if words:
                ids = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
                n[i] = self.sizes[ids].sum()
                if n[i]:
                    entropy[i] = -self.scores[ids].sum(axis=0) / n[i]
        return entropy, n


def _count_words(batches):
    for batch in batches:
        seen: dict[tuple[str, str], int] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for w in letter_words(text):
                seen[lang, w] = seen.get((lang, w), 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())],
            ["lang", "word", "n"],
        )


_TABLES = "lang string, n int, hashes binary, logp binary, contexts binary, rest binary"


def _fit(alphabet: int):
    """One row per order of a language's model, its arrays as bytes, sorted by hash."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["word"].map(lambda w: any(c.isalpha() for c in w))]
        tables = kneser_ney(rows["word"].tolist(), rows["n"].to_numpy(), alphabet) if len(rows) else []
        out = [(key[0], n, h.tobytes(), p.tobytes(), ctx.tobytes(), rest.tobytes()) for n, h, p, ctx, rest in tables]
        return pd.DataFrame(out, columns=[x.split(" ")[0] for x in _TABLES.split(", ")])

    return run


def _share(held: Column, salt: int) -> Column:
    """Evenly spread number from 0 to 1 per row, from its id and text."""
    return F.pmod(F.xxhash64(held, "text", F.lit(salt)), F.lit(1_000_000)) / 1_000_000


class LanguageModel:
    """Models of all learned languages with the calibration of scores and of the rejection.

    The score is the share of the best language in a softmax over the languages and one class more, "none
    of them", whose cross-entropy is the best language's limit. So it falls where two languages are close
    and where a text is unlike its language, to a half at the limit and to 0 beyond.
    """

    def __init__(self, models, alphabet: int, sharpness: float = 1.0, limits: dict[str, float] | None = None):
        self.models, self.alphabet, self.sharpness, self.limits = models, alphabet, sharpness, limits or {}

    def judge(self, entropy: np.ndarray, n: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
        """(language, score, rejected) per text."""
        langs = sorted(self.models)
        if not langs:
            return [UNKNOWN] * len(n), np.zeros(len(n)), np.ones(len(n), bool)
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(len(n)), best]
        limit = np.array([self.limits.get(x, np.inf) for x in langs])[best]
        bound = limit + LIMIT_SHORT / np.sqrt(np.maximum(n, 1))  # a short text says less
        lift = self.sharpness * np.sqrt(n)
        odds = np.exp(-lift[:, None] * (entropy - low[:, None])).sum(axis=1)
        with np.errstate(over="ignore"):
            none = np.where(np.isfinite(bound), np.exp(np.minimum(-lift * (bound - low), 700.0)), 0.0)
        score = np.where(n > 0, 1 / (odds + none), 0.0)
        rejected = (n == 0) | (low > bound) | (score < LEAST_SCORE)
        return [langs[b] if k else UNKNOWN for b, k in zip(best, n)], score, rejected


def learn(docs: DataFrame, held_out: Column) -> LanguageModel:
    """Fit on rows with a text and a language where `held_out` is false.

    A language is learned from about TRAIN_ROWS of its rows and calibrated on about CALIBRATION_ROWS
    others, both picked evenly by hash, so the model has a bound whatever the corpus.
    """
    spark = docs.sparkSession
    labelled = docs.filter(~held_out & F.col("text").isNotNull() & F.col("lang").isNotNull()).select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    share = _share(F.col("id"), 1)
    # Small languages give a fifth of their rows to the calibration, very small ones none.
    few = F.col("n") < LEAST_ROWS
    calibrated = F.when(few, 0.0).otherwise(F.least(F.lit(0.2), CALIBRATION_ROWS / F.col("n")))
    trained = F.when(few, 1.0).otherwise(F.least(F.lit(0.8), TRAIN_ROWS / F.col("n")))
    mark = F.when(share < calibrated, "calibrate").when(share >= 1 - trained, "train")
    # The pick goes by id and text, so of rows that repeat both one is enough; repeats would break the bound.
    rated = keyed_join(labelled, sizes, ["lang"])
    picked = rated.withColumn("use", mark).filter("use IS NOT NULL").dropDuplicates(["use", "lang", "id", "text"])
    chosen = stage(picked.select("use", "lang", "text"))
    words = stage(
        chosen.filter("use = 'train'").select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long")
        .groupBy("lang", "word").agg(F.sum("n").alias("n"))
    )
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).agg(F.count_distinct("c")).first()[0]
    alphabet = int(letters or 0) + 2
    models: dict[str, list] = {}
    # A few rows per language, of a size that the training rows bound.
    for r in words.groupBy("lang").applyInPandas(_fit(alphabet), _TABLES).orderBy("lang", "n").collect():
        hashes, contexts = (np.frombuffer(x, np.uint64) for x in (r.hashes, r.contexts))
        models.setdefault(r.lang, []).append((r.n, hashes, np.frombuffer(r.logp), contexts, np.frombuffer(r.rest)))
    model = LanguageModel(models, alphabet)
    if models:
        _calibrate(spark, model, chosen.filter("use = 'calibrate'"))
    return model


def _slices(texts: pa.Array):
    """Lists of texts with at most SLICE_BYTES together, or a single longer one."""
    start = held = 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > start and held + size > SLICE_BYTES:
            yield texts.slice(start, i - start).to_pylist()
            start, held = i, 0
        held += size
    yield texts.slice(start).to_pylist()


def _entropies(shared):
    """(lang, n_letters, entropies) of calibration texts."""

    def run(batches):
        model = shared.value
        scorer = Scorer(model.models, model.alphabet)
        for batch in batches:
            found = [scorer.texts(part) for part in _slices(batch.column(1))]
            entropy, n = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n), pa.array(list(entropy), pa.list_(pa.float64()))],
                ["lang", "whole", "n_letters", "entropies"],
            )

    return run


def fit_sharpness(entropy: np.ndarray, n: np.ndarray, truth: np.ndarray) -> float:
    """Sharpness with the least log loss over a grid; one imagined wrong text in hundred keeps it finite."""
    lift = np.sqrt(n)[:, None] * (entropy - entropy.min(axis=1, keepdims=True))
    best = None
    for sharp in np.geomspace(0.05, 20, 40):
        odds = np.exp(-sharp * lift)
        share = odds / odds.sum(axis=1, keepdims=True)
        right = share[np.arange(len(truth)), truth]
        other = (1 - right) / max(1, entropy.shape[1] - 1)
        loss = -(0.99 * np.log(np.maximum(right, 1e-12)) + 0.01 * np.log(np.maximum(other, 1e-12))).mean()
        if best is None or loss < best[0]:
            best = (loss, sharp)
    return float(best[1])


def _calibrate(spark, model: LanguageModel, rows: DataFrame) -> None:
    """Sharpness from whole and cut texts, and a limit of cross-entropy per language from whole ones."""
    shared = spark.sparkContext.broadcast(model)
    text = F.col("text")
    cuts = F.array(*[F.struct(F.substring(text, 1, k).alias("text"), F.lit(False).alias("whole")) for k in CUTS], F.struct(text, F.lit(True).alias("whole")))
    every = rows.select("lang", F.explode(cuts).alias("c")).select("lang", "c.text", "c.whole")
    kinds = "lang string, whole boolean, n_letters long, entropies array<double>"
    seen = every.mapInArrow(_entropies(shared), kinds).filter("n_letters > 0").collect()
    shared.destroy()
    langs = sorted(model.models)
    known = [r for r in seen if r.lang in model.models]
    if known:
        entropy, n = np.array([r.entropies for r in known]), np.array([r.n_letters for r in known])
        model.sharpness = fit_sharpness(entropy, n, np.array([langs.index(r.lang) for r in known]))
    for k, lang in enumerate(langs):
        part = [min(r.entropies) for r in known if r.whole and r.lang == lang and int(np.argmin(r.entropies)) == k]
        if part:
            high, mid = np.quantile(part, LIMIT_QUANTILE), np.median(part)
            model.limits[lang] = float(high + LIMIT_ROOM * max(high - mid, 0.1))


_FOUND = "lang_pred string, score double, rejected boolean, cross_entropy double, n_letters long"


def identify(docs: DataFrame, model: LanguageModel, name: str = "language", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all) of `docs` with a struct `name`: lang_pred, score, rejected, cross_entropy, n_letters.

    lang_pred is the language of the lowest cross-entropy per character over the whole text, or `und`
    for a null text and for one without a letter (score 0). Only the text is looked at. `rejected` holds
    for those, for a cross-entropy above the language's calibrated limit, and for a score below
    LEAST_SCORE. Ties go to the first language by name. Every row is judged for itself, repeated ones too;
    an empty table gives no rows. The models are broadcast; their size is bounded by the rows they were
    learned from.

    The text alone goes to Python, once; all other columns stay where they are.
    """
    name = free_name(docs, name)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(_FOUND)
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        scorer = Scorer(model.models, model.alphabet)
        for texts in batches:
            parts = []
            for part in _slices(texts):
                entropy, n = scorer.texts(part)
                lang, score, rejected = model.judge(entropy, n)
                low = entropy.min(axis=1) if entropy.shape[1] else np.zeros(len(n))
                parts.append(
                    pa.StructArray.from_arrays(
                        [pa.array(lang, pa.string()), pa.array(score), pa.array(rejected), pa.array(low), pa.array(n)],
                        [x.split(" ")[0] for x in _FOUND.split(", ")],
                    )
                )
            yield pa.concat_arrays(parts)
            del parts, texts
            pa.default_memory_pool().release_unused()

    columns = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]
    return docs.select(*columns, judged(F.col("text").cast("string")).alias(name))
