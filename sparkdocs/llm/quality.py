"""Quality rules as weak supervision: rules vote or abstain, EM estimates how far each can be trusted.

Everything is a column expression or an aggregate; no Python runs on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdocs.session import stage

SPACE = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
THRESHOLD = 0.5
ROUNDS = 20
SETTLED = 1e-3
STRAY = 0.01


@dataclass(frozen=True)
class Rule:
    """Votes bad or good where its condition holds, else abstains."""

    name: str
    good: str
    bad: str


# Conditions over the columns of `features`.
RULES = (
    Rule("length", "n_words >= 100", "n_words < 50"),
    Rule("word_length", "word_chars BETWEEN 3 * n_words AND 10 * n_words", "word_chars < 2.5 * n_words OR word_chars > 13 * n_words"),
    Rule("symbols", "n_symbols <= 0.02 * n_words", "n_symbols > 0.1 * n_words"),
    Rule("lines", "n_dup_lines <= 0.1 * n_lines", "n_dup_lines > 0.3 * n_lines"),
    Rule("repeats", "n_repeat_words <= 0.15 * n_words", "n_repeat_words > 0.4 * n_words"),
    Rule("capitals", "n_upper <= 0.15 * n_letters", "n_upper > 0.3 * n_letters"),
    Rule("letters", "n_letters >= 0.85 * word_chars", "n_letters < 0.65 * word_chars"),
    Rule("sentences", "n_ends BETWEEN 0.01 * n_words AND 0.25 * n_words", "n_ends > 0.4 * n_words OR n_ends = 0"),
    Rule("variety", "n_distinct >= 0.35 * n_words", "n_distinct < 0.15 * n_words"),
)


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, with underscores in front until no column of `df` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more, the first occurrence included.

    Windows are compared by a 64-bit hash. Sorting brings equal ones side by side, so the work is
    n log n in one row and no row leaves its place.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0))),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # Each window that equals the one before it in the sorted order, or the one after it.
    again = F.filter(
        F.zip_with(placed, F.slice(placed, F.lit(2), F.greatest(F.size(placed) - 1, F.lit(0))),
                   lambda a, b: F.struct(a["i"].alias("a"), b["i"].alias("b"), (a["h"] == b["h"]).alias("same"))),
        lambda p: p["same"],
    )
    covered = F.flatten(F.transform(
        again, lambda p: F.array(p["a"], p["a"] + 1, p["a"] + 2, p["b"], p["b"] + 1, p["b"] + 2)
    ))
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when((F.size(words) > 3) & repeats, F.size(F.array_distinct(covered))).otherwise(0)


def features(docs: DataFrame, name: str = "features") -> DataFrame:
    """`docs` with a struct of counts over each whole text; a null text has no words."""
    text, words, lines = (free_name(docs, c) for c in ("text_", "words_", "lines_"))
    t, w, ln = F.col(text), F.col(words), F.col(lines)
    trimmed = F.btrim(t, F.lit(SPACE))

    def left(pattern: str) -> Column:
        return F.length(F.regexp_replace(t, pattern, "")).cast("long")

    counts = {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": left("[^#*$%&|<>]+"),
        "n_dup_lines": (F.size(ln) - F.size(F.array_distinct(ln))).cast("long"),
        "n_repeat_words": repeated_words(w).cast("long"),
        "n_lines": F.size(ln).cast("long"),
        "n_distinct": F.size(F.array_distinct(w)).cast("long"),
        "n_letters": left(r"\P{L}+"),
        "n_upper": left(r"\P{Lu}+"),
        "n_ends": F.regexp_count(F.concat(t, F.lit(" ")), F.lit(r"[.!?][ \t\n\x0B\f\r]")).cast("long"),
    }
    return (
        docs.withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit("")))
        .withColumn(words, F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t\n\x0B\f\r]+")))
        .withColumn(lines, F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""))
        .withColumn(name, F.struct(*[v.alias(k) for k, v in counts.items()]))
        .drop(text, words, lines)
    )


def votes(counts: str, rules=RULES) -> Column:
    """One letter per rule: g, b, or - where it abstains; a bad vote wins over a good one."""
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_distinct n_letters n_upper n_ends".split()

    def at(condition: str) -> str:
        return " ".join(f"`{counts}`.{x}" if x in names else x for x in condition.split(" "))

    return F.concat(*[F.when(F.expr(at(r.bad)), "b").when(F.expr(at(r.good)), "g").otherwise("-") for r in rules])


def posteriors(patterns: DataFrame, rules=RULES, rounds: int = ROUNDS) -> tuple[DataFrame, list[float]]:
    """(votes, p_quality) for vote patterns with counts `n`, and the estimated class shares (good first).

    There are at most 3^rules patterns whatever the corpus, so each round is an aggregate over a small
    table. Bad texts are of several kinds that have little in common, so the hidden class is good or one
    defect per rule. In each class a rule that votes has a chance of either vote, abstaining says nothing, and
    rules are independent given the class. A defect starts from the bad votes of its rule. The chances of good texts lean to STRAY bad
    votes with the weight of all good texts: a lone bad vote of a rule that fires seldom is taken for a
    mistake, several together, or one that marks a frequent defect, are not.
    """
    kinds, classes = "gb-", len(rules) + 1
    code = F.transform(F.sequence(F.lit(1), F.lit(len(rules))), lambda j: F.instr(F.lit(kinds), F.substring(F.col("votes"), j, F.lit(1))))
    coded = patterns.withColumn("code", code)
    bad = F.length(F.regexp_replace("votes", "[^b]", ""))
    share = [F.when(bad == 0, 0.95).otherwise(0.1)]
    share += [F.when(bad == 0, 0.05 / len(rules)).when(F.col("code")[j] == 2, 0.9 / bad).otherwise(0.0) for j in range(len(rules))]
    share = F.array(*share)
    before: list[float] = []
    for _ in range(rounds):
        weighted = coded.select("n", "code", F.posexplode(share).alias("c", "r")).select(
            "c", (F.col("n") * F.col("r")).alias("w"), F.posexplode("code").alias("j", "k")
        )
        w = {(x.c, x.j, x.k): x.w for x in weighted.groupBy("c", "j", "k").agg(F.sum("w").alias("w")).collect()}
        size = [sum(w.get((c, 0, k), 0.0) for k in (1, 2, 3)) for c in range(classes)]
        total = sum(size) or 1.0
        prior = [(x + 1e-6 * total) / (total * (1 + classes * 1e-6)) for x in size]
        table = []
        for c in range(classes):
            for j in range(len(rules)):
                seen = [w.get((c, j, k), 0.0) for k in (1, 2)]
                lean = [1 - STRAY, STRAY] if c == 0 else [0.5, 0.5]
                weight = (sum(seen) if c == 0 else 0.01 * sum(seen)) + 1e-9
                table += [math.log((x + weight * y) / (sum(seen) + weight)) for x, y in zip(seen, lean)] + [0.0]
        logs = F.array(*[F.lit(float(x)) for x in table])
        start = F.array(*[F.lit(math.log(x)) for x in prior])
        scores = F.transform(
            F.sequence(F.lit(0), F.lit(classes - 1)),
            lambda c: F.get(start, c) + F.aggregate(
                F.transform(F.col("code"), lambda k, j: F.get(logs, (c * len(rules) + j) * 3 + k - 1)),
                F.lit(0.0), lambda x, y: x + y,
            ),
        )
        raised = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
        share = F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda p, q: p + q))
        if before and max(abs(x - y) for x, y in zip(before, prior)) < SETTLED:
            break
        before = prior
    return coded.select("votes", F.get(share, F.lit(0)).alias("p_quality")), before


def judged(docs: DataFrame, name: str = "quality", rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with a struct `name`: the counts, base_failed, votes, p_quality and kept.

    base_failed holds for fewer than MIN_WORDS words or more than MAX_REPEAT_PERCENT percent of words in
    repeated windows; such rows are not kept. Else the row is kept if its posterior reaches `threshold`.
    Counts and votes are written once to the shared folder with the rows; patterns are counted over all of
    them. Null and empty texts have no words and fail. Repeated rows are judged alike.
    """
    name = free_name(docs, name)
    counts, cast = free_name(docs, "features"), free_name(docs, "votes_")
    voted = features(docs, counts)
    voted = stage(voted.withColumn(cast, votes(counts, rules)))
    patterns = stage(voted.groupBy(F.col(cast).alias("votes")).agg(F.count("*").alias("n")))
    found, _ = posteriors(patterns, rules)
    # 3^rules rows at most: 19,683 for nine rules.
    joined = voted.join(F.broadcast(found.select(F.col("votes").alias("_v"), "p_quality")), F.col(cast) == F.col("_v"), "left")
    c = {k: F.col(f"`{counts}`.{k}") for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
    verdict = F.struct(
        *[v.alias(k) for k, v in c.items()],
        failed.alias("base_failed"),
        (~failed & (F.col("p_quality") >= threshold)).alias("kept"),
        F.col(cast).alias("votes"), F.col("p_quality").alias("p_quality"),
    )
    return joined.select(*[docs_col for docs_col in (F.col(f"`{x}`") for x in docs.columns)], verdict.alias(name))
