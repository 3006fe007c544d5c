"""Token strings, term patterns and trigrams.

A text is lower-cased and cut into runs of letters and digits; runs of CJK characters become character
bigrams. The token string holds every token with a blank on both sides of its own (`"  a  b  "`), so a
term is a substring test and a phrase a longer substring: the form to store and to build postings from.
A single search reads the text itself instead, with one pattern per term that accepts the same tokens.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kana, ideographs, compatibility ideographs, Hangul syllables, supplementary ideographs.
_CJK_RANGES = [(0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xAC00, 0xD7AF), (0x20000, 0x2FA1F)]

_CJK = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in _CJK_RANGES)
_CJK_PYTHON = "".join(f"{chr(a)}-{chr(b)}" for a, b in _CJK_RANGES)
_WORD = rf"[\p{{L}}\p{{N}}&&[^{_CJK}]]"
_GAP = r"[^\p{L}\p{N}]"
_BIGRAMS = (
    rf"([{_CJK}])(?=([{_CJK}]))"  # a character and its successor
    rf"|(?<=[{_CJK}])[{_CJK}]"  # the last one of a run adds nothing
    rf"|([{_CJK}])"  # a run of one
)
# Overlapping windows of three; one that ends in two blanks lies between words.
_WINDOWS = r"(?=([ \p{L}\p{N}](?:[ \p{L}\p{N}][\p{L}\p{N}]|[\p{L}\p{N}] )))"


def _padded(words: Column) -> Column:
    return F.regexp_replace(F.concat(F.lit(" "), words, F.lit(" ")), f"{_GAP}+", "  ")


def word_string(text: Column) -> Column:
    """Blank-padded words without the CJK rule."""
    return _padded(F.lower(text))


def has_cjk(text: Column) -> Column:
    """True if the tokens of a text are not just its words."""
    return F.lower(text).rlike(f"[{_CJK}]")


def token_string(text: Column) -> Column:
    low = F.lower(text)
    cjk = F.regexp_replace(low, _BIGRAMS, " $1$2$3 ")
    return _padded(F.when(low.rlike(f"[{_CJK}]"), cjk).otherwise(low))


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.trim(token_string(text)), "  "), "")


# Stands before the tokens of a CJK run; no lower-cased text holds it.
RUN_START = "S"


def placed_tokens(text: Column) -> Column:
    """Tokens with RUN_START before each CJK run, so that places tell bigrams of one run from those of two."""
    low = F.lower(text)
    marked = F.regexp_replace(low, rf"(?<![{_CJK}])(?=[{_CJK}])", f" {RUN_START} ")
    padded = _padded(F.when(low.rlike(f"[{_CJK}]"), F.regexp_replace(marked, _BIGRAMS, " $1$2$3 ")).otherwise(low))
    return F.array_remove(F.split(F.trim(padded), "  "), "")


def term_pattern(term: str) -> tuple[str, str]:
    """Pattern of a word, phrase or `prefix*` in lower-cased text, and a substring every match holds.

    A word ends where another kind of character follows. Bigrams of one CJK run stand for the run
    itself; a single CJK character is a token only if it is alone.
    """
    open_end = term.endswith("*")
    runs = re.findall(rf"[{_CJK_PYTHON}]+|[^\W_{_CJK_PYTHON}]+", term.lower())
    parts = []
    for i, run in enumerate(runs):
        first, last = i == 0, i == len(runs) - 1
        if re.match(f"[{_CJK_PYTHON}]", run):
            lead = "" if first and len(run) > 1 else f"(?<![{_CJK}])"
            tail = "" if last and len(run) > 1 else f"(?![{_CJK}])"
            if last and open_end and len(run) == 1:
                parts.append(f"(?:(?<![{_CJK}]){run}(?![{_CJK}])|{run}(?=[{_CJK}]))" if first else lead + run)
                continue
        else:
            lead = f"(?={run[0]})(?<!{_WORD})"  # the first character is the cheapest test
            tail = "" if last and open_end else f"(?!{_WORD})"
        parts.append(lead + run + tail)
    return f"{_GAP}*".join(parts), max(runs, key=len)


def matches_term(text: Column, term: str) -> Column:
    """True if a text holds a term. The substring test spares most texts the pattern."""
    pattern, part = term_pattern(term)
    low = F.lower(text)
    return F.contains(low, F.lit(part)) & low.rlike(pattern)


def count_term(text: Column, term: str) -> Column:
    """Occurrences of a term in a text; they may overlap."""
    pattern, _ = term_pattern(term)
    return F.regexp_count(F.lower(text), F.lit(f"(?={pattern})")).cast("long")


def has_tokens(text: str) -> bool:
    return any(ch.isalnum() for ch in text)


def occurrences(token_str: Column, needle: Column) -> Column:
    """How often a blank-padded token or token prefix occurs in a token string."""
    cut = F.length(token_str) - F.length(F.replace(token_str, needle, F.lit("")))
    return F.floor(cut / F.length(needle))


def phrase_occurrences(token_str: Column, needle: Column) -> Column:
    """The same for several tokens, where two occurrences may share some."""
    return F.regexp_count(token_str, F.concat(F.lit("(?="), needle, F.lit(")"))).cast("long")


def trigram_set(text: Column) -> Column:
    """Distinct trigrams of a text's words, each padded with two blanks before and one after."""
    return F.array_distinct(F.regexp_extract_all(word_string(text), F.lit(_WINDOWS), F.lit(1)))


def trigram_count(text: Column) -> Column:
    """Number of distinct trigrams of a text."""
    return F.size(trigram_set(text))


def keyword_trigrams(keyword: str) -> list[str]:
    """Distinct trigrams of a short literal: words padded with two blanks before and one after."""
    grams = set()
    for word in re.findall(r"[^\W_]+", keyword.lower()):
        padded = f"  {word} "
        grams.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return sorted(grams)


def trigram_similarity(text: Column, keyword: str, n_trigrams: Column | None = None) -> Column:
    """|A n B| / |A u B| of the trigram sets of a text and a literal.

    The literal's trigrams are tested by substring search, so only the size of the text's own set
    needs the windows; pass it as `n_trigrams` where it is stored.
    """
    grams = keyword_trigrams(keyword)
    if not grams:
        return F.when(text.isNotNull(), F.lit(0.0))
    padded = word_string(text)
    shared = F.lit(0)
    for gram in grams:
        shared = shared + F.contains(padded, F.lit(gram)).cast("int")
    own = trigram_count(text) if n_trigrams is None else n_trigrams
    # No condition around this: Spark shares the padded string between the tests only if all of them
    # are always evaluated. A null text gives null by itself.
    return shared / (own + F.lit(len(grams)) - shared)
