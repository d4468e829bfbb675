"""Text expressions: query terms, index tokens, stems, titles and snippets."""

from __future__ import annotations

import unicodedata
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BREAK = "[^\\p{IsAlphabetic}\\p{N}]+"


def query_terms(query: Column) -> Column:
    """The words of a query, in order, duplicates kept: runs of letters and digits."""
    return F.array_remove(F.split(query, _BREAK), "")


@cache
def _accents() -> tuple[str, str]:
    """Accented Latin, Greek and Cyrillic letters and what is left of each without its marks."""
    pairs = []
    for cp in range(0xC0, 0x530):
        base = unicodedata.normalize("NFD", chr(cp))
        if len(base) > 1 and base[0].isalpha():
            pairs.append((chr(cp), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower case without combining marks."""
    return F.lower(F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(text, *_accents())).otherwise(text))


def tokens(text: Column) -> Column:
    """Index tokens of a text, unstemmed: folded runs of letters and digits. A text of ASCII alone has a class of characters that is
    faster to match."""
    plain = F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")
    return F.when(F.length(text) == F.octet_length(text), plain).otherwise(query_terms(fold(text)))


def spelled(text: Column) -> Column:
    """A text that `letters` cuts into its `tokens`: the text itself, or the tokens in a row where it has other characters than `letters` knows."""
    plain = (F.length(text) == F.octet_length(text)) | ~text.rlike("[^\\x00-\\x{24F}\\x{2000}-\\x{206F}]")
    return F.when(plain, text).otherwise(F.array_join(tokens(text), " "))


@cache
def letters() -> np.ndarray:
    """What `tokens` makes of each Latin character and mark of punctuation: a folded letter, a digit, or 0 between words. Others stay."""
    fold, out = dict(zip(*_accents(), strict=True)), np.arange(0x2070, dtype=np.uint32)
    for cp in (*range(0x250), *range(0x2000, 0x2070)):
        c = fold.get(chr(cp), chr(cp)).lower()
        out[cp] = ord(c) if c.isalpha() or unicodedata.category(c)[0] == "N" else 0
    return out


_VOWELS = "aeiou"
_KINDS = {ord(c): "v" if c in _VOWELS else "c" for c in "abcdefghijklmnopqrstuvwxyz"}


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    if "y" not in word:
        return word.translate(_KINDS)
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in _VOWELS or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    return _shape(word).count("vc")


def _short(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


# The suffixes of Porter's published steps 2, 3 and 4, and what replaces them.
_STEP2 = "ational ate,tional tion,enci ence,anci ance,izer ize,bli ble,alli al,entli ent,eli e,ousli ous,ization ize,ation ate,ator ate,alism al,iveness ive,fulness ful,ousness ous,aliti al,iviti ive,biliti ble,logi log"
_STEP3 = "icate ic,ative ,alize al,iciti ic,ical ic,ful ,ness "
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _longest(word: str, rules: dict[str, str]) -> str | None:
    return next((word[-n:] for n in range(7, 1, -1) if word[-n:] in rules), None)  # no suffix is longer than 7 or shorter than 2


_RULES = [dict(r.split(" ") for r in s.split(",")) for s in (_STEP2, _STEP3)]
_LAST = dict.fromkeys(_STEP4.split(), "")


@lru_cache(1 << 18)
def porter(word: str) -> str:
    """Porter's stem of a lower-case word; words of other than a-z, or of one or two letters, stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in _shape(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in _RULES:
        end = _longest(word, rules)
        if end and _measure(word[: -len(end)]) > 0:
            word = word[: -len(end)] + rules[end]
    end = _longest(word, _LAST)
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short(stem)):
            word = stem
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def stemmed(rows: DataFrame, term: str = "term") -> DataFrame:
    """`rows` with `term` stemmed. Each distinct term goes through Python once."""

    @F.pandas_udf("string")
    def stem(terms: pd.Series) -> pd.Series:
        return terms.map(lambda t: None if t is None else porter(t))

    stems = rows.select(F.col(term).alias("_t")).distinct().withColumn("_stem", stem("_t"))
    return rows.join(stems, F.col(term) == F.col("_t")).withColumn(term, F.col("_stem")).drop("_t", "_stem")


def title(path: Column) -> Column:
    """The file name without a last .md, in any case."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), "(?i)(?<=.)\\.md$", "")


def flat(text: Column) -> Column:
    """`text` with each run of white space as one blank."""
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def head_snippet(text: Column, size: int = 160) -> Column:
    """The first `size` characters of the flattened text; an ellipsis where it goes on."""
    f = flat(text)
    return F.when(F.length(f) > size, F.concat(F.rtrim(F.substring(f, 1, size)), F.lit("…"))).otherwise(f)


def snippet(text: Column, terms: Column, size: int = 160, lead: int = 24) -> Column:
    """Around the first place of any term of two characters or more, `lead` characters before it;
    the head of the text where that place is within the lead or no term occurs."""
    f = flat(text)
    places = F.transform(F.filter(terms, lambda t: F.length(t) >= 2), lambda t: F.call_function("instr", F.lower(f), F.lower(t)) - 1)
    at = F.array_min(F.filter(places, lambda p: p >= 0))
    tail = F.substring(f, at - lead + 1, F.lit(size))
    more = F.length(f) > at - lead + size
    cut = F.concat(F.lit("…"), F.ltrim(F.when(more, F.concat(F.rtrim(tail), F.lit("…"))).otherwise(tail)))
    return F.when(F.coalesce(at, F.lit(0)) <= lead, head_snippet(text, size)).otherwise(cut)


def find_all(text: Column, needle: Column, most: int = 1000) -> Column:
    """0-based places of a literal needle, case ignored, not overlapping; the first `most` of them."""
    parts = F.split(F.lower(text), F.concat(F.lit("\\Q"), F.lower(needle), F.lit("\\E")))
    lengths = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.length(p))
    step = F.length(needle)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    walk = F.aggregate(lengths, start, lambda s, n: F.struct((s["at"] + n + step).alias("at"), F.concat(s["out"], F.array(s["at"] + n)).alias("out")))
    return F.when(F.length(needle) > 0, F.slice(walk["out"], 1, most)).otherwise(F.array().cast("array<int>"))


def citations(answer: Column, passages: Column) -> Column:
    """The distinct markers [n] of an answer from 1 to `passages`, ascending."""
    found = F.transform(F.regexp_extract_all(answer, F.lit("\\[(\\d+)\\]"), F.lit(1)), lambda m: m.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda n: (n >= 1) & (n <= passages))))


def trigger(before: Column) -> Column:
    """What is typed in an open [[ at the end of the line before the caret; null without one, after it is
    closed, and after a |."""
    return F.when(before.rlike("(?s)\\[\\[[^\\[\\]|]*$"), F.regexp_extract(before, "(?s)\\[\\[([^\\[\\]|]*)$", 1))
