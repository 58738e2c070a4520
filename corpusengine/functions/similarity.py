"""Similarities and stemming that built-in functions don't offer, as Arrow functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType


@pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def ratio_bound(a: Column, b: Column) -> Column:
    """No two texts of these lengths are more similar than this."""
    return F.when(F.length(a) + F.length(b) == 0, 1.0).otherwise(2.0 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b)))


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff/Obershelp similarity."""
    return _ratio(a, b)


def _measure(word: str) -> int:
    forms = "".join("c" if _consonant(word, i) else "v" for i in range(len(word)))
    return sum(1 for x, y in zip(forms, forms[1:], strict=False) if x == "v" and y == "c")


def _consonant(word: str, i: int) -> bool:
    if word[i] in "aeiou":
        return False
    return word[i] != "y" or i == 0 or not _consonant(word, i - 1)


def _has_vowel(word: str) -> bool:
    return any(not _consonant(word, i) for i in range(len(word)))


def _cvc(word: str) -> bool:
    return len(word) > 2 and _consonant(word, len(word) - 1) and not _consonant(word, len(word) - 2) and _consonant(word, len(word) - 3) and word[-1] not in "wxy"


# Suffixes and replacements of the published Porter algorithm, by step.
STEP2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble")
STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def porter(word: str) -> str:
    """Stem of a lower-case word (Porter 1980)."""
    if len(word) <= 2:
        return word
    w = word
    if w.endswith("s") and not w.endswith("ss"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        for end in sorted(table, key=len, reverse=True):
            if w.endswith(end):
                w = w[: -len(end)] + table[end] if _measure(w[: -len(end)]) > 0 else w
                break
    for end in sorted(STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@pandas_udf(StringType())
def _stem(terms: pd.Series) -> pd.Series:
    return terms.map(porter)


def stems(terms: DataFrame, column: str = "term") -> DataFrame:
    """(term, stem) of the distinct terms only."""
    return terms.select(column).distinct().withColumn("stem", _stem(F.col(column)))
