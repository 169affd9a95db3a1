"""Porter's stemmer for terms in lower case, as a function of a word, of a column, and as SQL over a vocabulary."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The published algorithm's suffixes and what they become, step by step.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
SHORTEST, LONGEST = 3, 64  # bytes of a term that is stemmed

# A word is [C](VC){m}[V]: runs of consonants and vowels, y being a vowel after a consonant. m > 0, m = 1, m > 1 as patterns.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
SOME, ONE, MORE = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$", f"^({_C})?{_V}{_C}{_V}{_C}"
VOWEL = f"^({_C})?[aeiouy]"
#: Consonant, vowel, consonant other than w, x and y at the end; the last is one byte long.
SHORT = f"^{_C}[aeiouy][^aeiouwxy\\x{{80}}-\\x{{10FFFF}}]$"
DOUBLE = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|yy|00|11|22|33|44|55|66|77|88|99)$"

_some, _one, _more, _vowel, _double = (re.compile(p) for p in (SOME, ONE, MORE, VOWEL, DOUBLE))
_short = re.compile(SHORT.replace("\\x{80}-\\x{10FFFF}", "\x80-\U0010ffff"))


def _by_letter(suffixes: Iterable[str]) -> dict[str, tuple[str, ...]]:
    """Suffixes by their last letter, longest first."""
    return {x: tuple(sorted((s for s in suffixes if s[-1] == x), key=len, reverse=True)) for x in {s[-1] for s in suffixes}}


_in_step_2, _in_step_3, _in_step_4, _in_step_b = (_by_letter(x) for x in (STEP_2, STEP_3, STEP_4, ("ing", "ed")))


def _suffix(word: str, suffixes: dict[str, tuple[str, ...]]) -> str | None:
    some = suffixes.get(word[-1:])
    return next((s for s in some if word.endswith(s)), None) if some and word.endswith(some) else None


#: No term that ends in another character is changed.
_LAST = frozenset("sdgyel").union(_in_step_2, _in_step_3, _in_step_4)


def stem(word: str) -> str:
    """The stem of a term; very short and very long terms stay."""
    return _stem(word) if word[-1:] in _LAST else word


@lru_cache(1 << 18)
def _stem(word: str) -> str:
    if not SHORTEST <= len(word.encode()) <= LONGEST:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _some.search(word[:-3]):
            word = word[:-1]
    else:
        cut = _suffix(word, _in_step_b)
        if cut and _vowel.search(word[: -len(cut)]):
            word = word[: -len(cut)]
            if word.endswith(("at", "bl", "iz")) or (not _double.search(word) and _one.search(word) and _short.search(word)):
                word += "e"
            elif _double.search(word):
                word = word[:-1]
    if word.endswith("y") and _vowel.search(word[:-1]):
        word = word[:-1] + "i"
    for rules, suffixes in ((STEP_2, _in_step_2), (STEP_3, _in_step_3)):
        cut = _suffix(word, suffixes)
        if cut and _some.search(word[: -len(cut)]):
            word = word[: -len(cut)] + rules[cut]
    cut = _suffix(word, _in_step_4)
    if cut and _more.search(word[: -len(cut)]) and (cut != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(cut)]
    if word.endswith("e") and (_more.search(word[:-1]) or (_one.search(word[:-1]) and not _short.search(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _more.search(word[:-1]):
        word = word[:-1]
    return word


@F.pandas_udf(StringType())
def stemmed(terms: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The stems of a column of terms; each distinct term of a batch is worked out once."""
    for some in terms:
        codes, distinct = pd.factorize(some)
        found = pd.Series([stem(t) for t in distinct], dtype="object")
        yield found.reindex(codes).reset_index(drop=True)


def _replaced(word: str, rules: dict[str, str], measure: str, more: str = "true") -> str:
    """SQL: the word with the longest suffix of the rules replaced, if the rest has the measure."""
    cases = []
    for suffix in sorted(rules, key=len, reverse=True):
        rest = f"left({word}, length({word}) - {len(suffix)})"
        extra = f"AND right({rest}, 1) IN ('s', 't')" if more == "ion" and suffix == "ion" else ""
        cases.append(f"WHEN right({word}, {len(suffix)}) = '{suffix}' THEN CASE WHEN regexp_matches({rest}, '{measure}') {extra} THEN {rest} || '{rules[suffix]}' ELSE {word} END")
    return f"CASE {' '.join(cases)} ELSE {word} END"


def stems_sql(vocabulary: str) -> str:
    """CTEs, the last of which is `stems` (term, stem), for SQL that selects the distinct terms as `term`."""
    cut = "left(w, length(w) - {})".format
    has = "regexp_matches({}, '{}')".format
    ends = "right(w, {}) {}".format
    step_b = (
        f"CASE WHEN {ends(3, "= 'eed'")} THEN 0 WHEN {ends(2, "= 'ed'")} AND {has(cut(2), VOWEL)} THEN 2 WHEN {ends(3, "= 'ing'")} AND {has(cut(3), VOWEL)} THEN 3 ELSE 0 END"
    )
    steps = [
        ("a", f"CASE WHEN {ends(4, "= 'sses'")} OR {ends(3, "= 'ies'")} THEN {cut(2)} WHEN {ends(1, "= 's'")} AND {ends(2, "<> 'ss'")} THEN {cut(1)} ELSE w END"),
        ("b", f"CASE WHEN {ends(3, "= 'eed'")} AND {has(cut(3), SOME)} THEN {cut(1)} ELSE left(w, length(w) - ({step_b})) || CASE WHEN {step_b} > 0 THEN '!' ELSE '' END END"),
        ("c", f"CASE WHEN right(w, 1) <> '!' THEN w WHEN right({cut(1)}, 2) IN ('at', 'bl', 'iz') THEN {cut(1)} || 'e' WHEN {has(cut(1), DOUBLE)} THEN {cut(2)} WHEN {has(cut(1), ONE)} AND {has(cut(1), SHORT)} THEN {cut(1)} || 'e' ELSE {cut(1)} END"),
        ("d", f"CASE WHEN {ends(1, "= 'y'")} AND {has(cut(1), VOWEL)} THEN {cut(1)} || 'i' ELSE w END"),
        ("e", _replaced("w", STEP_2, SOME)),
        ("f", _replaced("w", STEP_3, SOME)),
        ("g", _replaced("w", dict.fromkeys(STEP_4, ""), MORE, "ion")),
        ("h", f"CASE WHEN {ends(1, "= 'e'")} AND ({has(cut(1), MORE)} OR ({has(cut(1), ONE)} AND NOT {has(cut(1), SHORT)})) THEN {cut(1)} ELSE w END"),
        ("i", f"CASE WHEN {ends(2, "= 'll'")} AND {has(cut(1), MORE)} THEN {cut(1)} ELSE w END"),
    ]
    ctes, before = [f"stem_0 AS (SELECT DISTINCT term, term AS w FROM ({vocabulary}))"], "stem_0"
    for name, change in steps:
        ctes.append(f"stem_{name} AS (SELECT term, CASE WHEN strlen(term) BETWEEN {SHORTEST} AND {LONGEST} THEN {change} ELSE w END AS w FROM {before})")
        before = f"stem_{name}"
    return ", ".join([*ctes, f"stems AS (SELECT term, w AS stem FROM {before})"])
