"""Stems of English words by Porter's published rules (1980), for full-text search."""

from __future__ import annotations

from functools import lru_cache

VOWELS = set("aeiou")

# Endings of the published rules, step by step, and what takes their place.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(stem: str) -> str:
    """c and v for each letter: y is a vowel after a consonant."""
    out = ""
    for ch in stem:
        out += "v" if ch in VOWELS or ch == "y" and out.endswith("c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often a consonant follows a vowel."""
    return _shape(stem).count("vc")


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@lru_cache(maxsize=1 << 16)
def porter(word: str) -> str:
    """The stem of a lower-case word of letters a to z."""
    if len(word) < 3:
        return word
    # plurals
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # past forms
    if word.endswith("eed"):
        if _measure(word[:-3]):
            word = word[:-1]
    else:
        ending = _longest(word, ("ed", "ing"))
        if ending and "v" in _shape(word[: -len(ending)]):
            word = word[: -len(ending)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _doubled(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    # double and single suffixes
    for rules in (STEP_2, STEP_3):
        ending = _longest(word, rules)
        if ending and _measure(word[: -len(ending)]):
            word = word[: -len(ending)] + rules[ending]
    ending = _longest(word, STEP_4)
    if ending and _measure(word[: -len(ending)]) > 1 and (ending != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(ending)]
    # tidying
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or _measure(stem) == 1 and not _short(stem):
            word = stem
    if _doubled(word) and word.endswith("l") and _measure(word) > 1:
        word = word[:-1]
    return word
