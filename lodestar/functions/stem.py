"""Porter's suffix stripping of English words (1980), for metrics that compare stems."""

from __future__ import annotations

import re
from functools import lru_cache

# fixed values: the suffixes of each step and what takes their place
_STEP_2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_VC = re.compile("v+c+")


def _kinds(word: str) -> str:
    """v or c for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(_VC.findall(_kinds(stem)))


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _swap(word: str, rules: tuple[tuple[str, str], ...], least: int) -> str:
    ends = [r for r in rules if word.endswith(r[0])]
    if not ends:
        return word
    old, new = max(ends, key=lambda r: len(r[0]))
    stem = word[: -len(old)]
    return stem + new if _measure(stem) > least else word


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters stay."""
    if len(word) <= 2:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end):
                if "v" in _kinds(word[: -len(end)]):
                    word = word[: -len(end)]
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c" and word[-1] not in "lsz":
                        word = word[:-1]
                    elif _measure(word) == 1 and _short(word):
                        word += "e"
                break
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _STEP_2, 0), _STEP_3, 0)
    ends = [e for e in _STEP_4 if word.endswith(e)]
    if ends:
        end = max(ends, key=len)
        left = word[: -len(end)]
        if _measure(left) > 1 and (end != "ion" or left.endswith(("s", "t"))):
            word = left
    if word.endswith("e") and ((m := _measure(word[:-1])) > 1 or (m == 1 and not _short(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word
