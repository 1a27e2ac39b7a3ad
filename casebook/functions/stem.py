"""English suffix stripping (Porter 1980, with the usual later amendments), word by word, for use inside Arrow tasks."""

from __future__ import annotations

from functools import lru_cache

# fixed values: suffixes and what takes their place, in the published order; the first that fits decides
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}


def _shape(word: str) -> str:
    """``v`` and ``c`` per letter; y is a vowel behind a consonant."""
    shape = ""
    for x in word:
        shape += "v" if x in "aeiou" or (x == "y" and shape.endswith("c")) else "c"
    return shape


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant other than w, x, y; or is a vowel and a consonant."""
    shape = _shape(word)
    return (shape.endswith("cvc") and word[-1] not in "wxy") or shape == "vc"


def _swap(word: str, pairs, least: int = 0) -> str:
    for suffix, put in pairs:
        if word.endswith(suffix):
            head = word[: len(word) - len(suffix)]
            return head + put if _measure(head) > least else word
    return word


def _plural(word: str) -> str:
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("sses"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        head = word[: len(word) - len(suffix)]
        if word.endswith(suffix) and "v" in _shape(head):
            if head.endswith(("at", "bl", "iz")):
                return head + "e"
            if len(head) > 1 and head[-1] == head[-2] and _shape(head).endswith("c"):
                return head if head[-1] in "lsz" else head[:-1]
            return head + "e" if _measure(head) == 1 and _short(head) else head
    return word


def _derived(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _derived(word[:-2])
    if word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    return _swap(word, STEP_2)


def _ending(word: str) -> str:
    for suffix in STEP_4:
        if word.endswith(suffix):
            head = word[: len(word) - len(suffix)]
            return head if _measure(head) > 1 and (suffix != "ion" or head[-1] in "st") else word
    return word


@lru_cache(maxsize=65_536)
def stem(word: str) -> str:
    """Stem of a lower-case word; words of one or two letters stay."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and len(word) > 2 and _shape(word)[-2] == "c":
        word = word[:-1] + "i"
    word = _ending(_swap(_derived(word), STEP_3))
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word
