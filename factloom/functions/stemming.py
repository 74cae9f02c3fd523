"""English stems by suffix stripping: regions of a word, ordered steps, and exceptions (the second Porter algorithm)."""

from __future__ import annotations

import re
from functools import lru_cache

# The published tables of the algorithm. Suffixes of a step are tried longest first; what a step puts for each.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURAL = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
LONG_STARTS = ["gener", "commun", "arsen"]
VERBAL = ["eed", "eedly", "ed", "edly", "ing", "ingly"]
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]
DOUBLES = ["bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"]
BEFORE_LI = "cdeghkmnrt"

_VOWEL, _OTHER = "[aeiouy]", "[^aeiouy]"
_REGION = re.compile(f"{_OTHER}*{_VOWEL}+{_OTHER}")
_SHORT = re.compile(f"(?:.*{_OTHER}|(?=..\\Z)){_VOWEL}(?:(?<=\\A.){_OTHER}|[^aeiouywxY])\\Z", re.S)


def _ending(word: str, suffixes) -> str:
    """The longest of the suffixes that the word ends in, or nothing."""
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _regions(word: str) -> tuple[int, int]:
    """Where the first and the second region start: each after the first consonant that follows a vowel."""
    first = next((len(s) for s in LONG_STARTS if word.startswith(s)), None)
    if first is None:
        first = m.end() if (m := _REGION.match(word)) else len(word)
    return first, m.end() if (m := _REGION.match(word, first)) else len(word)


def _singular(word: str) -> str:
    end = _ending(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        return word[:-2]
    if end in ("ied", "ies"):
        return word[:-2] if len(word) > 4 else word[:-1]
    return word[:-1] if end == "s" and re.search(_VOWEL, word[:-2]) else word


def _verbal(word: str, first: int) -> str:
    end = _ending(word, VERBAL)
    body = word[: len(word) - len(end)]
    if end in ("eed", "eedly"):
        return body + "ee" if len(body) >= first else word
    if not end or not re.search(_VOWEL, body):
        return word
    if body.endswith(("at", "bl", "iz")):
        return body + "e"
    if body.endswith(tuple(DOUBLES)):
        return body[:-1]
    return body + "e" if len(body) <= first and _SHORT.match(body) else body


def _derived(word: str, first: int, second: int) -> str:
    end = _ending(word, STEP_2)
    body = word[: len(word) - len(end)]
    if end and len(body) >= first and (end != "ogi" or body.endswith("l")) and (end != "li" or body.endswith(tuple(BEFORE_LI))):
        word = body + STEP_2[end]
    end = _ending(word, STEP_3)
    body = word[: len(word) - len(end)]
    if end and len(body) >= (second if end == "ative" else first):
        word = body + STEP_3[end]
    end = _ending(word, STEP_4)
    body = word[: len(word) - len(end)]
    return body if end and len(body) >= second and (end != "ion" or body.endswith(("s", "t"))) else word


@lru_cache(maxsize=1 << 16)
def english_stem(word: str) -> str:
    """The stem of a lower-case word. Words of up to two letters and those of other scripts stay; letters with accents count as consonants."""
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    word = re.sub("([aeiouy])y", r"\1Y", re.sub(r"\Ay", "Y", word))
    first, second = _regions(word)
    word = _singular(word)
    if word in KEPT_AFTER_PLURAL:
        return word
    word = _verbal(word, first)
    if word[-1] in "yY" and len(word) > 2 and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    word = _derived(word, first, second)
    body = word[:-1]
    if word.endswith("e") and (len(body) >= second or len(body) >= first and not _SHORT.match(body)) or word.endswith("ll") and len(body) >= second:
        word = body
    return word.replace("Y", "y")
