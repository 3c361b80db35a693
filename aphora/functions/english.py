"""English words for search: stems after the published Porter2 algorithm, and words too common to search for."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are left out of an index and of a query.
STOP_WORDS = frozenset("""
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
    itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
    has had having do does did doing a an the and but if or because as until while of at by for with about against between
    into through during before after above below to from up down in out on off over under again further then once here there
    when where why how all any both each few more most other some such no nor not only own same so than too very s t can will
    just don should now
""".split())

# Fixed values of the algorithm: words with stems of their own, and words that are left alone (at once, or after step 1a).
_OWN_STEMS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_LEFT_ALONE = frozenset("sky news howe atlas cosmos bias andes".split())
_LEFT_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_LONG_STARTS = ("gener", "commun", "arsen")
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI_ENDINGS = "cdeghkmnrt"
# Steps 2, 3 and 4: endings and what replaces them.
_STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og",
    "fulli": "ful", "lessli": "less", "li": ""}
_STEP_3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
    "ative": ""}
_STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive",
    "ize", "ion")

_VOWEL = "[aeiouy]"
_REGION = re.compile(f"{_VOWEL}[^aeiouy]")
_SHORT_END = re.compile(f"(?:^|.*[^aeiouy]){_VOWEL}[^aeiouywxY]$|^{_VOWEL}[^aeiouy]$", re.S)


def _region(word: str, start: int) -> int:
    """Where the part after the first non-vowel that follows a vowel begins."""
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _ending(word: str, endings) -> str:
    """The longest of the endings that the word has, or nothing."""
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _step_1(word: str) -> str:
    """Plurals and past forms."""
    ending = _ending(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if ending == "sses":
        word = word[:-2]
    elif ending in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif ending == "s" and re.search(_VOWEL, word[:-2]):
        word = word[:-1]
    return word


def _step_1b(word: str, r1: int) -> str:
    ending = _ending(word, ("eedly", "eed", "edly", "ed", "ingly", "ing"))
    if ending in ("eed", "eedly"):
        return word[: len(word) - len(ending)] + "ee" if len(word) - len(ending) >= r1 else word
    rest = word[: len(word) - len(ending)]
    if not ending or not re.search(_VOWEL, rest):
        return word
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if rest.endswith(_DOUBLES):
        return rest[:-1]
    return rest + "e" if r1 >= len(rest) and _SHORT_END.match(rest) else rest


def _step_2(word: str, r1: int) -> str:
    ending = _ending(word, _STEP_2)
    at = len(word) - len(ending)
    if not ending or at < r1:
        return word
    if ending == "ogi" and not word[:at].endswith("l") or ending == "li" and word[at - 1] not in _LI_ENDINGS:
        return word
    return word[:at] + _STEP_2[ending]


def _step_3(word: str, r1: int, r2: int) -> str:
    ending = _ending(word, _STEP_3)
    at = len(word) - len(ending)
    return word[:at] + _STEP_3[ending] if ending and at >= (r2 if ending == "ative" else r1) else word


def _step_4(word: str, r2: int) -> str:
    ending = _ending(word, _STEP_4)
    at = len(word) - len(ending)
    return word[:at] if ending and at >= r2 and (ending != "ion" or word[:at].endswith(("s", "t"))) else word


def _step_5(word: str, r1: int, r2: int) -> str:
    at = len(word) - 1
    if word.endswith("e") and (at >= r2 or at >= r1 and not _SHORT_END.match(word[:-1])):
        return word[:-1]
    return word[:-1] if word.endswith("ll") and at >= r2 else word


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2 or word in _LEFT_ALONE:
        return word
    if word in _OWN_STEMS:
        return _OWN_STEMS[word]
    # A y at the beginning or after a vowel is a consonant, written Y meanwhile.
    word = re.sub(f"({_VOWEL})y", r"\1Y", re.sub("^y", "Y", word.removeprefix("'")))
    start = next((len(s) for s in _LONG_STARTS if word.startswith(s)), None)
    r1 = _region(word, 0) if start is None else start
    r2 = _region(word, r1)
    for mark in ("'s'", "'s", "'"):
        if word.endswith(mark):
            word = word[: -len(mark)]
            break
    word = _step_1(word)
    if word in _LEFT_AFTER_1A:
        return word
    word = _step_1b(word, r1)
    if len(word) > 2 and word[-1] in "yY" and not re.match(_VOWEL, word[-2]):
        word = word[:-1] + "i"
    return _step_5(_step_4(_step_3(_step_2(word, r1), r1, r2), r2), r1, r2).replace("Y", "y")


def stems(words: Column) -> Column:
    """The stems of a list of lower-case words, without stop words and empty ones; each distinct word is worked on once a batch."""

    @F.arrow_udf("array<string>")
    def work(lists: pa.Array) -> pa.Array:
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        coded = lists.flatten().dictionary_encode()
        known = {w: stem(w) if w and w not in STOP_WORDS else None for w in coded.dictionary.to_pylist()}
        found = pa.array(list(known.values()), pa.string()).take(coded.indices)
        borders = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
        kept = np.concatenate(([0], np.cumsum(found.is_valid().to_numpy(zero_copy_only=False))))[borders]
        return pa.ListArray.from_arrays(pa.array(kept, pa.int32()), found.drop_null())

    return work(words)


def query_stems(text: str) -> list[str]:
    """What a search for the text looks for: the stems of its words without stop words."""
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w and w not in STOP_WORDS]
    return sorted({stem(w) for w in words})
