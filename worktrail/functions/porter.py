"""Porter's suffix stripping (1980, with the author's later revisions).

Used as a vectorised UDF over each document's distinct words. Letters are UTF-8
bytes; every byte outside ASCII counts as a consonant.
"""

import re
import sys
from typing import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors receive these functions with the job and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Suffix -> replacement per step, applied to the longest match.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "",
    "ness": "",
}
STEP4 = {s: "" for s in (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)}
MIN_BYTES, MAX_BYTES = 3, 64
#: All but so many last characters of a stem begin each of its words ("bility" becomes "ble").
CHANGED_AT_END = 2

# Words a task remembers between batches.
KNOWN_WORDS = 1_000_000

_VC = re.compile("v+c")


def _shape(word):
    """Consonants as ``c`` and vowels as ``v``; y is a vowel after a consonant."""
    out, after_consonant = [], False
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and after_consonant)
        out.append("v" if vowel else "c")
        after_consonant = not vowel
    return "".join(out)


def _measure(word):
    return len(_VC.findall(_shape(word)))


def _short_end(word):
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replace(word, rules, least):
    for size in range(min(7, len(word) - 1), 1, -1):
        suffix = word[-size:]
        if suffix not in rules:
            continue
        stem = word[:-size]
        fits = _measure(stem) >= least
        if suffix == "ion":
            fits = fits and stem[-1] in "st"
        return stem + rules[suffix] if fits else word
    return word


def _plural(word):
    if not word.endswith("s") or word.endswith("ss"):
        return word
    if (word.endswith("sses") and len(word) > 4) or (word.endswith("ies") and len(word) > 3):
        return word[:-2]
    return word[:-1]


def _past(word):
    if word.endswith("eed") and len(word) > 3:
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        stem = word[:-len(suffix)]
        if word.endswith(suffix) and "v" in _shape(stem):
            break
    else:
        return word
    if len(stem) > 2 and stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    doubled = len(stem) > 1 and stem[-1] == stem[-2]
    if doubled and stem[-1] not in "aeiou" and stem[-1] not in "lsz":
        return stem[:-1]
    if _measure(stem) == 1 and _short_end(stem):
        return stem + "e"
    return stem


def stem(token):
    raw = token.encode("utf-8")
    if not MIN_BYTES <= len(raw) <= MAX_BYTES:
        return token
    word = _past(_plural(raw.decode("latin-1")))
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(_replace(word, STEP2, 1), STEP3, 1), STEP4, 2)
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word.encode("latin-1").decode("utf-8", "replace")


def _stem_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known = {}
    for words in batches:
        if len(known) > KNOWN_WORDS:
            known.clear()
        known.update((w, stem(w)) for w in words.unique() if w not in known)
        yield words.map(known)


def stem_terms(c):
    """Stems of a column of words.

    Marked non-deterministic only so that the optimizer does not move filters
    on the stem below a distinct, where every single token would pass through
    Python.
    """
    return F.pandas_udf(_stem_batches, T.StringType()).asNondeterministic()(c)


def _stem_lists(lists: pd.Series) -> pd.Series:
    return lists.map(lambda terms: [stem(t) for t in terms])


def stem_arrays(c):
    """Stems of each query's few terms."""
    return F.pandas_udf(_stem_lists, T.ArrayType(T.StringType()))(c)
