"""Splitting text into the pre-tokens of the byte-level vocabularies."""

import functools
import re

import public_tokenizers
import regex

_PAIR = re.compile(r"\s\s")


@functools.cache
def pattern():
    return regex.compile(public_tokenizers.PATTERN)


def chunks(text):
    """Keys of parts of ``text``, in order, whose pre-tokens are those of the whole text.

    A space goes with what follows it, so a text without two white-space
    characters in a row, at its start or at its end may be cut before each
    space. Other texts are cut into the pre-tokens themselves. A plain string
    stands for itself after a space, a tuple for its one string as it is.
    """
    if not text:
        return []
    if text[0].isspace() or text[-1].isspace() or _PAIR.search(text):
        return [(x,) for x in pattern().findall(text)]
    keys = text.split(" ")
    keys[0] = (keys[0],)
    return keys


def pieces(key):
    """Pre-tokens of one part. A word of letters, alone or before one mark, needs no pattern."""
    if type(key) is tuple:
        return pattern().findall(key[0])
    if key.isalpha():
        return [" " + key]
    if key[-1] in ".," and key[:-1].isalpha():
        return [" " + key[:-1], key[-1]]
    return pattern().findall(" " + key)
