"""Splitting texts into the pre-tokens that public byte-pair tokenizers merge within.

Texts whose characters all lie in Latin-1 go through the standard `re` module with the classes written
out; every other text goes through `regex` with Unicode properties. Both follow Unicode White_Space
(which, unlike Python's \\s, does not hold U+001C to U+001F).
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import numpy as np
import regex

# The contractions, letters, numbers and white space of Latin-1.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = "\t-\r \x85\xa0"

SPACED_NARROW = re.compile(
    f"{CONTRACTIONS}| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+"
    f"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
WORD_NARROW = re.compile(f"{CONTRACTIONS}|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")

# Kinds of bytes: ASCII letters and digits, other printable ASCII, the apostrophe, blank, line feed, first bytes of
# characters beyond ASCII that can't be white space, and all others.
REST, ALNUM, SIGN, QUOTE, BLANK, LINE, LEAD = range(7)
KINDS = np.zeros(256, np.uint8)
KINDS[0x21:0x7F] = SIGN
for _from, _to in ("09", "AZ", "az"):
    KINDS[ord(_from) : ord(_to) + 1] = ALNUM
KINDS[ord("'")], KINDS[ord(" ")], KINDS[ord("\n")] = QUOTE, BLANK, LINE
# White space beyond ASCII begins with C2, E1, E2 or E3.
KINDS[0xC4:0xF5] = KINDS[0xC3] = LEAD
KINDS[0xE1:0xE4] = REST
SOLID = np.isin(np.arange(8), (ALNUM, SIGN, QUOTE))
#: A character of these kinds follows, whole, and is no white space.
FOLLOWS = np.isin(np.arange(8), (ALNUM, SIGN, QUOTE, LEAD))
#: By two kinds, first * 8 + second: whether a match of `spaced` always ends between them, or before the first.
BETWEEN, AHEAD = np.zeros(64, bool), np.zeros(64, bool)
BETWEEN[[ALNUM * 8 + SIGN, ALNUM * 8 + QUOTE, SIGN * 8 + ALNUM]] = True
AHEAD[BLANK * 8 : BLANK * 8 + 8] = FOLLOWS


def chunk_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where chunks of UTF-8 bytes start, so that a text's matches of `spaced` are those of its chunks, one after another.

    bounds: sorted places, 0 and the end among them, that no chunk goes across: what lies between two is a text of its
    own. Most chunks are one match. A cut stands only where a match always ends and where the matches before it are
    the same without what follows: before a blank that a character other than white space follows, between a letter
    or digit and a sign (behind an apostrophe it may be a contraction), and around a single line feed.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n:
        kind = KINDS[data]
        pair = kind[:-1] * np.uint8(8) + kind[1:]
        cut[1:n] = BETWEEN[pair]
        cut[: n - 1] |= AHEAD[pair]
        line = np.flatnonzero(data[1:-1] == 10) + 1
        line = line[SOLID[kind[line - 1]] & FOLLOWS[kind[line + 1]]]
        cut[line] = cut[line + 1] = True
        ends = bounds[bounds > 0] - 1  # what follows there is another text
        cut[ends[(kind[ends] == BLANK) | (kind[ends] == LINE)]] = False
    cut[bounds] = True
    return np.flatnonzero(cut[:n])


@cache
def wide_patterns() -> tuple[regex.Pattern, regex.Pattern]:
    """The two patterns for any text. Characters that `regex` knows as letters or numbers but this Python's Unicode
    tables do not know yet stand outside both classes, as in the tokenizer libraries' tables."""
    known = regex.compile(r"[\p{L}\p{N}]")
    late = [
        c
        for c in map(chr, range(0x250, sys.maxunicode + 1))
        if unicodedata.category(c) == "Cn" and known.match(c)
    ]
    less = f"--[{''.join(late)}]" if late else ""
    letter, number = rf"[\p{{L}}{less}]", rf"[\p{{N}}{less}]"
    space = r"\p{White_Space}"
    other = rf"[^{space}{letter}{number}]"
    spaced = rf"{CONTRACTIONS}| ?{letter}+| ?{number}+| ?{other}+|{space}+(?![^{space}])|{space}+"
    word = rf"{CONTRACTIONS}|{letter}+|{number}|{other}+"
    return regex.compile(spaced, regex.V1), regex.compile(word, regex.V1)


def is_narrow(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def spaced(text: str) -> list[str]:
    """The matches that keep a leading blank, as byte-level tokenizers split."""
    return (SPACED_NARROW if is_narrow(text) else wide_patterns()[0]).findall(text)


def words(text: str) -> list[str]:
    """The matches without white space, of a text that is normalised already."""
    return (WORD_NARROW if is_narrow(text) else wide_patterns()[1]).findall(text)


def common_mark(strings: list[str]) -> str:
    """A character that all of the strings have, best no letter or digit: a text without it has none of them.

    Without such a character, the empty string, which every text has.
    """
    shared = set.intersection(*map(set, strings)) if strings else set()
    return min(shared, key=lambda c: (c.isalnum(), c), default="")
