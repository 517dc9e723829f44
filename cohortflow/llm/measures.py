"""Plain measurements of a whole text, shared by the quality rules and the quality classifier."""

from __future__ import annotations

import string

import numpy as np

SYMBOLS = b"#*$%&|<>"
WINDOW = 8

MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_distinct_words",
    "n_upper",
    "n_lower",
    "n_digits",
    "n_exclaims",
    "n_pipes",
    "n_stops",
)

# Words of a stretch over which variety is measured, so that it doesn't fall with a text's length.
STRETCH = 500

MORE_MEASURES = ("n_letters", "n_stretch_words")

_UPPER = string.ascii_uppercase.encode()
_LOWER = string.ascii_lowercase.encode()
_DIGITS = string.digits.encode()
_ASCII = bytes(range(128))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words which the list holds twice or more.

    Windows of 1, 2, 4 and 8 words are named by the pair of their halves' names,
    so equal names mean equal words.
    """
    n = len(words)
    if n <= window:
        return 0
    numbers: dict[bytes, int] = {}
    name = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    size = 1
    while size < window:
        pair = name[:-size] * (int(name.max()) + 1) + name[size:]
        distinct, name = np.unique(pair, return_inverse=True)
        size *= 2
        if len(distinct) == len(name):
            return 0
    twice = np.bincount(name)[name] > 1
    mark = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + window, -1)
    return int(np.count_nonzero(np.cumsum(mark)[:n]))


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of a text; all 0 for a null one.  Words are runs outside space and 0x09 to 0x0D."""
    text = text or ""
    raw = text.encode("utf-8")
    words = raw.split()
    lines = raw.split(b"\n")
    full = [line for line in lines if line.strip()]
    in_words = sum(map(len, words))

    def count(of: bytes) -> int:
        return len(raw) - len(raw.translate(None, of))

    return (
        len(words),
        len(text) - (len(raw) - in_words),
        count(SYMBOLS),
        len(full) - len(set(full)),
        repeated_words(words),
        len(full),
        len(set(words)),
        count(_UPPER),
        count(_LOWER),
        count(_DIGITS),
        count(b"!"),
        count(b"|"),
        count(b".?!"),
    )


def measure_more(text: str | None) -> tuple[int, int]:
    """MORE_MEASURES of a text: letters of any script, and distinct words of each STRETCH words, added up."""
    raw = (text or "").encode("utf-8")
    words = raw.split()
    latin = len(raw) - len(raw.translate(None, _UPPER + _LOWER))
    others = raw.translate(None, _ASCII).decode("utf-8")
    return (
        latin + sum(map(str.isalpha, others)),
        sum(len(set(words[at : at + STRETCH])) for at in range(0, len(words), STRETCH)),
    )
