"""Counts of a text's words, lines and characters, taken from its UTF-8 bytes."""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np

from inboxlake.llm.common import SPACES

#: Characters that count as symbols (fixed values).
SYMBOLS = b"#*$%&|<>"

#: Words of a window in which repeated passages are looked for.
WINDOW = 5

#: Bytes that begin a code point, and the capitals A-Z.
_HEADS = bytes(x for x in range(256) if not 0x80 <= x < 0xC0)
_CAPITALS = bytes(range(0x41, 0x5B))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in a window of ``window`` words that occurs twice or more, first occurrence included.

    Windows are compared by a 64-bit mix of their words' hashes first, and those that agree word for word.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        x = hashes[k : k + n] * _MIX[k % len(_MIX)] + np.uint64(k)
        mixed = (mixed ^ (x ^ (x >> np.uint64(29)))) * _MIX[0]
    ordered = np.sort(mixed)
    alike = ordered[1:][ordered[1:] == ordered[:-1]]
    if not alike.size:
        return 0
    found = np.flatnonzero(np.isin(mixed, alike))
    seen = Counter(tuple(words[i : i + window]) for i in found.tolist())
    starts = [i for i in found.tolist() if seen[tuple(words[i : i + window])] > 1]
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, np.array(starts, dtype=np.int64) + window, -1)
    return int((np.cumsum(covered) > 0).sum())


#: Names of what ``counts`` returns, all long. n_same_words: words equal to the word before.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_same_words")


def counts(text: bytes) -> tuple[int, ...]:
    """``COUNTS`` of one whole text. Words are [^\\x20\\x09-\\x0D]+; an empty text has zeros only."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    solid = text.translate(None, SPACES)
    points = len(solid) - len(solid.translate(None, _HEADS))
    return (
        len(words),
        points,
        sum(solid.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(solid) - len(solid.translate(None, _CAPITALS)),
        len(solid) - len(solid.translate(None, b"0123456789")),
        sum(map(eq, words, words[1:])),
    )
