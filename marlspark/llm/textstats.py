"""Counts over whole texts that the quality operators share.

Words are runs of anything but space, tab, line feed, vertical tab, form feed
and carriage return. A null text has no words, lines or characters.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import documents, map_texts

#: In a text's order of columns.
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_bangs", "n_pipes", "n_distinct", "n_adjacent")
#: The characters that count as symbols, and white space.
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\v\f\r"
REPEAT = 8

_symbols, _blanks = np.frombuffer(SYMBOLS, np.uint8), np.frombuffer(BLANKS, np.uint8)


def repeated_words(words: list[bytes], hashes: np.ndarray, size: int = REPEAT) -> int:
    """Words that lie in a window of `size` words found twice or more; hashes pick windows that are then compared as they are."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    rolled = hashes[:n].copy()
    for k in range(1, size):
        rolled *= np.uint64(0x9E3779B97F4A7C15)
        rolled += hashes[k : k + n]
    s = np.sort(rolled)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(rolled, twice))
    seen: dict[tuple, list[int]] = {}
    for i in at.tolist():
        seen.setdefault(tuple(words[i : i + size]), []).append(i)
    edge = np.zeros(len(words) + 1, np.int64)
    for places in seen.values():
        if len(places) > 1:
            np.add.at(edge, places, 1)
            np.add.at(edge, np.array(places) + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The numbers of NAMES."""
    if not text:
        return (0,) * len(NAMES)
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    return (
        len(words),
        len(text) - int(of[_blanks].sum()),
        int(of[_symbols].sum()),
        len(lines) - len(set(lines)),
        repeated_words(words, hashes),
        len(lines),
        int(of[65:91].sum()),
        int(of[97:123].sum()),
        int(of[48:58].sum()),
        int(of[33]),
        int(of[124]),
        len(set(words)),
        int((hashes[1:] == hashes[:-1]).sum()),
    )


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, columns to keep, and a bigint for each of NAMES."""

    def make():
        return lambda texts: list(zip(*map(counts, texts), strict=True))

    d = documents(docs, *keep)
    return map_texts(d, ", ".join(f"{n} bigint" for n in NAMES), make, keep=("doc_id", *keep))
