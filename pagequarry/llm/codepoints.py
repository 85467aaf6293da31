"""Texts as arrays of code points, for numpy kernels inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

SPACE = 32
LIMIT = 0x110000


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grouped(rows: Iterable[tuple[int, str]], chars: int = 1 << 20) -> Iterator[tuple[list[int], list[str]]]:
    """Rows with non-null text, gathered to about so many code points at a time; a longer text comes alone."""
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for i, text in rows:
        if text is None:
            continue
        if ids and size + len(text) > chars:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(text)
        size += len(text)
    if ids:
        yield ids, texts


def joined(texts: list[str], gap: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts with `gap` NULs after each, and where each text starts; the last entry is the end."""
    lengths = np.fromiter((len(t) + gap for t in texts), np.int64, len(texts))
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths, out=starts[1:])
    return codepoints(("\0" * gap).join([*texts, ""])), starts


@cache
def word_table() -> np.ndarray:
    """Of each code point: its lower case if it is a letter or digit, else a space. NUL stays."""
    table = np.full(LIMIT, SPACE, np.uint32)
    for c in range(LIMIT):
        ch = chr(c)
        if ch.isalnum():
            table[c] = ord(ch.lower()[0])
    table[0] = 0
    return table


def word_text(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words (maximal runs of letters and digits, lower case) parted by single spaces, and each character's source
    position. NULs, which part texts, stay, with the spaces around them dropped."""
    plain = word_table()[codes]
    gap = plain <= SPACE
    keep = ~gap
    # A gap stays once, before a word; the NULs of a text's end stay always.
    keep[1:] |= gap[1:] & ~gap[:-1]
    keep |= plain == 0
    at = np.flatnonzero(keep)
    return plain[at], at
