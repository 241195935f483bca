"""Hashes of the words of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .arrow_text import text_bytes

# Bytes that part words: white space, or all that is no letter or digit in ASCII.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
NO_LETTERS = np.ones(256, bool)
NO_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(31))
    values *= MIX
    values ^= values >> np.uint64(29)
    values *= STEP
    return values ^ (values >> np.uint64(32))


def word_hashes(texts: pa.Array, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each lower-cased word of all texts, and where the words of each text begin (one more than texts).
    `parts` marks the bytes between words; with NO_LETTERS, Latin-1 signs and general punctuation part words too."""
    raw, edges = text_bytes(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    if not len(raw):
        return np.empty(0, np.uint64), np.zeros(len(edges), np.int64)
    space = parts[raw]
    if parts is NO_LETTERS:
        sign = np.flatnonzero(raw == 0xC2)
        space[sign] = space[sign + 1] = True
        sign = np.flatnonzero(raw[:-2] == 0xE2)
        sign = sign[raw[sign + 1] == 0x80]
        space[sign] = space[sign + 1] = space[sign + 2] = True
    first = ~space
    first[1:] &= space[:-1]
    begin = edges[:-1][np.diff(edges) > 0]
    first[begin] = ~space[begin]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(edges), np.int64)
    word = np.cumsum(first) - 1
    inside = np.flatnonzero(~space)
    word = word[inside]
    at = inside - starts[word]
    powers = np.cumprod(np.full(int(at.max()) + 1, STEP), dtype=np.uint64)
    begins = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
    sums = np.add.reduceat((raw[inside].astype(np.uint64) + np.uint64(1)) * powers[at], begins)
    return mixed(sums), np.searchsorted(starts, edges)
