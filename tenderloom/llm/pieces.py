"""Cuts texts where no token can cross, and tokenizes each different piece once.

Most words of a corpus come again and again, so a piece is known by a hash of its bytes and its tokens are looked
up. The cuts are those that every splitting pattern used here makes: before a single white-space character between
two other characters, after one that is not a blank, and between a letter and ASCII punctuation. Where the bytes at
hand cannot prove a cut it is not made; the piece is then longer, with the same tokens.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .arrow_text import ragged_positions

LONGEST = 48  # bytes; longer pieces are tokenized without being kept
CHUNK = 1 << 16  # pieces hashed at a time

_SPACE, _LETTER, _PUNCT, _PLAIN = 1, 2, 4, 8
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[33:127] = _PUNCT | _PLAIN
_KIND[48:58] = _PLAIN
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER | _PLAIN
# First bytes of characters among which there is no white space.
_KIND[[*range(0xC3, 0xE0), *range(0xE4, 0xF5)]] = _PLAIN

_POWERS = np.cumprod(np.full(LONGEST + 1, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def piece_starts(raw: np.ndarray, edges: np.ndarray, marks: bytes | None = None) -> np.ndarray:
    """Where pieces begin. `edges`: where texts begin, and the end. A text with the two bytes `marks` stays whole."""
    n = len(raw)
    if not n:
        return np.empty(0, np.int64)
    kind = _KIND[raw]
    # What the character that ends at a byte is known to be.
    closed = kind.copy()
    tail = (raw & 0xC0) == 0x80
    two = np.zeros(n, bool)
    two[1:] = tail[1:] & (raw[:-1] >= 0xC3) & (raw[:-1] < 0xE0)
    closed[two] = _PLAIN
    latin = np.zeros(n, bool)
    latin[1:] = two[1:] & (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    closed[latin] = _PLAIN | _LETTER
    closed[raw >= 0xC0] = 0
    space, opens = (kind & _SPACE) > 0, (kind & _PLAIN) > 0
    solid, letter = (closed & _PLAIN) > 0, (closed & _LETTER) > 0
    begin = np.zeros(n + 1, bool)
    lone = np.zeros(n, bool)
    if n > 2:
        lone[1:-1] = space[1:-1] & solid[:-2] & opens[2:]
    edge = np.unique(edges)
    lone[edge[edge < n]] = False
    lone[edge[edge > 0] - 1] = False
    begin[:-1] = lone
    begin[1:-1] |= lone[:-1] & (raw[:-1] != 32)
    begin[1:-1] |= letter[:-1] & ((kind[1:] & _PUNCT) > 0) & ((kind[1:] & _LETTER) == 0)
    if marks is not None:
        found = np.flatnonzero((raw[:-1] == marks[0]) & (raw[1:] == marks[1]))
        for text in np.unique(np.searchsorted(edges, found, "right") - 1):
            begin[edges[text] : edges[text + 1]] = False
    begin[edge] = True
    return np.flatnonzero(begin[:-1])


def piece_hashes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64 bits for each of the adjoining pieces; meaningless where one is longer than LONGEST."""
    at = np.arange(starts[0], starts[0] + lengths.sum()) - np.repeat(starts, lengths)
    np.minimum(at, LONGEST, out=at)
    terms = (raw[starts[0] : starts[0] + len(at)].astype(np.uint64) + np.uint64(1)) * _POWERS[at]
    found = np.add.reduceat(terms, starts - starts[0]) + lengths.astype(np.uint64) * _MIX
    found ^= found >> np.uint64(32)
    found *= _MIX
    return found ^ (found >> np.uint64(29))


class PieceTable:
    """Tokens of the pieces seen so far. `encode` gives the tokens of a list of pieces, one after the other, and how
    many each has. At `most` pieces the table starts anew, which bounds its memory and changes no result."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 1_000_000):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.first = np.empty(0, np.int64)
        self.count = np.empty(0, np.int64)
        self.ids = np.empty(0, np.int32)

    def _slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        return at, known

    def _add(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        if len(self.keys) + len(keys) > self.most:
            self._clear()
        ids, count = self.encode(pieces)
        first = np.cumsum(count) - count + len(self.ids)
        # Both lists of keys are ascending, so the new ones are put in their places without sorting all again.
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.first = np.insert(self.first, at, first)
        self.count = np.insert(self.count, at, count)
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])

    def tokens(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of pieces that begin at `starts` and reach to the next, and how many each has."""
        lengths = np.diff(np.append(starts, len(raw)))
        ids, counts = [], []
        for k in range(0, len(starts), CHUNK):
            got = self._chunk(raw, starts[k : k + CHUNK], lengths[k : k + CHUNK])
            ids.append(got[0])
            counts.append(got[1])
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.empty(0, np.int32), np.empty(0, np.int64))

    def _chunk(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = int(starts[0])
        held = raw[base : int(starts[-1] + lengths[-1])].tobytes()

        def cut(which: np.ndarray) -> list[bytes]:
            begin = starts[which] - base
            return [held[a:b] for a, b in zip(begin.tolist(), (begin + lengths[which]).tolist())]

        hashes = piece_hashes(raw, starts, lengths)
        long = np.flatnonzero(lengths > LONGEST)
        keys, sample, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(long):
            short = np.ones(len(keys), bool)
            short[inverse[long]] = False
            short[np.unique(inverse[lengths <= LONGEST])] = True
            rank = np.cumsum(short) - 1
            least = np.full(len(keys), len(starts))
            np.minimum.at(least, inverse[lengths <= LONGEST], np.flatnonzero(lengths <= LONGEST))
            keys, sample = keys[short], least[short]
            inverse = rank[inverse]
        if len(self.keys) + len(keys) > self.most:
            self._clear()
        _, known = self._slots(keys)
        if not known.all():
            self._add(keys[~known], cut(sample[~known]))
        at, _ = self._slots(keys)
        if not len(long):
            first, count, pool = self.first[at][inverse], self.count[at][inverse], self.ids
        else:
            first, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
            usual = lengths <= LONGEST
            first[usual], count[usual] = self.first[at][inverse[usual]], self.count[at][inverse[usual]]
            own, many = self.encode(cut(long))
            first[long], count[long] = np.cumsum(many) - many + len(self.ids), many
            pool = np.concatenate([self.ids, own.astype(np.int32)])
        return pool[ragged_positions(first, count)], count


def joined_encoder(tokenizer, part: bytes, together: int = 64) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    """As `library_encoder`, for a tokenizer that drops white space: many pieces make one text, with line ends between
    them, which saves most of the work that each text costs. Pieces that hold `part` (the start of special strings, which
    are looked for across white space) are encoded on their own."""
    alone = library_encoder(tokenizer)

    def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if any(part in piece for piece in pieces):
            return alone(pieces)
        texts = [piece.decode() for piece in pieces]
        count, ids = np.zeros(len(texts), np.int64), []
        groups = [texts[k : k + together] for k in range(0, len(texts), together)]
        found = tokenizer.encode_batch(["\n".join(group) for group in groups], add_special_tokens=False)
        for k, (group, one) in enumerate(zip(groups, found)):
            ends = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)) + 1)
            places = np.fromiter((place[0] for place in one.offsets), np.int64, len(one.ids))
            owner = np.searchsorted(ends, places, "right")
            count[k * together : k * together + len(group)] = np.bincount(owner, minlength=len(group))
            ids.append(np.array(one.ids, np.int32))
        return (np.concatenate(ids) if ids else np.empty(0, np.int32)), count

    return encode


def library_encoder(tokenizer) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    """Encodes a list of pieces with the tokenizers library."""

    def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = tokenizer.encode_batch_fast([piece.decode() for piece in pieces], add_special_tokens=False)
        ids = [one.ids for one in found]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((token for one in ids for token in one), np.int32, count.sum()), count

    return encode
