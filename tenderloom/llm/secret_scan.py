"""Secrets in plain and encoded text: every layer that can be unwrapped is scanned like the text itself.

A worklist starts with the text. Each layer is scanned for secrets; then its parts that look like percent escapes,
Unicode escapes (also `%uXXXX` and `U+XXXX`), base64 or base64 of compressed bytes are decoded, and each new layer joins the
list. Bytes are read as UTF-8 and as UTF-16. Compressed are gzip, zlib, bzip2, xz and zstandard wherever they begin, also one
in the other, and raw deflate, which has no mark, where a run or a part of it behind one of `/ - _ +` begins, if all it
gives is text. Digests of layers seen end cycles, so the list ends when no part gives a layer that is new. Every layer keeps for each of its characters the place
in the text it came from, so a secret found in any layer becomes a span of the text: for escapes the characters that
encode it, for base64 the groups of four that encode it, and for compressed bytes the groups that encode all of the
stream. Base64 is read over line ends and blanks too, and compressed streams member after member, up to where they
break off (raw deflate: only whole streams). An xz stream that asks for more than `MEMORY` is not unpacked.

Spans are code points, end exclusive. Null and empty texts have none. Texts are scanned whole. Equal spans from several
layers count once. A compressed layer of any length is inflated and scanned in pieces that overlap, which holds memory
against bombs; `n_layers` counts the pieces, and `cut_layers` the compressed layers of more than `most` bytes, which
are scanned whole too. Repeated rows are scanned alike; other columns are kept, and columns that have the name of a
result are replaced.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import small_batches

# Kinds in the order in which spans at one place are listed.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_KEYWORDS = ("passw", "secret", "token", "api")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPES = re.compile(
    r"[\\%]u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})|\\U([0-9A-Fa-f]{8})"
    r"|U\+([0-9A-Fa-f]{4,6})(?:[\x20,;]{1,3}(?=U\+[0-9A-Fa-f]{4}))?"
)
# Base64 that is no word, and words.
_PIECE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z]?+[a-z]*+[A-Z0-9+/_-][A-Za-z0-9+/_-]*={0,2}")
_WORD = re.compile(r"[A-Za-z][a-z]*")
_NEXT_WORD = re.compile(r"([\x20\t\r\n]+)([A-Za-z][a-z]*+)(?![A-Za-z0-9+/_-])={0,2}")
BLANKS = " \t\r\n"
_GAP = re.compile(r"[\x20\t\r\n]+")
_URL_SAFE = str.maketrans("-_", "+/")

SHORTEST = 14  # characters of the shortest secret; encoded parts are longer
_ENOUGH = re.compile(rb"[\t\n\r\x20-\x7e]{%d}" % SHORTEST)
_TEXT = re.compile(
    rb"(?:[\t\n\r\x20-\x7e]++|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}"
    rb"|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})++"
)
# The same as UTF-16 of either byte order.
_UTF16 = re.compile(rb"(?:[\t\n\r\x20-\x7e]\0){%d,}|(?:\0[\t\n\r\x20-\x7e]){%d,}" % (SHORTEST, SHORTEST))
# First bytes of gzip, bzip2, xz and zstandard, and of zlib without a preset dictionary.
_GZIP, _BZIP2, _XZ, _ZSTANDARD = rb"\x1f\x8b\x08", rb"BZh[1-9]1AY&SY", rb"\xfd7zXZ\0", rb"\x28\xb5\x2f\xfd"
_SURE = re.compile(b"|".join([_GZIP, _BZIP2, _XZ, _ZSTANDARD]), re.DOTALL)
_MARKS = [bytes((c, f)) for c in range(8, 128, 16) for f in range(256) if (c << 8 | f) % 31 == 0 and not f & 32]
_HEAD = re.compile(b"|".join([_SURE.pattern, *map(re.escape, _MARKS)]), re.DOTALL)
_HEADS = re.compile(b"(?=" + _HEAD.pattern + b")", re.DOTALL)
STEP = 1 << 14  # compressed bytes given to zlib at once
SMALL_STEP = 64  # and to the other libraries, which give nothing of a step with damage in it
MEMORY = 128 << 20  # for an xz stream
PIECE = 1 << 22  # inflated bytes scanned at once, and how many are scanned again with the next piece
OVERLAP = 1 << 16
_WIDE = re.compile(rb"\x20{3,}")

Span = tuple[int, int, int]


def plain_spans(text: str) -> list[Span]:
    """(start, end, kind number) of secrets in one layer."""
    found, lowered = [], text.lower()
    if any(word in lowered for word in _KEYWORDS):  # much faster to find than the pattern
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    return found + [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]


class Layer:
    """Decoded text, and for each of its characters the span of the outermost text that encodes it: two arrays, or two
    numbers where all have the same span. `stream` is the compressed stream the layer comes from, if any."""

    def __init__(self, text: str, start: np.ndarray | int, end: np.ndarray | int, stream: Stream | None = None):
        self.text, self.start, self.end, self.stream = text, start, end, stream

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (self.start, self.end) if isinstance(self.start, int) else (int(self.start[a]), int(self.end[b - 1]))


def _stretches(raw: bytes) -> Iterator[tuple[int, int]]:
    """Every stretch of the bytes that is text and long enough to hold a secret. No secret and no encoded part reaches over
    a byte that is no text."""
    if _ENOUGH.search(raw):
        for m in _TEXT.finditer(raw):
            if m.end() - m.start() >= SHORTEST:
                yield m.span()


def _utf16(raw: bytes) -> Iterator[tuple[int, int, str]]:
    """Every stretch of the bytes that is UTF-16 of plain characters and long enough to hold a secret, and its text."""
    if raw.count(0) >= SHORTEST:
        for m in _UTF16.finditer(raw):
            yield *m.span(), m[0].replace(b"\0", b"").decode()


def _inflate(raw: bytes, begin: int, most: int) -> Iterator[tuple[bytes, int, bool]]:
    """Decompressed bytes of the members from `begin` on, one after the other, in pieces of at most about `most`; with each
    the place behind what was read and whether a member is complete there. Of members that break off or are damaged it
    gives what comes before."""
    at, eof = begin, True
    while eof and _HEAD.match(raw, at):
        stop, eof = at, False
        for out, at, eof in _member(raw, at, most):
            yield out, at, eof
        if at == stop:
            return
        while eof and raw[at : at + 1] == b"\0":  # padding between members
            at += 1


def _member(raw: bytes, at: int, most: int) -> Iterator[tuple[bytes, int, bool]]:
    """The same for one member."""
    if raw[at] == 0x42:
        return _steps(bz2.BZ2Decompressor(), raw, at, most)
    if raw[at] == 0xFD:
        return _steps(lzma.LZMADecompressor(lzma.FORMAT_XZ, MEMORY), raw, at, most)
    if raw[at : at + 4] == b"\x28\xb5\x2f\xfd":
        return _steps(zstandard.ZstdDecompressor().decompressobj(), raw, at, 0)
    return _zlib_member(raw, at, most)


def _steps(machine, raw: bytes, at: int, most: int) -> Iterator[tuple[bytes, int, bool]]:
    """One member in small steps. Zstandard takes no bound for what a step may give, but no step holds many blocks."""
    while not machine.eof:
        piece = raw[at : at + SMALL_STEP] if getattr(machine, "needs_input", True) else b""
        try:
            out = machine.decompress(piece, most) if most else machine.decompress(piece)
        except (OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError):
            return
        if not out and not piece:
            return
        at += len(piece) - (len(machine.unused_data) if machine.eof else 0)
        yield out, at, machine.eof


def _zlib_member(raw: bytes, at: int, most: int, bits: int = 47) -> Iterator[tuple[bytes, int, bool]]:
    machine, step = zlib.decompressobj(bits), STEP
    while not machine.eof:
        saved = machine.copy() if step > 1 else None
        piece = raw[at : at + step]
        try:
            out = machine.decompress(piece, most)
        except zlib.error:
            if step == 1:
                return
            machine, step = saved, 1  # again byte by byte, up to the damage
            continue
        used = len(piece) - len(machine.unconsumed_tail) - len(machine.unused_data)
        if not out and not used:
            return
        at += used
        yield out, at, machine.eof


def _raw_deflate(raw: bytes, begin: int, most: int) -> tuple[int, int, bool]:
    """How far a stream of raw deflate that holds nothing but text reaches, how long its text is, and whether it is whole."""
    try:
        zlib.decompressobj(-15).decompress(raw[begin : begin + SMALL_STEP], most)
    except zlib.error:
        return begin, 0, False
    size, held, at, eof, kinds = 0, b"", begin, False, set()
    for out, at, eof in _zlib_member(raw, begin, most, -15):
        held += out
        if len(kinds) < 6:
            kinds.update(held)
        m = _TEXT.match(held)
        done = m.end() if m else 0
        if len(held) - done > 3:  # more than a character that goes on
            return begin, 0, False
        size, held = size + done, held[done:]
    if at - begin < 64 and (size > 8 * (at - begin) or len(kinds) < 6):
        return begin, 0, False  # a few characters repeated are chance
    return at, size, eof and not held


class Stream:
    """A compressed stream as layers with one span, of about `PIECE` bytes each (`most`, if that is less). Each layer begins with the end of the one
    before: as the span is the same everywhere, it is enough that each secret is whole in some layer, and a secret with
    the escapes and base64 around it is far shorter than `OVERLAP` with blanks shortened. Only a compressed stream in this
    one can be longer; while one is `open` at the end of a layer, the next layer begins where that layer does."""

    def __init__(self, raw: bytes, begin: int, most: int, start: int, end: int, outer: Stream | None, bare: bool = False):
        self.start, self.end, self.outer, self.open, self.n = start, end, outer, False, 0
        self.most = min(most, PIECE)
        members = _zlib_member(raw, begin, self.most, -15) if bare else _inflate(raw, begin, self.most)
        self.pieces = self._joined(members, self.most)
        self.held = b""

    @staticmethod
    def _joined(pieces: Iterator[tuple[bytes, int, bool]], most: int) -> Iterator[bytes]:
        held, size = [], 0
        for piece, _, _ in pieces:
            if size + len(piece) > most:
                yield b"".join(held)
                held, size = [], 0
            held.append(piece)
            size += len(piece)
        yield b"".join(held)

    def next(self) -> list[Layer | tuple[bytes, Stream]] | None:
        """The layers of the next piece, to be scanned to their ends before the next call, and compressed streams in it with a
        digest; none at the end."""
        piece = next(self.pieces, None)
        if piece is None:
            return None
        self.n += 1
        held = self.held if self.open else self.held[-OVERLAP:]
        raw, self.open = held + piece, False
        found = list(self._inner(raw))
        narrow = _WIDE.sub(b"  ", raw) if self.n > 1 or len(raw) > OVERLAP else raw
        self.held = raw if self.open else narrow
        found += [Layer(narrow[a:b].decode(), self.start, self.end, self) for a, b in _stretches(narrow)]
        return found + [Layer(text, self.start, self.end, self) for _, _, text in _utf16(narrow)]

    def _inner(self, raw: bytes) -> Iterator[tuple[bytes, Stream]]:
        done = 0
        for head in _SURE.finditer(raw):
            at, size, eof = head.start(), 0, True
            if at < done:
                continue
            stop = at
            for out, stop, eof in _inflate(raw, at, self.most):
                size += len(out)
            done = stop if eof else done
            if not eof and stop == len(raw):
                self.keep_open()
            if size:
                yield hashlib.sha1(raw[at:stop]).digest(), Stream(raw, at, self.most, self.start, self.end, self)

    def keep_open(self) -> None:
        """Marks this stream and those around it: a stream in its layers goes on behind them."""
        one: Stream | None = self
        while one is not None:
            one.open, one = True, one.outer


def _decoded(layer: Layer, parts: list, starts: list, ends: list, at: int) -> Layer | None:
    """The layer with its text up to `at` replaced by the parts."""
    if not parts:
        return None
    text = "".join([*parts, layer.text[at:]])
    if isinstance(layer.start, int):
        return Layer(text, layer.start, layer.end, layer.stream)
    return Layer(text, np.concatenate([*starts, layer.start[at:]]), np.concatenate([*ends, layer.end[at:]]), layer.stream)


def _percent(layer: Layer) -> Layer | None:
    """The layer with all percent escapes decoded, as UTF-8 or else byte by byte."""
    parts, starts, ends, at, same = [], [], [], 0, isinstance(layer.start, int)
    for m in _PERCENT.finditer(layer.text):
        raw = bytes.fromhex(m[0].replace("%", ""))
        first = np.arange(len(raw))
        try:
            shown = raw.decode()
            first = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        except UnicodeDecodeError:
            shown = raw.decode("latin-1")  # a character for each byte
        a, b = m.span()
        stop = np.append(first[1:], len(raw))
        parts += [layer.text[at:a], shown]
        if not same:
            starts += [layer.start[at:a], layer.start[a + 3 * first]]
            ends += [layer.end[at:a], layer.end[a + 3 * stop - 1]]
        at = b
    return _decoded(layer, parts, starts, ends, at)


def _escapes(layer: Layer) -> Layer | None:
    """The layer with all Unicode escapes decoded."""
    parts, starts, ends, at, same = [], [], [], 0, isinstance(layer.start, int)
    for m in _ESCAPES.finditer(layer.text):
        code = int(next(g for g in m.groups() if g), 16)
        if code > 0x10FFFF or 0xD800 <= code < 0xE000:
            continue
        a, b = m.start(), m.end(5) if m[5] else m.end()
        parts += [layer.text[at:a], chr(code)]
        if not same:
            starts += [layer.start[at:a], layer.start[a : a + 1]]
            ends += [layer.end[at:a], layer.end[b - 1 : b]]
        at = m.end()
    return _decoded(layer, parts, starts, ends, at)


def _runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Base64 runs as lists of their unbroken parts: each part on its own, and parts joined over line ends and blanks.
    A word next to a run is no part of it, unless it is as long as the part beside it (a fixed width) or a last line."""
    chain: list[tuple[int, int]] = []
    behind, closed, by_word = 0, True, False
    for m in _PIECE.finditer(text):
        a, stop = m.span()
        b = len(m[0].rstrip("=")) + a
        joined = not closed and _GAP.fullmatch(text, behind, a) is not None
        if not joined or by_word and b - a != chain[-1][1] - chain[-1][0]:
            if len(chain) > 1 and sum(v - u for u, v in chain) >= 16:
                yield chain
            chain, before = [], a
            while (w := len(text[max(0, before - 99) : before].rstrip(BLANKS)) + max(0, before - 99)) < before:
                before = w - (b - a)  # words of the same width in front
                if before < 0 or not _WORD.fullmatch(text, before, w) or text[max(0, before - 1) : before].strip(BLANKS):
                    break
                chain.insert(0, (before, w))
        chain.append((a, b))
        if b - a >= 16:
            yield [(a, b)]
        behind, closed, by_word = stop, stop > b, False
        while not closed and (word := _NEXT_WORD.match(text, behind)):
            u, v = word.span(2)
            width = chain[-1][1] - chain[-1][0]
            last_line = "\n" in word[1] and not by_word and 16 <= width > v - u and text[v : v + 1] in ("", "\r", "\n", "=")
            if v - u != width and not last_line:
                break
            chain.append((u, v))
            behind, closed, by_word = word.end(), word.end() > v, True
    if len(chain) > 1 and sum(v - u for u, v in chain) >= 16:
        yield chain


def _base64(layer: Layer, most: int) -> Iterator[tuple[Layer | Stream, bool]]:
    """A layer for each stretch of text in the base64 runs, and a stream for each compressed text, with whether it is longer
    than `most`. Whatever stands in front of it in a run or behind it, one of four places to begin groups of four at is
    right. Of joined runs, those that cross a join."""
    for parts in _runs(layer.text):
        run = "".join(layer.text[a:b] for a, b in parts).translate(_URL_SAFE)
        # The last part may be cut so that it looks like a word, which is no part of the run.
        goes_on = layer.stream is not None and parts[-1][1] >= len(layer.text.rstrip(BLANKS)) - 1000
        edges = np.cumsum([0] + [b - a for a, b in parts])
        begins = np.array([a for a, _ in parts])

        def place(k: int | np.ndarray) -> tuple:
            """Part and place in the layer of characters of the run."""
            part = np.searchsorted(edges, k, "right") - 1
            return part, begins[part] + k - edges[part]

        for skip in range(4):
            body = run[skip : len(run) - ((len(run) - skip) % 4 == 1)]
            raw = binascii.a2b_base64(body + "=" * (-len(body) % 4))

            def ends(a: int, b: int) -> tuple[int, int]:
                """First and last character of the run that encode these bytes."""
                return skip + a // 3 * 4, skip + min((b - 1) // 3 * 4 + 4, len(body)) - 1

            def stream(at: int, stop: int, size: int, bare: bool = False) -> Iterator[tuple[Stream, bool]]:
                (u, a), (v, b) = (place(k) for k in ends(at, max(stop, at + 1)))
                if size >= SHORTEST and (len(parts) == 1 or u != v):
                    span = layer.span(a, a + 1)[0], layer.span(b, b + 1)[1]
                    yield Stream(raw, at, most, *span, layer.stream, bare), size > most

            def layer_of(text: str, first: np.ndarray, final: np.ndarray) -> Layer:
                """Text whose characters begin and end at these bytes."""
                if isinstance(layer.start, int):
                    return Layer(text, layer.start, layer.end, layer.stream)
                start = layer.start[place(skip + first // 3 * 4)[1]]
                end = layer.end[place(np.minimum(skip + final // 3 * 4 + 4, skip + len(body)) - 1)[1]]
                return Layer(text, start, end, layer.stream)

            def apart(a: int, b: int) -> bool:
                """Whether these bytes lie in one of the joined parts, which is read by itself too."""
                x, y = ends(a, b)
                return len(parts) > 1 and place(x)[0] == place(y)[0]

            done = 0
            for head in _HEADS.finditer(raw):
                at = head.start()
                if at < done:
                    continue
                size, stop, eof, sure, short = 0, at, True, _SURE.match(raw, at) is not None, b""
                for out, stop, eof in _inflate(raw, at, min(most, PIECE)):
                    size, sure, short = size + len(out), sure or eof, short + out if stop - at < 64 else b""
                done = stop if eof else done
                if stop > at and not eof and stop == len(raw) and goes_on:
                    layer.stream.keep_open()
                chance = size > 8 * (stop - at) or all(len({*short[a:b]}) < 6 for a, b in _stretches(short))
                if not sure and stop - at < 64 and chance:
                    continue  # two bytes that look like a head, and a few characters repeated
                yield from stream(at, stop, size)
            for at in range(skip, len(run), 4):
                if at and run[at - 1] not in "+/" or (at := (at - skip) // 4 * 3) >= len(raw):
                    continue
                stop, size, whole = _raw_deflate(raw, at, min(most, PIECE))
                if whole:
                    yield from stream(at, stop, size, True)
                elif size and stop == len(raw) and goes_on:
                    layer.stream.keep_open()
            for a, b in _stretches(raw):
                if not apart(a, b):
                    first = a + np.flatnonzero((np.frombuffer(raw, np.uint8, b - a, a) & 0xC0) != 0x80)
                    yield layer_of(raw[a:b].decode(), first, np.append(first[1:], b) - 1), False
            for a, b, text in _utf16(raw):
                if not apart(a, b):
                    first = np.arange(a, b, 2)
                    yield layer_of(text, first, first + 1), False


def scan(text: str, most: int = 64 << 20) -> tuple[list[Span], set[Span], int, int]:
    """Spans of the text itself; spans from all layers; number of layers below the text; compressed layers longer than
    `most`, which are scanned in several pieces."""
    base = plain_spans(text)
    every, layers, cut_layers = set(base), 0, 0
    if not ("%" in text or "\\" in text or "U+" in text or next(_runs(text), None)):
        return base, every, 0, 0
    place = np.arange(len(text))
    work: list[Layer | Stream] = [Layer(text, place, place + 1)]
    seen = {hashlib.sha1(text.encode()).digest()}

    def add(one: Layer) -> None:
        nonlocal layers
        a, b = one.span(0, len(one.text))
        digest = hashlib.sha1(one.text.encode(errors="surrogatepass")).digest()
        if digest not in seen and (digest, a, b) not in seen:
            seen.add((digest, a, b))
            layers += 1
            work.append(one)

    while work:
        layer = work.pop()
        if isinstance(layer, Stream):
            if (found := layer.next()) is not None:
                work.append(layer)  # goes on when all layers of this piece are done
                for one in found:
                    if isinstance(one, Layer):
                        add(one)
                    elif (key := (one[0], layer.start, layer.end)) not in seen:
                        seen.add(key)
                        work.append(one[1])
            continue
        if layers:
            every.update((*layer.span(a, b), kind) for a, b, kind in plain_spans(layer.text))
        for one, cut in _base64(layer, most):
            if isinstance(one, Stream):
                cut_layers += cut
                work.append(one)
            else:
                add(one)
        for one in (_percent(layer), _escapes(layer)):
            if one is not None:
                add(one)
    return base, every, layers, cut_layers


def shown(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def redacted(text: str, spans) -> str:
    """The text with every span replaced by `[REDACTED]`; overlapping spans by one."""
    parts, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            parts += [text[at:a], "[REDACTED]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def find_secrets(docs: DataFrame, text: str = "text", redact: bool = False, most: int = 64 << 20) -> DataFrame:
    """Adds n_assign, n_access, n_hex and base_spans (secrets of the text itself), spans (of all layers), n_layers and
    cut_layers; with `redact` the text has its secrets replaced."""
    counts = [f"n_{kind}" for kind in KINDS]
    added = [*counts, "base_spans", "spans", "n_layers", "cut_layers"]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    kinds = {name: "string" if name.endswith("spans") else "long" for name in added}
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"{n} {t}" for n, t in kinds.items()]
    )
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, clean = {name: [] for name in added}, []
            for value in batch.column(where).to_pylist():
                base, every, layers, cut = scan(value or "", most)
                for kind, name in enumerate(counts):
                    rows[name].append(sum(s[2] == kind for s in base))
                rows["base_spans"].append(shown(base))
                rows["spans"].append(shown(every))
                rows["n_layers"].append(layers)
                rows["cut_layers"].append(cut)
                clean.append(redacted(value, every) if redact and every else value)
            columns = list(batch.columns)
            columns[where] = pa.array(clean, pa.string()) if redact else columns[where]
            arrays = [pa.array(rows[n], pa.string() if kinds[n] == "string" else pa.int64()) for n in added]
            yield pa.RecordBatch.from_arrays([*columns, *arrays], [*batch.schema.names, *added])

    return small_batches(docs).mapInArrow(run, schema)
