"""Secret scans: patterns over a text and over whatever is encoded in it.

A worklist holds layers. The first is the text; each layer is scanned and then unwrapped: percent
escapes and Unicode escapes give the layer with its escapes replaced, a base64 token gives a layer of
its own at each of its four alignments (what stands before a token may look like a part of it) that leaves as many characters as the shortest
secret takes, and bytes that are gzip, zlib, bzip2 or xz are decompressed: those of a token, and streams in runs of escapes and of characters left as they are. A
stream that is cut or damaged gives what comes before that (for bzip2 and xz up to the last whole block). Levels of escapes that only escape the sign of an escape (%2525...) are taken off at once, down to one. Layers that were seen before at the same place
are left out, so the list ends at a fixpoint even where layers lead back to themselves. Every layer knows
for each of its characters the characters of the first text it came from, so that what is found in it
has a span there: the escapes themselves, the base64 characters, or the whole token of a compressed layer.

Results for odd rows: a null text is empty and has no secrets. Layers that aren't UTF-8 are read as Latin-1; of base64 that isn't, the
stretches of ASCII and the lines with escapes are, since nothing else can hold a secret or a coding. What
decompresses to more than PIECE bytes is scanned in pieces as it comes, a run of more than LAYER_BYTES without a line end in overlapping ones. Repeated rows get equal results.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import urllib.parse
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeweave.llm.arrow import annotate

#: Decompressed bytes are scanned in pieces of PIECE bytes and more, cut between lines; pieces without a line end have up to LAYER_BYTES.
LAYER_BYTES, PIECE, OVERLAP, BLOCK = 64 << 20, 8 << 20, 1 << 20, 1 << 20
# Kinds in order, their patterns, and the least length of what counts.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
_ONE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\[uUx]([0-9A-Fa-f]+)|&#([0-9]+);|&#[xX]([0-9A-Fa-f]+);")
# Runs of escapes and of what coders leave as it is; bytes that can begin a compressed stream.
_PERCENT_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2}|[!-$&-~])+")
_SHORT = {"0": 0, "a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13}
_BYTE = re.compile(
    r"\\u\{0*([0-9A-Fa-f]{1,2})\}|\\(?:u00|U000000|x)([0-9A-Fa-f]{2})|&#0*([0-9]{1,3});|&#[xX]0*([0-9A-Fa-f]{1,2});|\\([0abtnvfr\\'\"/])|([^\\\r\n\u0100-\U0010ffff])"
)
_BYTES_LINE = re.compile(r"[^\r\n\u0100-\U0010ffff]+")
_ANY_ESCAPE = re.compile(r"""\\[uUx0abtnvfr\\'"/]|&#""")
_UNIT = re.compile(r"%[0-9A-Fa-f]{2}|.")
_BINARY = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f-\xff]")
# Bytes that can begin a stream: zlib's two are a multiple of 31, and so is this list of all of them.
_ZLIB = b"|".join(re.escape(bytes(h)) for h in ((a, b) for a in range(8, 0x79, 16) for b in range(256)) if (h[0] << 8 | h[1]) % 31 == 0)
_HEAD = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|" + _ZLIB, re.DOTALL)
# What of bytes that are no text can hold a pattern or a coding: ASCII, and lines with an escape.
_STRETCH = re.compile(rb"[\t\n\r\x20-\x7e]{12,}")
_LINE, _ESCAPE_BYTES = re.compile(rb"[^\r\n]+"), re.compile(rb"""\\[uUx0abtnvfr\\'"/]|&#""")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")  # LEAST_BASE64
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{60,}\r?\n)+[A-Za-z0-9+/_-]{2,}={0,2}")
#: Bytes that a cut or damaged stream gives at least: no secret is shorter. Base64 characters that hold as many. Bytes fed at first, and at most.
CUT, LEAST_BASE64, FEED, MOST_FED = 12, 16, 64, 1 << 16
# Levels that only escape the sign of an escape, two and more, and what is left of them: one.
_LEVELS = {
    "url": ((re.compile(r"%25(?:25)+(?=[0-9A-Fa-f]{2})"), "%25"),),
    "unicode": (
        (re.compile(r"\\u005[cC](?:u005[cC])+(?=u[0-9A-Fa-f]{4})"), "\\u005c"),
        (re.compile(r"\\x5[cC](?:x5[cC])+(?=x[0-9A-Fa-f]{2})"), "\\x5c"),
        (re.compile(r"&#38;(?:#38;)+(?=#)"), "&#38;"),
        (re.compile(r"&#[xX]26;(?:#[xX]26;)+(?=#)"), "&#x26;"),
    ),
}
#: Bytes that neither a pattern nor a coding has.
_BREAKS = (b"\n", b"\r", b"\x00")

_SECRET = T.StructType()
for _name, _type in (("kind", T.StringType()), ("start", T.LongType()), ("end", T.LongType()), ("value", T.StringType()), ("depth", T.IntegerType()), ("via", T.StringType())):
    _SECRET.add(_name, _type)
ADDED = T.StructType([T.StructField("secrets", T.ArrayType(_SECRET))])


def matches(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and not overlapping within a kind."""
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= LEAST["access"]:
                yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


class Layer:
    """A text whose character i came from characters starts[i] up to ends[i] of the first text."""

    __slots__ = ("ends", "starts", "text", "via")

    def __init__(self, text: str, starts: np.ndarray | None, ends: np.ndarray | None, via: tuple[str, ...]) -> None:
        self.text, self.starts, self.ends, self.via = text, starts, ends, via

    def span(self, start: int, end: int) -> tuple[int, int]:
        """In the first text. start < end."""
        if self.starts is None:
            return start, end
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())

    def maps(self) -> tuple[np.ndarray, np.ndarray]:
        if self.starts is None:
            at = np.arange(len(self.text))
            return at, at + 1
        return self.starts, self.ends

    def key(self) -> tuple[bytes, int, int]:
        where = self.span(0, len(self.text)) if self.text else (0, 0)
        return hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).digest(), *where


def headed(data: bytes | memoryview) -> bool:
    """Whether data begins like gzip, zlib, bzip2 or xz."""
    return _HEAD.match(data) is not None


def opened(data: bytes | memoryview) -> Any:
    """What decompresses a stream that begins like data."""
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor(lzma.FORMAT_XZ) if data[:1] == b"\xfd" else zlib.decompressobj(47)


def given(box: Any, block: bytes | memoryview) -> Iterator[bytes]:
    """What block adds, up to BLOCK bytes at a time; zlib.error if it is damaged."""
    try:
        yield box.decompress(block, BLOCK)
        if hasattr(box, "needs_input"):
            while not box.eof and not box.needs_input:
                yield box.decompress(b"", BLOCK)
        else:
            while not box.eof and box.unconsumed_tail:
                yield box.decompress(box.unconsumed_tail, BLOCK)
    except (OSError, EOFError, lzma.LZMAError) as e:
        raise zlib.error(str(e)) from e


def inflated(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """What all members of a stream hold, up to BLOCK bytes at a time; zlib.error if it is cut or damaged."""
    rest = next(blocks, b"")
    box = opened(rest)
    while True:
        if not rest and not (rest := next(blocks, b"")):
            if box.eof:
                return
            raise zlib.error("cut")
        if box.eof:
            if len(rest) < 2:
                rest += next(blocks, b"")
            if rest[:2] != b"\x1f\x8b":
                return
            box = zlib.decompressobj(47)
        yield from filter(None, given(box, rest))
        rest = box.unused_data if box.eof else b""


def salvaged(data: bytes | memoryview) -> Iterator[bytes]:
    """What a stream gives up to where it is cut or damaged, to the byte for gzip and zlib."""
    box, at, step = opened(data), 0, FEED
    while at < len(data) and not box.eof:
        block = data[at : at + step]
        before = box.copy() if hasattr(box, "copy") else None
        out: list[bytes] = []
        try:
            out.extend(given(box, block))
        except zlib.error:
            if before is not None:
                try:
                    for i in range(len(block)):
                        yield before.decompress(block[i : i + 1])
                except zlib.error:
                    pass
            return
        yield from out
        at, step = at + len(block), min(2 * step, MOST_FED)


def stream_size(data: bytes | memoryview) -> tuple[int, bool] | None:
    """Bytes of the stream that data begins with, and whether it is whole. None if it is none, or gives less than CUT bytes before it is cut.

    Little is fed at first, so that what only begins like a stream costs little.
    """
    if not headed(data):
        return None
    size = 0
    while True:
        box, at, step = opened(data[size : size + 8]), size, FEED
        try:
            while not box.eof and at < len(data):
                for _ in given(box, data[at : at + step]):
                    pass
                at, step = min(len(data), at + step), min(2 * step, MOST_FED)
            whole = box.eof
        except zlib.error:
            whole = False
        if not whole:
            if size:
                return size, True
            n = 0
            for out in salvaged(data):
                n += len(out)
                if n >= CUT:
                    return len(data), False
            return None
        size = at - len(box.unused_data)
        if data[size : size + 2] != b"\x1f\x8b":
            return size, True


def decoded(data: bytes) -> str:
    """Bytes as a text: UTF-8, or else Latin-1."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def pieces(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """blocks put together into pieces of about PIECE bytes, cut after bytes that no pattern and no coding has.

    A piece without such a byte grows up to LAYER_BYTES; then it is cut anywhere, and its last OVERLAP bytes begin the next one too.
    """
    held = bytearray()
    for block in blocks:
        held += block
        if len(held) >= PIECE:
            cut = max(held.rfind(b) + 1 for b in _BREAKS)
            if cut:
                yield bytes(held[:cut])
                del held[:cut]
            elif len(held) >= LAYER_BYTES:
                yield bytes(held)
                del held[:-OVERLAP]
    if held:
        yield bytes(held)


def _sizes(text: str) -> np.ndarray:
    """UTF-8 bytes of each character."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)


def _whole(layer: Layer, start: int, end: int, data: bytes, via: str) -> Iterator[Layer]:
    """The decompressed text, in pieces, of layer's characters from start to end; each character came from all of them."""
    if (found := stream_size(data)) is None:
        return
    a, b = layer.span(start, end)
    size, whole = found
    stream, steps = data[:size], (*layer.via, via, "compressed")
    make: Callable[[], Iterator[bytes]] | None = lambda: inflated(iter([stream])) if whole else salvaged(stream)
    seen = {hashlib.sha256(stream).digest()}
    while make is not None:
        for piece in pieces(make()):
            text = decoded(piece)
            yield Layer(text, np.broadcast_to(np.int64(a), len(text)), np.broadcast_to(np.int64(b), len(text)), steps)
        make, steps = _nested(make, seen), (*steps, "compressed")


def _nested(make: Callable[[], Iterator[bytes]], seen: set[bytes]) -> Callable[[], Iterator[bytes]] | None:
    """What the stream in make's bytes holds, or None if they are no whole stream or lead back to bytes in seen."""
    if not headed(next(make(), b"")):
        return None
    held, size, own, inner = [], 0, hashlib.sha256(), hashlib.sha256()
    try:
        for block in inflated(make()):
            inner.update(block)
            size += len(block)
            if size <= PIECE:
                held.append(block)
    except zlib.error:
        return None
    for block in make():
        own.update(block)
    seen.add(own.digest())
    if not size or inner.digest() in seen:
        return None
    whole = b"".join(held)
    return (lambda: iter([whole])) if size <= PIECE else lambda: inflated(make())


def _streams(layer: Layer, data: bytes, first: np.ndarray, last: np.ndarray, via: str) -> Iterator[Layer]:
    """The decompressed text of each stream in data; byte i of data stands in layer from first[i] to last[i]."""
    done, view = 0, memoryview(data)
    for m in _HEAD.finditer(data):
        at = m.start()
        if at < done or (found := stream_size(view[at:])) is None:
            continue
        size, whole = found
        done = at + (size if whole else 2)
        yield from _whole(layer, int(first[at]), int(last[at + size - 1]), data[at : at + size], via)


def _percent_streams(layer: Layer) -> Iterator[Layer]:
    for m in _PERCENT_RUN.finditer(layer.text):
        if "%" not in m[0]:
            continue
        data = urllib.parse.unquote_to_bytes(m[0])
        if not _BINARY.search(data):
            continue
        sizes = np.fromiter((len(x) for x in _UNIT.findall(m[0])), np.int64, len(data))
        last = m.start() + np.cumsum(sizes)
        for some in {data, urllib.parse.unquote_to_bytes(m[0].replace("+", "%20"))}:
            yield from _streams(layer, some, last - sizes, last, "url")


def _byte(m: re.Match[str]) -> int:
    if m[6]:
        return ord(m[6])
    if m[5]:
        return _SHORT.get(m[5], ord(m[5]))
    return int(m[3]) if m[3] else int(m[1] or m[2] or m[4], 16)


def _escape_streams(layer: Layer) -> Iterator[Layer]:
    """Streams in runs of escapes and other characters, each of which is a byte: runs end with lines, so lines without an escape have none."""
    for line in _BYTES_LINE.finditer(layer.text):
        if _ANY_ESCAPE.search(line[0]):
            yield from _line_streams(layer, line.start(), line.end())


def _line_streams(layer: Layer, start: int, end: int) -> Iterator[Layer]:
    run: list[tuple[int, int, int]] = []
    at = start

    def streams() -> Iterator[Layer]:
        data = bytes(x for x, _, _ in run)
        if _BINARY.search(data):
            yield from _streams(layer, data, np.array([a for _, a, _ in run]), np.array([b for _, _, b in run]), "unicode")

    for m in _BYTE.finditer(layer.text, start, end):
        value = _byte(m)
        if run and (m.start() != at or value > 0xFF):
            yield from streams()
            run = []
        if value <= 0xFF:
            run.append((value, m.start(), m.end()))
        at = m.end()
    if run:
        yield from streams()


def _replaced(layer: Layer, runs: list[tuple[int, int, str, np.ndarray, np.ndarray]], *via: str) -> Layer:
    """The layer with runs (start, end, new text, and for its characters starts and ends in layer) put in."""
    starts, ends = layer.maps()
    text, new_starts, new_ends, at = [], [], [], 0
    for start, end, new, first, last in runs:
        text += [layer.text[at:start], new]
        new_starts += [starts[at:start], starts[first]]
        new_ends += [ends[at:start], ends[last - 1]]
        at = end
    return Layer(
        "".join([*text, layer.text[at:]]), np.concatenate([*new_starts, starts[at:]]), np.concatenate([*new_ends, ends[at:]]), (*layer.via, *via)
    )


def _flat(layer: Layer, via: str) -> Layer | None:
    """The layer with levels that only escape the sign of an escape taken off, down to one; None if there are no such levels."""
    runs, levels = [], 0
    for pattern, left in _LEVELS[via]:
        for m in pattern.finditer(layer.text):
            runs.append((m.start(), m.end(), left, np.full(len(left), m.start()), np.full(len(left), m.end())))
            levels = max(levels, (m.end() - m.start() - len(left)) // (len(left) - 1))
    return _replaced(layer, sorted(runs, key=lambda r: r[0]), *[via] * levels) if runs else None


def _percent(layer: Layer) -> Iterator[Layer]:
    if flat := _flat(layer, "url"):
        yield flat
        return
    runs = []
    for m in _PERCENT.finditer(layer.text):
        data = bytes.fromhex(m[0].replace("%", ""))
        try:
            new = data.decode("utf-8")
        except UnicodeDecodeError:
            new = data.decode("latin-1")
            sizes = np.ones(len(new), np.int64)
        else:
            sizes = _sizes(new)
        last = m.start() + 3 * np.cumsum(sizes)
        runs.append((m.start(), m.end(), new, last - 3 * sizes, last))
    if runs:
        yield _replaced(layer, runs, "url")


def _escapes(layer: Layer) -> Iterator[Layer]:
    if flat := _flat(layer, "unicode"):
        yield flat
        return
    runs = []
    for m in _ESCAPE.finditer(layer.text):
        chars: list[tuple[int, int, int]] = []
        for one in _ONE.finditer(m[0]):
            code = int(one[3]) if one[3] else int(one[1] or one[2] or one[4], 16)
            begin, end = m.start() + one.start(), m.start() + one.end()
            if chars and 0xDC00 <= code < 0xE000 and 0xD800 <= chars[-1][0] < 0xDC00:
                high, begin, _ = chars.pop()
                code = 0x10000 + ((high - 0xD800) << 10) + (code - 0xDC00)
            chars.append((code, begin, end))
        chars = [(0xFFFD if c > 0x10FFFF or 0xD800 <= c < 0xE000 else c, a, b) for c, a, b in chars]
        runs.append((m.start(), m.end(), "".join(chr(c) for c, _, _ in chars), np.array([a for _, a, _ in chars]), np.array([b for _, _, b in chars])))
    if runs:
        yield _replaced(layer, runs, "unicode")


def _decode(layer: Layer, token: str, places: np.ndarray, ends: np.ndarray) -> Iterator[Layer]:
    """What the base64 characters of token hold; they stand in layer from places up to ends."""
    token = token[: len(token) - (len(token) % 4 == 1)]
    try:
        data = base64.b64decode(token + "=" * (-len(token) % 4))
    except binascii.Error:
        return
    if _HEAD.search(data):
        byte = np.arange(len(data))
        yield from _streams(layer, data, places[byte * 8 // 6], ends[(byte * 8 + 13) // 6 - 1], "base64")
    starts, stops = layer.maps()

    def piece(text: str, first: np.ndarray, last: np.ndarray) -> Layer:
        return Layer(text, starts[places[first * 8 // 6]], stops[ends[(last * 8 + 5) // 6 - 1] - 1], (*layer.via, "base64"))

    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        # Bytes: only stretches that can hold something become layers.
        lines = (m for m in _LINE.finditer(data) if _ESCAPE_BYTES.search(m[0])) if _ESCAPE_BYTES.search(data) else ()
        for m in (*_STRETCH.finditer(data), *lines):
            at = np.arange(m.start(), m.end())
            yield piece(m[0].decode("latin-1"), at, at + 1)
        return
    if text:
        last = np.cumsum(_sizes(text))
        yield piece(text, np.concatenate([[0], last[:-1]]), last)


def _base64(layer: Layer) -> Iterator[Layer]:
    for m in _WRAPPED.finditer(layer.text):
        bare = re.sub(r"[\r\n=]", "", m[0]).translate({45: 43, 95: 47})
        places = m.start() + np.array([i for i, c in enumerate(m[0]) if c not in "\r\n="])
        for skip in range(4):
            yield from _decode(layer, bare[skip:], places[skip:], places[skip:] + 1)
    for m in _BASE64.finditer(layer.text):
        token = m[0].rstrip("=").translate({45: 43, 95: 47})
        whole = stream_size(_bytes(token))
        if whole is not None and whole[1]:
            yield from _whole(layer, m.start(), m.end(), _bytes(token), "base64")
            continue
        places = np.arange(m.start(), m.start() + len(token))
        for skip in range(4):
            if len(token) - skip >= LEAST_BASE64:
                yield from _decode(layer, token[skip:], places[skip:], places[skip:] + 1)


def _bytes(token: str) -> bytes:
    token = token[: len(token) - (len(token) % 4 == 1)]
    return base64.b64decode(token + "=" * (-len(token) % 4))


def unwrap(layer: Layer) -> Iterator[Layer]:
    if "%" in layer.text:
        yield from _percent_streams(layer)
        yield from _percent(layer)
    if _ANY_ESCAPE.search(layer.text):
        yield from _escape_streams(layer)
        yield from _escapes(layer)
    yield from _base64(layer)


def scan(text: str) -> list[tuple[str, int, int, str, int, str]]:
    """(kind, start, end, value, depth, via) by start, kind and end; depth 0 is the text itself."""
    found: dict[tuple[int, int, int, int, str], tuple[str, int, int, str, int, str]] = {}
    seen: set[tuple[bytes, int, int]] = set()
    work = deque([Layer(text, None, None, ())])

    def visit(layer: Layer) -> None:
        depth = len(layer.via)
        for kind, a, b in matches(layer.text):
            start, end = layer.span(a, b)
            found.setdefault((start, KINDS.index(kind), end, depth, layer.text[a:b]), (kind, start, end, layer.text[a:b], depth, ">".join(layer.via)))
        for inner in unwrap(layer):
            if inner.text and (key := inner.key()) not in seen:
                seen.add(key)
                if len(inner.text) >= PIECE // 4:  # large ones aren't held until their turn
                    visit(inner)
                else:
                    work.append(inner)

    while work:
        visit(work.popleft())
    return [found[k] for k in sorted(found) if not any((*k[:3], d, k[4]) in found for d in range(k[3]))]


def scan_secrets(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (columns in keep) with secrets: kind, start, end (code points), value, depth, via."""
    return annotate(
        docs, [text_col], ADDED, lambda: lambda texts: ((scan(t or ""),) for t in texts), keep
    )
