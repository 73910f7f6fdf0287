"""Secret scans through nested encodings."""

from __future__ import annotations

import base64
import binascii
import re
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentigrid.llm.common import map_rows, text_of

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_KEYWORD = re.compile(r"(?ai)passw|secret|token|api_?key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a run that is too short holds no longer one
_HEX = re.compile(r"[0-9a-f]{16,}")
_ASSIGN_LEAST = 12

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#x[0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# Base64 wrapped over several lines, as MIME and PEM have it.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[\x20\t]*+\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}")
_BREAK = re.compile(r"[\x20\t]*\r?\n[\x20\t]*")
# Where a compressed blob may begin within decoded bytes, and a stretch of text in them; no secret is shorter.
_MAGIC = re.compile(rb"\x28\xb5\x2f\xfd|\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
_STRETCH = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){16,}")
# The same for the ASCII part of UTF-16, low byte or high byte first.
_WIDE = (re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){16,}"), re.compile(rb"(?:\x00[\t\n\r\x20-\x7e]){16,}"))
_CONTROL = bytes(c for c in range(32) if c not in b"\t\n\r") + b"\x7f"
# A blob that unpacks to more bytes is not held whole but read as a stream, in pieces that overlap; n_oversize counts them.
MAX_LAYER = 1 << 26
PIECE = 1 << 20
OVERLAP = 1 << 16


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the plain matches, sorted."""
    out = [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)] if "AKIA" in text else []
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if _KEYWORD.search(text):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _ASSIGN_LEAST]
    return sorted(out)


class _Layer:
    """A decoded text and, for each of its characters, the span of the document it came from."""

    __slots__ = ("text", "start", "end")

    def __init__(self, text: str, start: np.ndarray | None, end: np.ndarray | None) -> None:
        self.text, self.start, self.end = text, start, end

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.start is None:
            return a, b
        return int(self.start[a:b].min()), int(self.end[a:b].max())


def _readable(raw: bytes) -> str | None:
    """The bytes as text, if they are text: UTF-8, hardly any control characters."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    odd = len(raw) - len(raw.translate(None, _CONTROL))
    return text if text and odd * 20 <= len(text) else None


def _stretches(raw: bytes) -> list[tuple[str, np.ndarray]]:
    """Stretches of UTF-8 and of UTF-16 between other bytes, and where each of their characters begins and the last ends."""
    out = []
    for m in _STRETCH.finditer(raw):
        text = m[0].decode("utf-8", "replace")
        out.append((text, m.start() + np.cumsum([0] + [len(c.encode()) for c in text])))
    wide: list[tuple[int, int, int]] = []
    for start, end, high in sorted((m.start(), m.end(), high) for high in (0, 1) for m in _WIDE[high].finditer(raw)):
        # a byte further on the other order shows the same stretch but for a character: the longer counts
        if wide and start < wide[-1][1]:
            if end - start <= wide[-1][1] - wide[-1][0]:
                continue
            wide.pop()
        wide.append((start, end, high))
    for start, end, high in wide:
        out.append((raw[start + high:end:2].decode("ascii"), np.arange(start, end + 1, 2)))
    return out


def _inflate(raw: bytes) -> bytes:
    """A zlib stream, or all members of a gzip file; what was read before a later member breaks is kept."""
    out = b""
    while True:
        stream = zlib.decompressobj(47)
        try:
            out += stream.decompress(raw, MAX_LAYER + 1 - len(out))
        except zlib.error:
            if not out:
                raise
            return out
        raw = stream.unused_data
        if len(out) > MAX_LAYER or not stream.eof or raw[:2] != b"\x1f\x8b":
            return out


def _unpack(raw: bytes) -> bytes | None:
    """What a gzip, zlib or zstandard blob holds; None if it is none. Raises OverflowError beyond the bound."""
    try:
        if raw[:4] == b"\x28\xb5\x2f\xfd":
            with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as stream:
                out = stream.read(MAX_LAYER + 1)
        elif raw[:2] == b"\x1f\x8b" or len(raw) > 2 and raw[0] == 0x78 and (raw[0] << 8 | raw[1]) % 31 == 0:
            out = _inflate(raw)
        else:
            return None
    except (zlib.error, zstandard.ZstdError):
        return None
    if len(out) > MAX_LAYER:
        raise OverflowError
    return out


def _stream(raw: bytes) -> Iterator[bytes]:
    """What a blob unpacks to, in parts of at most PIECE bytes, up to its end or a fault."""
    try:
        if raw[:4] == b"\x28\xb5\x2f\xfd":
            with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as stream:
                while part := stream.read(PIECE):
                    yield part
            return
        while True:
            stream = zlib.decompressobj(47)
            while raw and not stream.eof:
                part = stream.decompress(raw, PIECE)
                raw = stream.unconsumed_tail
                if part:
                    yield part
            if not stream.eof and (part := stream.flush()):
                yield part
            raw = stream.unused_data
            if not stream.eof or raw[:2] != b"\x1f\x8b":
                return
    except (zlib.error, zstandard.ZstdError):
        return


def _unpacked(raw: bytes, seen: set[bytes]) -> Iterator[str | None]:
    """Texts in what a blob unpacks to; None for each blob beyond the bound, before the texts of its pieces."""
    try:
        inner = _unpack(raw)
    except OverflowError:
        yield None
        before = b""
        for part in _stream(raw):
            yield from _inside(before + part, seen)
            before = (before + part)[-OVERLAP:]
        return
    if inner is not None:
        yield from _inside(inner, seen)


def _inside(raw: bytes, seen: set[bytes]) -> Iterator[str | None]:
    """Texts in unpacked bytes: all of them, or else those of archives within, or else the stretches of text."""
    mark = sha256(raw).digest()
    if mark in seen:
        return
    seen.add(mark)
    text = _readable(raw)
    if text is not None:
        yield text
        return
    some = False
    for text in _unpacked(raw, seen):
        some = True
        yield text
    if some:
        return
    for m in _MAGIC.finditer(raw, 1):
        yield from _unpacked(raw[m.start():], seen)
    for text, _ in _stretches(raw):
        yield text


def _whole(layer: _Layer, a: int, b: int, text: str) -> _Layer:
    """A layer of which every character stands for all of the blob."""
    lo, hi = layer.span(a, b)
    return _Layer(text, np.broadcast_to(np.int64(lo), len(text)), np.broadcast_to(np.int64(hi), len(text)))


def _substituted(layer: _Layer, pattern: re.Pattern, decode) -> _Layer | None:
    """The layer with each match replaced; characters outside keep their own place."""
    pieces, starts, ends, at = [], [], [], 0

    def copy(a: int, b: int) -> None:
        pieces.append(layer.text[a:b])
        starts.append(np.arange(a, b) if layer.start is None else layer.start[a:b])
        ends.append(np.arange(a + 1, b + 1) if layer.end is None else layer.end[a:b])

    for m in pattern.finditer(layer.text):
        decoded = decode(m[0])
        if decoded is None:
            continue
        copy(at, m.start())
        for char, a, b in decoded:
            lo, hi = layer.span(m.start() + a, m.start() + b)
            pieces.append(char)
            starts.append(np.array([lo]))
            ends.append(np.array([hi]))
        at = m.end()
    if not pieces:
        return None
    copy(at, len(layer.text))
    return _Layer("".join(pieces), np.concatenate(starts), np.concatenate(ends))


def _url(run: str) -> list[tuple[str, int, int]]:
    """Characters of a run of escapes and their places; a byte that is no UTF-8 stays the escape it is."""
    out, at = [], 0
    for char in bytes.fromhex(run.replace("%", "")).decode("utf-8", "surrogateescape"):
        if "\udc80" <= char <= "\udcff":
            out += [(run[at + i], at + i, at + i + 1) for i in range(3)]
            at += 3
        else:
            width = 3 * len(char.encode())
            out.append((char, at, at + width))
            at += width
    return out


def _code(mark: str) -> list[tuple[str, int, int]] | None:
    if mark.startswith("&#"):
        number = int(mark[3:-1], 16) if mark[2] in "xX" else int(mark[2:-1])
    else:
        number = int(mark[2:].strip("{}"), 16)
    if number > 0x10FFFF or 0xD800 <= number < 0xE000:
        return None
    return [(chr(number), 0, len(mark))]


def _runs(text: str) -> Iterator[tuple[str, np.ndarray]]:
    """Base64 runs and the place of each character: those within a line, and wrapped ones with their line breaks taken out.

    A wrapped run may begin behind a first line and end before a last one that are not part of it, or at the first line
    of another length; all of these are tried.
    """
    for m in _BASE64.finditer(text):
        yield m[0], np.arange(m.start(), m.end())
    for m in _WRAPPED.finditer(text):
        breaks = list(_BREAK.finditer(m[0]))
        lines = list(zip([0] + [b.end() for b in breaks], [b.start() for b in breaks] + [len(m[0])]))
        for first in range(min(2, len(lines) - 1)):
            width = lines[first][1] - lines[first][0]
            short = next((k for k in range(first, len(lines)) if lines[k][1] - lines[k][0] != width), len(lines))
            for last in sorted({len(lines), len(lines) - 1, short + 1, short}):
                if first + 1 < last <= len(lines):
                    own = lines[first:last]
                    yield "".join(m[0][a:b] for a, b in own), np.concatenate([np.arange(a, b) for a, b in own]) + m.start()


def _base64_layers(layer: _Layer) -> Iterator[_Layer | None]:
    """Texts and unpacked texts of base64 runs; None for a blob beyond the bound.

    A run that gives nothing from its first character on may be glued to others: it is decoded from the
    next three too, and blobs and stretches of text within the bytes are taken.
    """
    for run, at in _runs(layer.text):
        if (yield from _decoded(layer, run, at, False)):
            continue
        for skip in range(4):
            yield from _decoded(layer, run[skip:], at[skip:], True)


def _decoded(layer: _Layer, run: str, at: np.ndarray, within: bool):
    """The layers of one run, as a whole or `within` its bytes; returns whether there was one."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    body = body[:len(body) - (len(body) % 4 == 1)]
    try:
        raw = base64.b64decode(body + "=" * (-len(body) % 4))
    except binascii.Error:
        return False
    some, hi = False, int(at[-1]) + 1 if len(at) else 0
    for start in [m.start() for m in _MAGIC.finditer(raw)] if within else [0]:
        for text in _unpacked(raw[start:], set()):
            some = True
            yield None if text is None else _whole(layer, int(at[start * 4 // 3]), hi, text)
    if some:
        return True
    if within:
        texts = _stretches(raw)
    else:
        text = _readable(raw)
        texts = [] if text is None else [(text, np.cumsum([0] + [len(c.encode()) for c in text]))]
    for text, index in texts:
        # byte i of the blob comes from characters i*4/3 to (i+1)*4/3 of the run
        a = at[index[:-1] * 4 // 3]
        b = at[np.minimum(-(-index[1:] * 4 // 3), len(at)) - 1] + 1
        some = True
        if layer.start is None:
            yield _Layer(text, a, b)
        else:
            yield _Layer(text, layer.start[a], layer.end[b - 1])
    return some


def _unwrapped(layer: _Layer) -> Iterator[_Layer | None]:
    """Every layer below this one, made when it is asked for; None for a blob beyond the bound."""
    if "%" in layer.text:
        yield from filter(None, [_substituted(layer, _URL, _url)])
    if "\\" in layer.text or "&#" in layer.text:
        yield from filter(None, [_substituted(layer, _UNICODE, _code)])
    yield from _base64_layers(layer)


def scan(text: str) -> tuple[list, list, int, int]:
    """Plain spans, all spans, number of decoded layers, blobs beyond the bound.

    A worklist: each layer is searched, then unwrapped in every way; what comes out is a further layer,
    until nothing new comes out. A layer seen before at the same place is not entered again, which also ends cycles.
    The list holds what is still to come out of each open layer, so a stream's pieces are not held together.
    """
    base = base_spans(text)
    spans = {(a, k, b) for a, k, b in base}
    seen: set[bytes] = set()
    work, layers, oversize = [(text, _unwrapped(_Layer(text, None, None)))], 0, 0
    while work:
        outer, below = work[-1]
        inner = next(below, False)
        if inner is False:
            work.pop()
            continue
        oversize += inner is None
        if inner is None or inner.text == outer:
            continue
        mark = sha256(inner.text.encode("utf-8", "surrogatepass"))
        mark.update(repr(inner.span(0, len(inner.text))).encode())
        if mark.digest() in seen:
            continue
        seen.add(mark.digest())
        layers += 1
        work.append((inner.text, _unwrapped(inner)))
        for a, kind, b in base_spans(inner.text):
            lo, hi = inner.span(a, b)
            spans.add((lo, kind, hi))
    return base, sorted(spans), layers, oversize


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_spans, spans, n_layers, n_oversize) for every row.

    The counts and `base_spans` are the plain matches in the whole text; `spans` has those and what is found below URL,
    Unicode, base64 and compressed layers, at the place in the document the secret was decoded from
    (code points, end exclusive). A secret inside a compressed blob is placed at the whole blob. Bytes that are no text do
    not hide the text beside them: escapes of such bytes stay, and stretches of UTF-8 and UTF-16 are taken. A blob of over
    64 MB unpacked, counted in `n_oversize`, is read to its end in pieces of 1 MB that share 64 kB, so memory is bounded;
    encoded layers inside such a blob are followed within a piece.

    Very long texts are scanned whole.

    A null text is empty and has no spans; null ids and repeated rows are rows like others; an empty table gives an
    empty result; other columns are ignored.
    """

    def body(ids, texts):
        for i, text in zip(ids, texts):
            base, spans, layers, oversize = scan(text)
            count = [sum(k == kind for _, k, _ in base) for kind in range(3)]
            yield (i, *count, told(base), told(spans), layers, oversize)

    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    return map_rows(picked, body, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_spans string, "
                                  "spans string, n_layers bigint, n_oversize bigint")
