"""Secret scan with a recursive decoding worklist.

A text and every layer found in it - URL escapes, Unicode escapes, base64 runs and
compressed data, in any nesting - are scanned with the same patterns, and each match is
mapped back to the characters of the text that produced it.  The worklist ends at the
fixpoint: a layer with the same content over the same characters is never done twice,
which also stops cycles (data that decompresses to itself).

Base64 is decoded at all four alignments, as other characters of its alphabet may be
glued to it, and lines of it are joined first.  Compressed data is found by its first
bytes anywhere in decoded base64, in decompressed data, and in URL, Unicode and C escapes
taken as one character a byte; members that follow each other are one stream.

One narrow pass, no shuffle.  A layer maps positions to its parent's; escapes keep an
exact position per character, base64 the characters that carry a byte, and compressed
data the whole base64 run or the escapes it came from.

Defined results: null counts as empty; spans are (kind, start, end) in code points, each
once, by start, then kind as listed, then end; base matches always stay.  Decompressed
data is read to its end, in windows of ``WINDOW`` bytes.  A window overlaps the next by
``OVERLAP`` bytes and by the encoded run open at its end; compressed data inside that a
window's end cuts off waits for the next window and goes on there, at any nesting.  An
encoded run that fills a window is read piece by piece, and ``n_cut_layers`` reports it.  With ``max_layer_bytes`` (a guard against bombs, off by
default) a layer stops there, which is reported likewise.
"""
from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

from variantlake.llm.common import tidied

KINDS = ("assign", "access", "hex")
WINDOW, OVERLAP = 64 << 20, 1 << 20
MAGIC = 10  # bytes that tell compressed data at most
PIECE = 64  # compressed bytes a step: damaged data loses what the failing step would give
MASK = "[SECRET]"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # greedy runs: the same matches as [0-9a-f]+ of 24 or more
_ASSIGN_HINTS = ("passw", "secret", "token", "api")

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(
    r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u\{[0-9a-fA-F]{1,6}\}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}"
    r"|\\x[0-9a-fA-F]{2}|&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};")
_C_ESCAPE = re.compile(_ESCAPE.pattern + r"""|\\[0-7]{1,3}|\\[abfnrtv'"\\/]""")
_C_CHARS = dict(zip("abfnrtv", "\a\b\f\n\r\t\v"))
_LONG = re.compile(r"[A-Za-z0-9+/_-]{16}")
_BREAK = r"[\x20\t]*(?:\r\n?|\n|(?:\\r)?\\n)[\x20\t>]*"
_BASE64 = re.compile(  # runs of 16 or more, with the lines around them
    rf"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{{16,}}|[A-Za-z0-9+/_-]+(?={_BREAK}[A-Za-z0-9+/_-]{{16}}))(?:{_BREAK}[A-Za-z0-9+/_-]+)*={{0,2}}")
_WORDS64 = re.compile(r"[A-Za-z0-9+/_-]+")
_BREAKS = re.compile(_BREAK)
_PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\0|\x28\xb5\x2f\xfd|x[\x01^\x9c\xda]")
_RUN_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=%\\{}&#;\r\n\0"

Span = tuple[int, int]
Mapper = Callable[[int, int], Span]


def matches(text: str) -> list[tuple[str, int, int]]:
    """The base matches of one layer."""
    found = []
    lowered = text.lower()
    if any(h in lowered for h in _ASSIGN_HINTS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def _replaced(text: str, pieces: list[tuple[int, int, str, list[Span]]]) -> tuple[str, Mapper]:
    """``text`` with pieces (start, end, decoded, source span of each decoded character)
    put in, and the mapping of spans back to ``text``."""
    out, decoded_at, source_at, spans, at, length = [], [], [], [], 0, 0
    for start, end, decoded, sources in pieces:
        out += [text[at:start], decoded]
        length += start - at
        decoded_at.append(length)
        source_at.append(end)
        spans.append(sources)
        length += len(decoded)
        at = end
    out.append(text[at:])

    def source(i: int) -> Span:
        k = bisect_right(decoded_at, i) - 1
        if k < 0:
            return i, i + 1
        inside = i - decoded_at[k]
        if inside < len(spans[k]):
            return spans[k][inside]
        plain = source_at[k] + inside - len(spans[k])
        return plain, plain + 1

    return "".join(out), lambda s, e: (source(s)[0], source(e - 1)[1])


def _byte_text(raw: bytes) -> tuple[str, list[int]]:
    """Bytes as text (UTF-8, else one character a byte) with each character's first byte."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
        return text, list(range(len(text) + 1))
    if len(text) == len(raw):
        return text, list(range(len(text) + 1))
    starts = [0]
    for ch in text:
        starts.append(starts[-1] + len(ch.encode("utf-8")))
    return text, starts


def _byte_texts(raw: bytes) -> Iterator[tuple[str, Sequence[int]]]:
    """All readings of bytes as text, each with its characters' first bytes (and the end):
    ``_byte_text``, and UTF-16 in both byte orders from both offsets where a zero byte is
    the high half of a unit - without one, no ASCII character and so no secret is there."""
    yield _byte_text(raw)
    for offset in (0, 1) if b"\0" in raw else ():
        n = (len(raw) - offset) // 2
        for order, high in (("<", 1), (">", 0)):
            if 0 not in raw[offset + high : offset + 2 * n : 2]:
                continue
            units = np.frombuffer(raw, order + "u2", n, offset).astype("<u4")
            units[(units >= 0xD800) & (units < 0xE000)] = 0xFFFD
            yield units.tobytes().decode("utf-32-le"), range(offset, offset + 2 * n + 1, 2)


def _unescape_url(text: str) -> tuple[str, Mapper] | None:
    if "%" not in text:
        return None
    pieces = []
    for m in _URL.finditer(text):
        decoded, starts = _byte_text(bytes.fromhex(m.group().replace("%", "")))
        pieces.append((m.start(), m.end(), decoded, [(m.start() + 3 * a, m.start() + 3 * b) for a, b in zip(starts, starts[1:])]))
    return _replaced(text, pieces) if pieces else None


def _escape_char(escape: str) -> str:
    if escape.startswith("&#"):
        code = int(escape[3:-1], 16) if escape[2] in "xX" else int(escape[2:-1])
    elif escape.count("\\") == 2:
        high, low = int(escape[2:6], 16), int(escape[8:], 16)
        code = 0x10000 + ((high - 0xD800) << 10) + (low - 0xDC00)
    else:
        code = int(escape[2:].strip("{}"), 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"


def _unescape_unicode(text: str) -> tuple[str, Mapper] | None:
    if "\\" not in text and "&#" not in text:
        return None
    pieces = [(m.start(), m.end(), _escape_char(m.group()), [m.span()]) for m in _ESCAPE.finditer(text)]
    return _replaced(text, pieces) if pieces else None


def _byte_forms(text: str) -> Iterator[tuple[str, Mapper]]:
    """Escapes of ``text`` as one character a byte, whatever the bytes say."""
    if "%" in text and _URL.search(text):
        for plain in {text, text.replace("+", " ")}:
            yield _replaced(plain, [
                (m.start(), m.end(), bytes.fromhex(m.group().replace("%", "")).decode("latin-1"), [(i, i + 3) for i in range(m.start(), m.end(), 3)])
                for m in _URL.finditer(plain)])
    if ("\\" in text or "&#" in text) and _ESCAPE.search(text):
        yield _replaced(text, [(m.start(), m.end(), _c_char(m.group()), [m.span()]) for m in _C_ESCAPE.finditer(text)])


def _c_char(escape: str) -> str:
    if escape[0] == "&" or escape[1] in "uUx":
        return _escape_char(escape)
    return chr(int(escape[1:], 8) & 255) if escape[1].isdigit() else _C_CHARS.get(escape[1], escape[1])


def _decompressor(head: bytes):
    if head[:2] == b"\x1f\x8b" or head[0] == 0x78:
        return zlib.decompressobj(47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:1] == b"\xfd":
        return lzma.LZMADecompressor()
    return zstandard.ZstdDecompressor().decompressobj()


class _Source:
    """A stream read in windows: the bytes that the newest window adds, where it ends, where
    compressed data is to be looked for next, the reader that waits for more of it, and the
    windows that the stream lies in."""

    def __init__(self, path: frozenset = frozenset()):
        self.fresh, self.end, self.look, self.waiting, self.path = b"", 0, 0, None, path


def _inflated(raw: bytes, at: int, end: list[int], source: _Source | None = None) -> Iterator[bytes | None]:
    """Decompressed parts (what can be read of damaged data) of the compressed data at
    ``at``, with the members right after it; ``end`` gets where it ends.  When ``raw`` ends
    first, None is yielded, and ``source.fresh`` read on the return."""
    gone = 0
    while _PACKED.match(raw, at):
        step = _decompressor(raw[at : at + 6])
        try:
            while not step.eof:
                if at >= len(raw):
                    if source is not None:
                        yield None
                    if source is None or not source.fresh:
                        end[0] = gone + at
                        if part := step.flush() if hasattr(step, "flush") else b"":
                            yield part
                        return
                    gone, raw, at = gone + at, source.fresh, 0
                piece = raw[at : at + PIECE]
                at += len(piece)
                yield from _step(step, piece)
        except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError):
            end[0] = gone + at
            return
        at -= len(step.unused_data)
        end[0] = gone + at
        while True:
            if raw[at : at + 1] == b"\0":  # padding between members
                at = len(raw) - len(raw[at:].lstrip(b"\0"))
            if source is None or len(raw) - at >= MAGIC:
                break
            yield None  # the next member may begin here
            if not source.fresh:
                break
            gone, raw, at = gone + at, raw[at:] + source.fresh, 0


def _step(step, piece: bytes) -> Iterator[bytes]:
    """What one piece of input gives, in parts of bounded size where the format lets us."""
    if isinstance(step, (bz2.BZ2Decompressor, lzma.LZMADecompressor)):
        while part := step.decompress(piece, 1 << 20):
            yield part
            if step.eof or step.needs_input:
                return
            piece = b""
    elif isinstance(step, type(zlib.decompressobj())):
        while piece:
            if part := step.decompress(piece, 1 << 20):
                yield part
            piece = step.unconsumed_tail
    elif part := step.decompress(piece):
        yield part


def _windows(parts: Iterator[bytes | None], limit: int | None, cut: list[int]) -> Iterator[tuple[bytes, int, int] | None]:
    """A stream in overlapping windows, each with where it begins and how many bytes of it
    are new; ``cut`` counts layers cut by ``limit`` and runs that fill a window."""
    held, total, fresh, filled, old = bytearray(), 0, False, False, 0
    for part in parts:
        if part is None:
            yield None
            continue
        over = limit is not None and total + len(part) > limit
        part = part[: limit - total] if over else part
        held += part
        total += len(part)
        fresh |= bool(part)
        if over:
            cut[0] += 1
            break
        if len(held) >= WINDOW:
            yield bytes(held), total - len(held), len(held) - old
            tail = min(len(held) - OVERLAP, len(held.rstrip(_RUN_BYTES)))
            if tail <= 0:
                filled |= bool(held.strip(b"\0"))
                tail = len(held) - OVERLAP
            del held[:tail]
            fresh, old = False, len(held)
    cut[0] += filled
    if fresh:
        yield bytes(held), total - len(held), len(held) - old


def _base64_runs(text: str) -> Iterator[tuple[bytes, Mapper]]:
    """The bytes of base64 runs at each alignment, and the mapping of byte ranges to ``text``."""
    if not _LONG.search(text):
        return
    for m in _BASE64.finditer(text):
        run, start = m.group().rstrip("="), m.start()
        at: Sequence[int] = range(start, start + len(run))
        if _BREAKS.search(run):
            at, lines, place = [], [], 0
            while w := _WORDS64.match(run, place):
                lines.append(w.group())
                at += range(start + place, start + w.end())
                gap = _BREAKS.match(run, w.end())
                place = gap.end() if gap else len(run)
            run = "".join(lines)
        run = run.replace("-", "+").replace("_", "/")
        for skip in range(4):
            part = run[skip:]
            part = part[: len(part) - (len(part) % 4 == 1)]
            raw = base64.b64decode(part + "=" * (-len(part) % 4))

            def back(a: int, b: int, at=at, skip=skip) -> Span:
                return at[skip + a * 8 // 6], at[skip - (-b * 8 // 6) - 1] + 1

            if raw:
                yield raw, back


def _up(chain: tuple | None, s: int, e: int) -> Span:
    """A span of a layer in the text: ``chain`` is (mapper to the parent, the parent's chain)."""
    while chain is not None:
        s, e = chain[0](s, e)
        chain = chain[1]
    return s, e


def scan(text: str | None, max_layer_bytes: int | None = None) -> tuple[list, list, int, int]:
    """(base matches, all spans, layers scanned, layers cut) of one text."""
    text = text or ""
    base = sorted(matches(text), key=lambda x: (x[1], KINDS.index(x[0])))
    spans = set(base)
    done: set = set()
    waits: dict = {}  # where the compressed data begins that a window's end cuts off
    layers, cut = 0, [0]

    def named(data: bytes, kind: str, chain, length: int) -> tuple:
        return kind, hashlib.blake2b(data, digest_size=16).digest(), _up(chain, 0, length)

    def new(key: tuple) -> bool:
        if key in done:
            return False
        done.add(key)
        return True

    def of_text(layer: str, chain):
        for child in (_unescape_url(layer), _unescape_unicode(layer)):
            if child is not None:
                yield child[0], (child[1], chain)
        for form, back in _byte_forms(layer):
            yield from packed(form.encode("latin-1", "replace"), (back, chain), None)
        for raw, back in _base64_runs(layer):
            yield raw, (back, chain)

    def of_bytes(raw: bytes, chain, key: tuple, source: _Source | None = None, begin: int = 0):
        for found, starts in _byte_texts(raw):
            yield found, (lambda a, b, starts=starts: (starts[a], starts[b]), chain)
        yield from packed(raw, chain, key[2], key, source, begin)

    def packed(raw: bytes, chain, whole: Span | None, key: tuple | None = None, source: _Source | None = None, begin: int = 0, only: int | None = None):
        """Windows of the compressed data in ``raw``, which begins at ``begin`` of ``source``;
        ``(None, source)`` when the data goes on in its next window.  ``only``: just the data
        there, which another stream with the same window had to end with."""
        at = max(0, source.look - begin) if source else 0
        if only is not None:
            if only < at:
                return
            at = only
        while m := _PACKED.search(raw, at):
            end = [m.end()]
            span = whole
            if span is None:  # escapes: as far as the data goes
                if not any([bool(p) for p in _inflated(raw, m.start(), end)]):
                    at = m.start() + 1
                    continue
                span = _up(chain, m.start(), end[0])
            found, waited = False, False
            inner = _Source((source.path if source else frozenset()) | {key})
            for window in _windows(_inflated(raw, m.start(), end, source), max_layer_bytes, cut):
                if window is None:
                    if not waited:
                        waits[key] = m.start()
                    waited, source.look = True, source.end
                    yield None, source
                    continue
                layer, start, fresh = window
                found, inner.fresh, inner.end = True, layer[len(layer) - fresh:], start + len(layer)
                yield layer, (lambda a, b, span=span: span, None), inner, start
            inner.fresh = b""
            if inner.waiting is not None:
                yield b"", None, inner, 0  # what waits for more gets the end
            at = max(end[0], m.end()) if found else m.start() + 1
            if waited or only is not None:  # the newest window goes on from here
                source.look = begin + at
                return
        if source:
            source.look = max(source.look, begin + max(at, len(raw) - MAGIC))

    work: list = [iter([(text, None)])]
    while work:
        item = next(work[-1], None)
        if item is None:
            work.pop()
            continue
        layer, chain, *stream = item
        if layer is None:  # set aside until its source has another window
            chain.waiting = work.pop()
            continue
        if stream:
            source, begin = stream
            waiting, source.waiting = source.waiting, None
            key = layer and named(layer, f"bytes {begin}", chain, len(layer))
            if key and new(key):
                work.append(of_bytes(layer, chain, key, source, begin))
            elif key in waits and key not in source.path:
                work.append(packed(layer, chain, key[2], key, source, begin, waits[key]))
            if waiting is not None:
                work.append(waiting)
            continue
        if not layer:
            continue
        if isinstance(layer, bytes):
            key = named(layer, "bytes", chain, len(layer))
            if new(key):
                work.append(of_bytes(layer, chain, key))
            continue
        if not new(named(layer.encode("utf-8", "surrogatepass"), "text", chain, len(layer))):
            continue
        layers += 1
        if layers > 1:
            spans.update((kind, *_up(chain, s, e)) for kind, s, e in matches(layer))
        work.append(of_text(layer, chain))
    return base, sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])), layers, cut[0]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind, s, e in spans)


FINDINGS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long, n_layers long, n_cut_layers long"


def findings(text: Column, max_layer_bytes: int | None = None) -> Column:
    """Struct ``FINDINGS`` of a text column."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in FINDINGS.split(", ")]
        for texts in series:
            rows = []
            for t in texts:
                base, spans, layers, cut = scan(t if isinstance(t, str) else "", max_layer_bytes)
                kinds = [b[0] for b in base]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(),
                             _joined(spans), len(spans) - len(base), layers, cut))
            yield pd.DataFrame(rows, columns=names)

    return F.pandas_udf(tidied(run), FINDINGS)(text)


def redact(text: str, mask: str = MASK) -> str:
    """``text`` with every found span (overlaps joined) replaced by ``mask``."""
    out, at = [], 0
    for _, s, e in scan(text)[1]:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mask]
        at = e
    return "".join([*out, text[at:]]) if out else text


def redacted(text: Column, mask: str = MASK) -> Column:
    """The text column with secrets masked; null stays null."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            yield pd.Series([redact(t, mask) if isinstance(t, str) else None for t in texts], dtype=object)

    return F.pandas_udf(tidied(run), "string")(text)
