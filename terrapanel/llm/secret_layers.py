"""Secret scans through nested encodings, by a recursive decoding worklist.

Method: the text is the first layer of a worklist.  Each layer is searched for
secrets, then unwrapped in every way that applies: percent escapes, Unicode
escapes and character references, base64 runs, and compressed data inside them.
What comes out is a new layer, searched and unwrapped in its turn, until no new
layer is left.  A layer already seen at the same place (same content, same span
of the text) is not taken again, so contents that decode to themselves or to one
another end.  Every layer can map its spans to the layer it came from: an
escape's character to the escape, a byte of base64 to the characters that hold
its bits, anything compressed to the whole run; a find is reported at its span
of the original text.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kinds in their order, their patterns, and the least length of a match (assign: of its value).
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are whole: a shorter one can't hold a longer
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|(?:\\u|%u)([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
#: The shortest assignment with a value of six has 12 bytes, 16 characters of base64.
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
WRAPPED = re.compile(r"(?:[A-Za-z0-9+/]{76}\r?\n)+[A-Za-z0-9+/]{1,76}|(?:[A-Za-z0-9+/]{64}\r?\n)+[A-Za-z0-9+/]{1,64}")
#: Bytes that one layer, and all layers of one text, may unpack to; data that unpacks to more is counted as unread.
LAYER_BYTES, TEXT_BYTES = 1 << 26, 1 << 28

Span = tuple[int, int]


def find(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of every secret in one layer, leftmost first and without overlap within a kind."""
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_LEAST:
                yield 0, *m.span()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS_LEAST:
                yield 1, *m.span()
    for m in HEX.finditer(text):
        yield 2, *m.span()


class Pieces:
    """Text put together from copied stretches and decoded characters, with the way back."""

    def __init__(self, source: str):
        self.source, self.out, self.size, self.at = source, [], 0, 0
        self.starts: list[int] = []
        self.origins: list[tuple[int, int, bool]] = []

    def _add(self, text: str, start: int, end: int, copied: bool) -> None:
        if text:
            self.starts.append(self.size)
            self.origins.append((start, end, copied))
            self.out.append(text)
            self.size += len(text)
        self.at = end

    def copy_to(self, end: int) -> None:
        self._add(self.source[self.at:end], self.at, end, True)

    def put(self, char: str, start: int, end: int) -> None:
        self._add(char, start, end, False)

    def done(self) -> tuple[str, Callable[[int, int], Span]]:
        self.copy_to(len(self.source))

        def back(a: int, b: int) -> Span:
            i, j = bisect_right(self.starts, a) - 1, bisect_right(self.starts, b - 1) - 1
            (s, _, copied), (f, e, ends_copied) = self.origins[i], self.origins[j]
            return (s + a - self.starts[i] if copied else s), (f + b - self.starts[j] if ends_copied else e)

        return "".join(self.out), back


def percent(text: str) -> tuple[str, Callable[[int, int], Span]] | None:
    """Percent escapes decoded: whole UTF-8 characters, or single ASCII bytes where a run isn't UTF-8."""
    if "%" not in text:
        return None
    p, changed = Pieces(text), False
    for m in PERCENT.finditer(text):
        raw, at = bytes.fromhex(m[0].replace("%", "")), m.start()
        try:
            chars = [(c, len(c.encode())) for c in raw.decode()]
        except UnicodeDecodeError:
            chars = [(chr(x) if x < 128 else "", 1) for x in raw]
        for c, n in chars:
            if c:
                p.copy_to(at)
                p.put(c, at, at + 3 * n)
                changed = True
            at += 3 * n
    return p.done() if changed else None


def escapes(text: str) -> tuple[str, Callable[[int, int], Span]] | None:
    r"""Unicode escapes (``\u``, ``\U``, ``\x``, ``%u``) and numeric character references decoded; pairs of surrogates are one character."""
    if "\\" not in text and "&#" not in text and "%u" not in text:
        return None
    p, changed, held = Pieces(text), False, None
    for m in ESCAPE.finditer(text):
        group = m.lastindex
        point = int(m[group], 10 if group == 5 else 16)
        if 0xD800 <= point < 0xDC00:
            held = (point, m.start(), m.end())
            continue
        start = m.start()
        if 0xDC00 <= point < 0xE000:
            if held is None or held[2] != start:
                continue
            point, start = 0x10000 + ((held[0] - 0xD800) << 10) + point - 0xDC00, held[1]
        if point <= 0x10FFFF:
            p.copy_to(start)
            p.put(chr(point), start, m.end())
            changed = True
    return p.done() if changed else None


def unpack(raw: bytes, budget: int) -> bytes | None:
    """The content of compressed data (gzip, zlib, bzip2, xz); None if it is none or broken.  Raises OverflowError beyond ``budget`` bytes."""
    if raw[:2] == b"\x1f\x8b":
        make = lambda: zlib.decompressobj(31)
    elif len(raw) > 2 and raw[0] & 15 == 8 and (raw[0] << 8 | raw[1]) % 31 == 0:
        make = lambda: zlib.decompressobj(15)
    elif raw[:3] == b"BZh":
        make = bz2.BZ2Decompressor
    elif raw[:6] == b"\xfd7zXZ\x00":
        make = lambda: lzma.LZMADecompressor(memlimit=LAYER_BYTES)
    else:
        return None
    out, rest, size = [], raw, 0
    try:
        while rest:  # members may follow one another
            d = make()
            part = d.decompress(rest, max(budget - size, 0) + 1)
            size += len(part)
            if size > budget:
                raise OverflowError
            if not d.eof:
                return None
            out.append(part)
            rest = d.unused_data
    except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
        return b"".join(out) or None
    return b"".join(out)


def readable(raw: bytes) -> str | None:
    """Bytes as text, if they are UTF-8 without control characters other than tab and line ends."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return None if not text or re.search(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", text) else text


def _decoded(body: str) -> bytes | None:
    body = body.translate({45: 43, 95: 47})
    try:
        return base64.b64decode(body[:len(body) - (len(body) % 4 == 1)] + "=" * (-len(body) % 4 if len(body) % 4 != 1 else 0))
    except (binascii.Error, ValueError):
        return None


def runs(text: str) -> Iterator[tuple[str, int, Callable[[int, int], Span]]]:
    """(base64 characters, start, way back from positions in them) of all candidate runs, whole ones first, then their parts at separators."""
    for m in RUN.finditer(text):
        yield m[0], m.start(), lambda a, b, s=m.start(): (s + a, s + b)
        if re.search(r"[/+_-]", m[0]):
            at = 0
            for part in re.split(r"([/+_-])", m[0]):
                if len(part) >= 16:
                    yield part, m.start() + at, lambda a, b, s=m.start() + at: (s + a, s + b)
                at += len(part)
    for m in WRAPPED.finditer(text):
        line = m[0].index("\n") + 1
        held = len(m[0][:line].rstrip("\r\n"))
        place = lambda x, s, n, k: s + x // n * k + x % n
        yield (m[0].replace("\r", "").replace("\n", ""), m.start(),
               lambda a, b, s=m.start(), n=held, k=line: (place(a, s, n, k), place(b - 1, s, n, k) + 1))


def scan_text(text: str) -> tuple[list[tuple[int, int, int]], dict[tuple[int, int, int], str], int]:
    """(base finds, all finds with the layers that led to each, layers too large to read) of one text."""
    base = list(find(text))
    found: dict[tuple[int, int, int], str] = {}
    whole = lambda a, b: (a, b)
    work: deque[tuple[str, Callable[[int, int], Span], str]] = deque([(text, whole, "")])
    seen: set[tuple[bytes, Span]] = set()
    unread, left = 0, TEXT_BYTES

    def push(content: str, up: Callable[[int, int], Span], back: Callable[[int, int], Span], way: str, name: str) -> None:
        span = up(*back(0, len(content)))
        mark = (hashlib.blake2b(content.encode("utf-8", "surrogatepass"), digest_size=16).digest(), span)
        if mark not in seen:
            seen.add(mark)
            work.append((content, lambda a, b: up(*back(a, b)), f"{way}>{name}" if way else name))

    while work:
        layer, up, way = work.popleft()
        for kind, a, b in base if not way else find(layer):
            found.setdefault((*up(a, b), kind), way)
        for name, decode in (("url", percent), ("unicode", escapes)):
            if (got := decode(layer)) is not None and got[0]:
                push(got[0], up, got[1], way, name)
        for body, _, place in runs(layer):
            if (raw := _decoded(body)) is None:
                continue
            plain = readable(raw)
            if plain is not None:
                def bits(a: int, b: int, plain=plain, place=place, body=body, ascii=plain.isascii()) -> Span:
                    x, y = (a, b) if ascii else (len(plain[:a].encode()), len(plain[:b].encode()))
                    return place(x * 8 // 6, min(-(-y * 8 // 6), len(body)))
                push(plain, up, bits, way, "base64")
                continue
            content, names = raw, "base64"
            try:
                while content is not None and plain is None:
                    content = unpack(content, min(left, LAYER_BYTES))
                    if content is not None:
                        left -= len(content)
                        names += ">unpack"
                        plain = readable(content)
                        mark = (hashlib.blake2b(content, digest_size=16).digest(), up(*place(0, len(body))))
                        if plain is None and mark in seen:
                            break
                        if plain is None:
                            seen.add(mark)
            except OverflowError:
                unread += 1
            if plain:
                push(plain, up, lambda a, b, place=place, n=len(body): place(0, n), way, names)
    return base, found, unread


FIND = "array<struct<kind:string,start:long,end:long>>"
SCHEMA = f"{{id}} {{type}}, base {FIND}, spans array<struct<kind:string,start:long,end:long,layers:string>>, unread long"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in every whole text, in plain sight and under encodings.

    Returns (id, ``base``: finds in the text as it stands, ``spans``: all finds
    with the layers that led to each, empty for the text itself, ``unread``:
    layers that unpack to more than ``LAYER_BYTES``, or beyond ``TEXT_BYTES`` of
    one text, and were left).  Spans count code points, ends are exclusive; both
    lists go by start, then kind as in ``KINDS``, then end.

    Edge cases: a null text is empty, and has no finds; null and repeated ids keep
    a row each.  Finds of several layers at one span are one, with the layers
    found first.  A text is one task's work whatever its length.  An empty table
    gives no rows; other columns are ignored.
    """
    id_type = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                base, spans, unread = [], [], []
                for text in part.column("text"):
                    own, found, skipped = scan_text(text.as_py() or "")
                    base.append([{"kind": KINDS[k], "start": a, "end": e} for a, k, e in sorted((a, k, e) for k, a, e in own)])
                    spans.append([{"kind": KINDS[k], "start": a, "end": e, "layers": found[a, e, k]} for a, k, e in sorted((a, k, e) for a, e, k in found)])
                    unread.append(skipped)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(base, pa.list_(pa.struct(span))), pa.array(spans, pa.list_(pa.struct([*span, ("layers", pa.string())]))),
                     pa.array(unread, pa.int64())], ["id", "base", "spans", "unread"])

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, SCHEMA.format(id="id", type=id_type.simpleString()))
    return out.withColumnRenamed("id", id_col)
