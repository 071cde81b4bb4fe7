"""Secrets in texts and in the layers encoded in them.

Fixed patterns give the base spans of the text itself. A worklist then unwraps layers: percent
escapes, Unicode and character escapes, base64, and compressed data (gzip, zlib). Layers are bytes; each
is scanned, tried for compressed data at every header in it (all members), and unwrapped again, until no
layer gives a new one; a layer that was seen before in a piece (by digest) is not unwrapped twice, so cycles
end. What is found in a layer is mapped to the span of the outermost encoded piece in the text.

Base64 is decoded at all four alignments, so what is glued to its front (a path, a name) hides nothing.
In the text, lines are joined where the line before is full, and tried alone too; in a layer, where
spans do not count, all adjacent lines are joined. Decoding and inflating go by ``WINDOW`` bytes, but a layer is
whole: beyond ``HELD`` bytes it is a temporary file, mapped into memory.

Defined cases: a null text is empty and has no spans; rows are independent, so repeated rows, ties and
extra columns have no effect; broken encodings are no layers.
"""

from __future__ import annotations

import binascii
import hashlib
import mmap
import re
import tempfile
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from termloom.llm.common import ship

ship(__name__)

KINDS = ("assign", "access", "hex")
WINDOW = 1 << 20
#: Layers of more bytes are kept in temporary files.
HELD = 1 << 24
#: The shortest secret has 12 bytes (token=abc123), 16 characters of base64.
SHORTEST = 16

Span = tuple[int, int, int]  # start, index of the kind, end
Layer = bytes | mmap.mmap


def _both(pattern: str) -> dict[bool, re.Pattern]:
    """The pattern for texts (True) and for layers (False)."""
    return {True: re.compile(pattern), False: re.compile(pattern.encode())}


_SIGN = _both(r"[:=]")
_NAME = _both(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])\Z"
)
_VALUE = _both(r"\x20*+[\"']?+([A-Za-z0-9+/_.=-]++)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_LONG_ACCESS = re.compile(rb"AKIA[A-Z0-9]{16}")
_HEX = _both(r"[0-9a-f]{24,}")
_PERCENT = re.compile(r"(?<![^\s%])[^\s%]*+(?:%[0-9A-Fa-f]{2}[^\s%]*+)+")
_CODES = r"\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#x[0-9A-Fa-f]{1,6};"
_NAMED = {b"amp": b"&", b"quot": b'"', b"apos": b"'", b"lt": b"<", b"gt": b">"}
_ESCAPE = re.compile(rf"(?<![^\s\\&])[^\s\\&]*+(?:(?:{_CODES})[^\s\\&]*+)+")
_HEX_PAIR = re.compile(rb"%([0-9A-Fa-f]{2})")
_CODE = re.compile(
    rb"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#x([0-9A-Fa-f]{1,6});|&(amp|quot|apos|lt|gt);"
)
_BASE64 = _both(r"[A-Za-z0-9+/_-]{16,}+(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)*+={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
_PLAIN = bytes.maketrans(b"-_", b"+/")
_PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")


def assignments(text: str | Layer) -> Iterator[tuple[int, int, int]]:
    """(start, end, length of the value): names that stand right before a sign, with a value after it."""
    is_text = isinstance(text, str)
    blank, quotes = (" ", "\"'") if is_text else (b" ", b"\"'")
    names, values = _NAME[is_text], _VALUE[is_text]
    after = 0
    for sign in _SIGN[is_text].finditer(text):
        end = sign.start()
        if end < after:
            continue
        while end > after and text[end - 1 : end] == blank:
            end -= 1
        if end > after and text[end - 1 : end] in quotes:
            end -= 1
        name = names.search(text, max(after, end - 8), end)
        if not name:
            continue
        value = values.match(text, sign.end())
        if value:
            yield name.start(), value.end(), value.end(1) - value.start(1)
            after = value.end()


def base_spans(text: str) -> list[Span]:
    found = [(s, 0, e) for s, e, n in assignments(text) if n >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX[True].finditer(text)]
    return sorted(found)


def base_kinds(layer: Layer) -> set[int]:
    """The kinds of the secrets in a layer."""
    found = {0} if any(n >= 6 for _, _, n in assignments(layer)) else set()
    if _LONG_ACCESS.search(layer):
        found.add(1)
    if _HEX[False].search(layer):
        found.add(2)
    return found


def _gathered(parts: Iterable[bytes]) -> Layer:
    """The parts as one layer, in a file if they are many; it goes with its last use."""
    held, size, file = [], 0, None
    for part in parts:
        held.append(part)
        size += len(part)
        if size > HELD:
            file = file or tempfile.TemporaryFile()
            file.writelines(held)
            held = []
    if file is None:
        return b"".join(held)
    file.writelines(held)
    file.flush()
    with file:
        return mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)


def _windows(data: Layer, start: int, end: int) -> Iterator[bytes]:
    for at in range(start, end, WINDOW):
        yield data[at : min(at + WINDOW, end)]


def _base64(parts: Iterable[bytes], skip: int) -> Iterator[bytes]:
    """What base64 holds from character ``skip`` on; a last character alone holds nothing."""
    rest = b""
    for part in parts:
        rest += part.translate(_PLAIN, b"\r\n\t =")
        if skip:
            skip, rest = max(0, skip - len(rest)), rest[skip:]
        whole = len(rest) // 4 * 4
        if whole:
            yield binascii.a2b_base64(rest[:whole])
        rest = rest[whole:]
    if len(rest) > 1:
        yield binascii.a2b_base64(rest + b"=" * (4 - len(rest)))


def _replaced(parts: Iterable[bytes], pattern: re.Pattern, longest: int, signs: bytes, plain: Callable) -> Iterator[bytes]:
    """The parts with each match replaced; an escape of up to ``longest`` bytes may cross them."""
    rest = b""
    for part in parts:
        rest += part
        cut = max(rest.rfind(bytes([x]), max(0, len(rest) - longest + 1)) for x in signs)
        cut = len(rest) if cut < 0 else cut
        yield pattern.sub(plain, rest[:cut])
        rest = rest[cut:]
    yield pattern.sub(plain, rest)


def _character(m: re.Match) -> bytes:
    if m[2]:
        return bytes.fromhex(m[2].decode())
    if m[5]:
        return _NAMED[m[5]]
    code = int(m[3]) if m[3] else int(m[1] or m[4], 16)
    return chr(code).encode("utf-8", "surrogatepass") if code < 0x110000 else b"?"


def _inflated(data: Layer, at: int, end: list[int]) -> Iterator[bytes]:
    """What the gzip or zlib data at ``at`` holds, adjacent members as one; ``end`` gets where the last whole one ends."""
    feed, pos = 1 << 12, at
    try:
        while True:
            stream = zlib.decompressobj(47)
            while not stream.eof:
                some = stream.unconsumed_tail
                if not some:
                    some = data[pos : pos + feed]
                    pos += len(some)
                    feed = min(feed * 2, WINDOW)
                if not some:
                    yield stream.flush()
                    return
                yield stream.decompress(some, WINDOW)
            pos -= len(stream.unused_data)
            end[0] = pos
            if data[pos : pos + 2] != b"\x1f\x8b":
                return
    except zlib.error:
        return


def _unpacked(data: Layer) -> Iterator[Layer]:
    """What compressed data anywhere in a layer holds."""
    at = 0
    if not (len(data) > 2 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0):
        m = _PACKED.search(data)
        at = m.start() if m else -1
    while at >= 0:
        end = [at + 1]
        layer = _gathered(_inflated(data, at, end))
        if len(layer):
            yield layer
        m = _PACKED.search(data, end[0])
        at = m.start() if m else -1


def _decoded(data: Layer, start: int, end: int, way: str) -> Iterator[Layer]:
    """The layers of an encoded piece."""
    if way == "percent":
        yield _gathered(_replaced(_windows(data, start, end), _HEX_PAIR, 3, b"%", lambda m: bytes.fromhex(m[1].decode())))
    elif way == "escape":
        yield _gathered(_replaced(_windows(data, start, end), _CODE, 10, b"\\&", _character))
    else:
        for skip in range(4):
            yield _gathered(_base64(_windows(data, start, end), skip))


def _pieces(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, way) of every encoded piece of a text."""
    if "%" in text:
        yield from ((m.start(), m.end(), "percent") for m in _PERCENT.finditer(text))
    if "\\" in text or "&#" in text:
        yield from ((m.start(), m.end(), "escape") for m in _ESCAPE.finditer(text))
    for m in _BASE64[True].finditer(text):
        yield from ((s, e, "base64") for s, e in _joined(text, m.start(), m.end()))


def _joined(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """The lines of a base64 run that can hold a secret, and groups in which each line but the last is full."""
    lines = [(m.start(), m.end()) for m in _LINE.finditer(text, start, end)]
    yield from ((s, e) for s, e in lines if e - s >= SHORTEST)
    first = 0
    for i, (s, e) in enumerate(lines):
        more = i + 1 < len(lines) and e - s >= SHORTEST
        if more and (i == first or lines[i + 1][1] - lines[i + 1][0] <= e - s):
            continue
        if i > first:
            yield lines[first][0], e
        first = i + 1


def _layers(data: Layer) -> Iterator[Layer]:
    """All layers of a layer: escapes are replaced in the whole of it, which is one pass at any length."""
    yield from _unpacked(data)
    for way, pattern in (("percent", _HEX_PAIR), ("escape", _CODE)):
        if pattern.search(data):
            yield from _decoded(data, 0, len(data), way)
    for m in _BASE64[False].finditer(data):
        yield from _decoded(data, m.start(), m.end(), "base64")


def hidden(piece: str, way: str) -> set[int]:
    """The kinds of the secrets in the layers of an encoded piece."""
    raw = piece.encode("utf-8", "surrogatepass")
    found, seen = set(), set()
    work = [_decoded(raw, 0, len(raw), way)]
    while work and len(found) < len(KINDS):
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        mark = hashlib.blake2b(layer, digest_size=16).digest()
        if mark not in seen:
            seen.add(mark)
            found |= base_kinds(layer)
            work.append(_layers(layer))
    return found


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, these and the spans of encoded secrets)."""
    base = base_spans(text)
    found = set(base)
    for start, end, way in _pieces(text):
        found.update((start, kind, end) for kind in hidden(text[start:end], way))
    return base, sorted(found)


def written(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


FOUND = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for value in batch.column(1):
            base, every = all_spans(value.as_py() or "")
            n = [sum(k == i for _, k, _ in base) for i in range(len(KINDS))]
            rows.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
        columns = list(zip(*rows)) or [()] * 5
        arrays = [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(c, pa.string()) for c in columns[3:]]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], FOUND)


def found(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the number of base spans by kind, their digest, and all spans."""
    fields = [docs.schema["doc_id"]]
    fields += [StructField(n, LongType()) for n in FOUND[1:4]] + [StructField(n, StringType()) for n in FOUND[4:]]
    return docs.select("doc_id", "text").mapInArrow(_scan, StructType(fields))
