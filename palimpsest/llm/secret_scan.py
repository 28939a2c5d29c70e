"""Secret scans: a worklist of layers that is unwrapped until nothing changes.

The text itself is the first layer and is scanned by the base patterns. Each
layer is then unwrapped by every decoder (URL escapes, Unicode escapes and
base64, also over several lines and at any place of a longer run, as all four
offsets are read). What a decoder gives is bytes: packed data among them (gzip,
zlib, raw deflate, bzip2, xz; all members, and packed data in packed data) is
unpacked, and of bytes that are no UTF-8 the readable parts are taken. Each
result that was not seen before becomes a layer of its own, is scanned in the
same way and unwrapped in turn, depth first. Layers already seen are not visited
again, which also ends cycles.

A layer holds its text and how it was made of the layer above; places are only
followed up to the original text for what is found, so a layer costs its text
and no more. Packed data is unpacked as a stream: what is larger than ``CHUNK``
is read in chunks of that size that overlap, so a small text that unpacks to
very much needs little memory and nothing is left out.

The least of 16 letters of base64 loses nothing: the shortest secret that a base
pattern finds, ``token=`` with six characters, has 12 bytes.

Cases: null texts count as empty; repeated rows give repeated rows; null ids
stay; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._common import binary_text, slices_by_bytes, utf8

KINDS = ("assign", "access", "hex")
CHUNK, OVERLAP, BLOCK = 4 << 20, 1 << 16, 1 << 20


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = re.compile(
    "(" + "|".join(_either_case(w) for w in KEYWORDS) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
UNICODE_ONE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
LETTERS = re.compile(r"[A-Za-z0-9+/_-]+")
MAGIC = rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|x[\x01\x5e\x9c\xda]|\xfd7zXZ\x00"
PACKED = re.compile(MAGIC)
READABLE = rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})"
# packed data, or what may be a text of the least length that is tried, in decoded bytes
PART = re.compile(rb"(?P<packed>" + MAGIC + rb")|" + READABLE + rb"{11,}")
STEMS = ("passw", "secret", "token", "api")
Span = tuple[int, int, int]  # start, place of the kind, end


def scan(text: str) -> list[Span]:
    """The base matches of one layer, in order of start and kind."""
    found: list[Span] = []
    low = text.lower()
    if any(x in low for x in STEMS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


Place = tuple[int, int]  # first place and the one after the last


class Piece:
    """What stands for a part [first, last) of a layer's text.

    ``locate`` gives, for a character of the piece, its place in that layer; without it all of it is from the whole part.
    """

    def __init__(self, text: str, first: int, last: int, locate: Callable[[int], Place] | None = None):
        self.text, self.first, self.last = text, first, last
        self.locate = locate or (lambda j: (first, last))


class Layer:
    """A text made of the layer above, with some parts replaced by pieces; without pieces it is the original."""

    def __init__(self, text: str, above: Layer | None = None, pieces: list[Piece] = ()):
        self.text, self.above, self.pieces = text, above, pieces
        self.starts: list[int] = []  # of the pieces, in this text
        grown = 0
        for p in pieces:
            self.starts.append(p.first + grown)
            grown += len(p.text) - (p.last - p.first)

    def alone(self) -> Layer:
        """This layer as one that is nothing but its piece."""
        self.starts = [0]
        return self

    @staticmethod
    def of(above: Layer, pieces: list[Piece]) -> Layer:
        out, at = [], 0
        for p in pieces:
            out += [above.text[at : p.first], p.text]
            at = p.last
        return Layer("".join([*out, above.text[at:]]), above, pieces)

    def _up(self, i: int) -> Place:
        k = bisect_right(self.starts, i) - 1
        if k < 0:
            return i, i + 1
        inside = i - self.starts[k]
        piece = self.pieces[k]
        if inside < len(piece.text):
            return piece.locate(inside)
        beyond = piece.last + inside - len(piece.text)
        return beyond, beyond + 1

    def place(self, first: int, last: int) -> Place:
        """Where [first, last) of this layer is in the original text."""
        layer = self
        while layer.above is not None:
            first, last = layer._up(first)[0], layer._up(last - 1)[1]
            layer = layer.above
        return first, last


def _worker(start: bytes):
    if start[:2] == b"\x1f\x8b" or start[:1] == b"\x78":
        return zlib.decompressobj(47)
    return bz2.BZ2Decompressor() if start[:3] == b"BZh" else lzma.LZMADecompressor()


class Unpacked:
    """The blocks that packed data unpacks to, member after member; ``used`` is the length of what was packed.

    ``whole`` says whether the last member came to its end.
    """

    def __init__(self, blocks: Iterator[bytes], raw: bool = False):
        self.blocks, self.raw, self.used, self.whole = blocks, raw, 0, False

    def __iter__(self) -> Iterator[bytes]:
        rest = b""
        while True:
            while len(rest) < 10 and (more := next(self.blocks, None)) is not None:
                rest += more
            if not (self.raw and not self.used) and not PACKED.match(rest):
                return
            worker, self.whole = zlib.decompressobj(-15) if self.raw else _worker(rest), False
            while not worker.eof:
                try:
                    if isinstance(worker, (bz2.BZ2Decompressor, lzma.LZMADecompressor)):
                        out = worker.decompress(rest, BLOCK)
                        self.used += len(rest)
                        rest = b""
                        hungry = worker.needs_input
                    else:
                        out = worker.decompress(rest, BLOCK)
                        self.used += len(rest) - len(worker.unconsumed_tail)
                        rest = worker.unconsumed_tail
                        hungry = not rest
                except (zlib.error, lzma.LZMAError, OSError, EOFError, ValueError):
                    return
                if out:
                    yield out
                if hungry and not worker.eof and not rest:
                    if (more := next(self.blocks, None)) is None:
                        return
                    rest = more
            self.used -= len(worker.unused_data)
            self.whole = True
            rest = worker.unused_data
            if self.raw:
                return


def unpacked_texts(data: bytes, raw: bool = False, around: frozenset[bytes] = frozenset()) -> tuple[Iterator[str], Unpacked] | None:
    """The texts, in chunks, that packed data at the start of ``data`` holds below all its packings.

    None if it is no such data, or the same as what is ``around`` it.
    """
    if data[:BLOCK] in around:
        return None
    outer = Unpacked(iter([data]), raw)
    blocks = iter(outer)
    first = next(blocks, None)
    if first is None or raw and not (outer.used and _readable(first[: 1 << 12].decode("utf-8", "replace"))):
        return None
    seen = {*around, data[:BLOCK]}
    while PACKED.match(first) and first not in seen:  # packed data in packed data, but not itself
        seen.add(first)
        inner = iter(Unpacked(chain([first], blocks)))
        if (below := next(inner, None)) is None:
            break
        first, blocks = below, inner
    return _texts_of(chain([first], blocks), frozenset(seen)), outer


def _texts_of(blocks: Iterator[bytes], around: frozenset[bytes]) -> Iterator[str]:
    """Chunks of a stream of bytes as texts; of what is no text the readable parts, packed ones among them unpacked."""
    held, more = [], True
    while more:
        size = sum(map(len, held))
        more = False
        for block in blocks:
            held.append(block)
            size += len(block)
            if size >= CHUNK:
                more = True
                break
        data = b"".join(held)
        held = [data[-OVERLAP:]]
        if data:
            yield from _readable_texts(data, around)


def _readable_texts(data: bytes, around: frozenset[bytes]) -> Iterator[str]:
    text = data.decode("utf-8", "replace")
    if _readable(text):
        yield text
        return
    parts, done = [], 0
    for m in PART.finditer(data):
        if m.start() < done:
            continue
        if m["packed"] is None:
            parts.append(m[0].decode("utf-8", "replace"))
        elif (found := unpacked_texts(data[m.start() :], False, around)) is not None:
            for text in found[0]:
                if _readable(text):
                    yield text
            done = m.start() + found[1].used if found[1].whole else m.start() + 1
    if parts:
        yield "\n".join(parts)


def _readable(text: str) -> bool:
    good = sum(map(str.isprintable, text)) + sum(map(text.count, "\t\r\n")) - text.count("\ufffd")
    return bool(text) and good >= 0.95 * len(text)


class Decoded:
    """Bytes that a decoder made of a part of a layer, with the place of each byte in the layer."""

    def __init__(self, data: bytes, spot: Callable[[int], Place]):
        self.data, self.spot = data, spot

    def piece(self, a: int, b: int) -> Piece:
        """Bytes [a, b) as a text; bytes that are no UTF-8 become U+FFFD."""
        data = self.data[a:b]
        raw = data.decode("utf-8", "surrogateescape")
        if len(raw) == len(data):
            return Piece(_shown(raw), self.spot(a)[0], self.spot(b - 1)[1], lambda j: self.spot(a + j))

        def locate(j: int) -> Place:
            first = a + len(raw[:j].encode("utf-8", "surrogateescape"))
            return self.spot(first)[0], self.spot(first + len(raw[j].encode("utf-8", "surrogateescape")) - 1)[1]

        return Piece(_shown(raw), self.spot(a)[0], self.spot(b - 1)[1], locate)

    def parts(self, sure: bool) -> Iterator[Piece | tuple[Piece, Iterator[str]]]:
        """Pieces in order; a packed part that is larger than a chunk comes with its texts, as no piece can hold it.

        If ``sure``, all bytes between packed parts are text; else readable ones are.
        """
        data, done = self.data, 0
        if not sure and not PACKED.search(data) and (raw := unpacked_texts(data, True)) is not None and len(data) >= 12:
            texts, told = raw
            packed = self._packed(0, len(data), texts, told)
            if packed is not None and told.whole:
                yield packed
                return
        for m in PACKED.finditer(data) if sure else PART.finditer(data):
            if m.start() < done:
                continue
            if not sure and m["packed"] is None:
                yield self.piece(*m.span())
                done = m.end()
                continue
            found = unpacked_texts(data[m.start() :])
            packed = None if found is None else self._packed(m.start(), len(data), *found)
            if packed is None:
                continue
            if sure and m.start() > done:
                yield self.piece(done, m.start())
            yield packed
            done = m.start() + found[1].used if found[1].whole else len(data)
        if sure and done < len(data):
            yield self.piece(done, len(data))

    def _packed(self, a: int, end: int, texts: Iterator[str], told: Unpacked) -> Piece | tuple[Piece, Iterator[str]] | None:
        first = next(texts, None)
        if first is None or not _readable(first):
            return None
        second = next(texts, None)
        b = a + told.used if told.whole else end
        piece = Piece(first, self.spot(a)[0], self.spot(min(b, end) - 1)[1])
        return piece if second is None else (piece, chain([first, second], texts))


def _shown(text: str) -> str:
    return text if text.isascii() else "".join("\ufffd" if "\udc80" <= c <= "\udcff" else c for c in text)


def _url(m: re.Match) -> Iterator:
    start = m.start()
    yield from Decoded(bytes.fromhex(m[0].replace("%", "")), lambda k: (start + 3 * k, start + 3 * k + 3)).parts(True)


def _characters(m: re.Match) -> Iterator[tuple[str, int, int]]:
    """The characters of Unicode escapes with their places, halves of one joined."""
    held = None
    for one in UNICODE_ONE.finditer(m[0]):
        code = int(next(x for x in one.groups() if x is not None), 16)
        a, b = m.start() + one.start(), m.start() + one.end()
        if held and 0xDC00 <= code <= 0xDFFF and 0xD800 <= ord(held[0]) <= 0xDBFF:
            held = chr(0x10000 + ((ord(held[0]) - 0xD800) << 10) + code - 0xDC00), held[1], b
            continue
        if held:
            yield held
        held = chr(code if code <= 0x10FFFF else 0xFFFD), a, b
    if held:
        yield held


def _unicode(m: re.Match) -> Iterator:
    text = "".join(c for c, _, _ in _characters(m))
    if max(text) <= "\xff" and PACKED.search(data := text.encode("latin-1")):  # codes below 256 may be bytes
        spots = [(a, b) for _, a, b in _characters(m)]
        if any(unpacked_texts(data[x.start() :]) for x in PACKED.finditer(data)):
            yield from Decoded(data, spots.__getitem__).parts(True)
            return
    yield Piece(text.encode("utf-8", "replace").decode(), m.start(), m.end(), lambda j: next(x for k, x in enumerate(_characters(m)) if k == j)[1:])


def _base64_bytes(letters: str) -> bytes:
    body = letters.replace("-", "+").replace("_", "/")
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _letters(letters: str, at: Callable[[int], int], offset: int) -> Iterator:
    """What base64 letters hold: all of them as one text, or else parts of them, read from an offset on."""

    def spot(start: int) -> Callable[[int], Place]:
        return lambda k: (at(start + k * 8 // 6), at(start + ((k + 1) * 8 + 5) // 6 - 1) + 1)

    if len(letters) % 4 != 1:
        data = _base64_bytes(letters)
        text = data.decode("utf-8", "replace")
        if "\ufffd" not in text and _readable(text):
            if not offset:
                piece = Decoded(data, spot(0)).piece(0, len(data))
                piece.first, piece.last = at(0), at(len(letters) - 1) + 1
                yield piece
            return
    yield from Decoded(_base64_bytes(letters[offset:]), spot(offset)).parts(False)


def _base64(m: re.Match, offset: int) -> Iterator:
    start = m.start()
    yield from _letters(m[0].rstrip("="), lambda k: start + k, offset)


def _wrapped(m: re.Match, offset: int) -> Iterator:
    lines = [(x.start() + m.start(), x[0]) for x in LETTERS.finditer(m[0])]
    ends = [0]
    for _, line in lines:
        ends.append(ends[-1] + len(line))

    def at(k: int) -> int:
        n = min(bisect_right(ends, k) - 1, len(lines) - 1)
        return lines[n][0] + k - ends[n]

    yield from _letters("".join(line for _, line in lines), at, offset)


#: what must be in a layer before a decoder looks at it, its pattern, and its functions, each of which makes a layer
DECODERS = (
    ("%", URL, (_url,)),
    ("\\", UNICODE, (_unicode,)),
    ("", BASE64, tuple(lambda m, k=k: _base64(m, k) for k in range(4))),
    ("\n", WRAPPED, tuple(lambda m, k=k: _wrapped(m, k) for k in range(4))),
)


def unwrap(layer: Layer) -> Iterator[Layer]:
    """The layers that one step of each decoder makes of a layer."""
    for mark, pattern, decoders in DECODERS:
        if mark not in layer.text:
            continue
        matches = list(pattern.finditer(layer.text))
        for decode in decoders if matches else ():
            pieces: list[Piece] = []
            for m in matches:
                for part in decode(m):
                    if isinstance(part, Piece):
                        pieces.append(part)
                        continue
                    whole, texts = part
                    for text in texts:
                        yield Layer(text, layer, [Piece(text, whole.first, whole.last)]).alone()
            if pieces:
                yield Layer.of(layer, pieces)


def find_secrets(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans: those and what the layers below hold."""
    base = scan(text)
    spans, seen = set(base), set()
    work = [unwrap(Layer(text))]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        told = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if told in seen or layer.text == text:
            continue
        seen.add(told)
        for a, kind, b in scan(layer.text):
            first, last = layer.place(a, b)
            spans.add((first, kind, last))
        work.append(unwrap(layer))
    return base, sorted(spans)


def redact(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """The text with every span, overlapping ones as one, replaced by a mark."""
    out, at = [], 0
    for start, _, end in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 22) -> DataFrame:
    """Return id, base spans, all spans (kind:start:end), counts by kind and the redacted text."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices_by_bytes(whole, "text", batch_bytes):
                counts: list[list[int]] = [[], [], []]
                digests, every, clean = [], [], []
                for raw in batch.column("text").to_pylist():
                    text = utf8(raw)
                    base, spans = find_secrets(text)
                    for kind in range(3):
                        counts[kind].append(sum(x[1] == kind for x in base))
                    digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    every.append(joined(spans))
                    clean.append(redact(text, spans))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        *(pa.array(x, pa.int64()) for x in counts),
                        *(pa.array(x, pa.string()) for x in (digests, every, clean)),
                    ],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "clean_text"],
                )

    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    return (
        docs.select(F.col(id_col).alias("doc_id"), binary_text(F.col(text_col)).alias("text"))
        .mapInArrow(work, f"doc_id {id_type}, {kinds}, base_sha256 string, spans string, clean_text string")
        .withColumnRenamed("doc_id", id_col)
    )


def redact_secrets(docs: DataFrame, text_col: str = "text", batch_bytes: int = 1 << 22) -> DataFrame:
    """All rows and columns with every secret in the text, encoded ones included, replaced by a mark; null texts stay null."""
    columns = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices_by_bytes(whole, text_col, batch_bytes):
                texts = batch.column(text_col).to_pylist()
                clean = pa.array([None if t is None else redact(t, find_secrets(t)[1]) for t in texts], pa.string())
                held = [clean if c == text_col else batch.column(k) for k, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays(held, names=columns)

    return docs.mapInArrow(work, docs.schema)
