"""Secret scans with a recursive decoding worklist.

A text is scanned as it stands. Then every stretch that looks encoded (URL escapes, Unicode escapes,
base64, and the gzip or zlib streams that stand anywhere in their bytes) is unwrapped into a layer;
layers are scanned and searched for further encoded stretches until none is left. Base64 is read from
each of four alignments, so it may follow other letters of its alphabet, and over wrapped lines. Bytes
of a layer need not be UTF-8. A layer seen before is not taken again, so cycles end. Each character
of a layer carries the place in the text that it came from, so finds in any layer are spans of the
text, in code points. Layers are taken depth first, so that few of them are held at once.

Edge cases: a null or empty text has no finds; equal finds of several layers are one; finds that tie
in start are ordered by kind, then by end; repeated rows are scanned each; an empty table gives no
rows; other columns are carried along or ignored. Texts are scanned whole, whatever their length: a
stretch is found in time in proportion to it. What a compressed stretch expands to flows through in
pieces of about PIECE bytes, which are cut only where no find and no encoded stretch can lie across
(see CUT); streams inside it are expanded as it flows. A run without any such place is held whole.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The kinds in their order, and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6
CUES = ("passw", "secret", "token", "api")

# Stretches begin at a fixed character or at the start of a run, so that a search takes linear time.
RUN = re.compile(r"\S+")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+[\x20\t]*+\r?\n[\x20\t]*+)++[A-Za-z0-9+/_-]*+={0,2}")
STREAM = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
_URL_PART = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE_PART = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
#: Bytes of an expanded stream that are scanned at once, about, and that are expanded at once.
PIECE, CHUNK = 4 << 20, 1 << 18
#: Compressed bytes that tell a stream from those it lies in.
HEAD = 4096
#: Where a piece may end: after a character that no pattern takes, before white space; or after a short word between blanks.
CUT = re.compile(
    rb"""[^A-Za-z0-9+/_=\-%\\"':\s](?=\s)|(?<=\x20)[A-Za-z]{1,15}(?<!password)(?<!passwd)(?<!secret)(?<!token)(?<!apikey)(?=\x20)""",
    re.IGNORECASE,
)
_HEX_VALUE = np.full(1 << 7, -1)
_HEX_VALUE[list(b"0123456789")], _HEX_VALUE[list(b"abcdef")], _HEX_VALUE[list(b"ABCDEF")] = range(10), range(10, 16), range(10, 16)


@dataclass(frozen=True)
class Layer:
    """Decoded text; start and stop: where in the original each character comes from."""

    text: str
    start: np.ndarray
    stop: np.ndarray


def finds(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, stop) of one layer, leftmost and non-overlapping in each kind."""
    out = []
    low = text.lower()
    if any(c in low for c in CUES):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def _spread(data: bytes, start: np.ndarray, stop: np.ndarray) -> Layer:
    """Bytes as a layer, one character to a byte: patterns take ASCII alone, which every encoding of text spells alike."""
    return Layer(data.decode("latin-1"), start, stop)


def _spelled_out(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of text, and the character that each belongs to."""
    try:
        data = np.frombuffer(text.encode("latin-1"), np.uint8)
        return data, np.arange(len(data))
    except UnicodeEncodeError:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        return data, np.cumsum((data & 0xC0) != 0x80) - 1


def _inflated(data: bytes, at: int) -> tuple[int, bool]:
    """Where the gzip or zlib stream at `at` ends, and whether it gives any byte."""
    stream, gave, view = zlib.decompressobj(47), False, memoryview(data)
    try:
        while at < len(data) and not stream.eof:
            fed = view[at : at + CHUNK]
            at += len(fed)
            gave = len(stream.decompress(fed, CHUNK)) > 0 or gave
            while stream.unconsumed_tail:
                gave = len(stream.decompress(stream.unconsumed_tail, CHUNK)) > 0 or gave
    except zlib.error:
        pass
    return at - len(stream.unused_data) if stream.eof else len(data), gave


def _streams(data: bytes, start: np.ndarray, stop: np.ndarray) -> Iterator[Layer]:
    """What the gzip and zlib streams in data hold, each with the place of its own bytes; streams in streams too."""
    at, view = 0, memoryview(data)
    while (m := STREAM.search(data, at)) is not None:
        # A stream that ends is passed over; one that does not may begin at any byte.
        end, gave = _inflated(data, m.start())
        if gave:
            one = _Stream(int(start[m.start()]), int(stop[end - 1]), frozenset())
            for k in range(m.start(), end, CHUNK):
                if one.done:
                    break
                yield from one.feed(bytes(view[k : min(k + CHUNK, end)]))
            yield from one.finish()
        at = end if gave and end < len(data) else m.start() + 1


class _Stream:
    """A gzip or zlib stream that arrives in parts; gives the layers of what it holds. above: the streams it lies in."""

    def __init__(self, start: int, stop: int, above: frozenset) -> None:
        self.place, self.above, self.head, self.done = (start, stop), above, b"", False
        self.inflate, self.inside = None, None

    def feed(self, part: bytes) -> Iterator[Layer]:
        if self.inflate is None:
            self.head += part
            if len(self.head) < HEAD:
                return
            part = self._begin()
        yield from self._expand(part)

    def _begin(self) -> bytes:
        name = hashlib.blake2b(self.head[:HEAD], digest_size=16).digest()
        self.inflate, self.done = zlib.decompressobj(47), name in self.above
        self.inside = _Inside(*self.place, self.above | {name})
        return self.head

    def _expand(self, part: bytes) -> Iterator[Layer]:
        while part and not self.done:
            try:
                plain = self.inflate.decompress(part, CHUNK)
            except zlib.error:
                self.done = True
                break
            part = self.inflate.unconsumed_tail
            if plain:
                yield from self.inside.feed(plain)
            self.done = self.inflate.eof
        if self.done:
            yield from self.inside.finish()

    def finish(self) -> Iterator[Layer]:
        if self.inflate is None:
            yield from self._expand(self._begin())
        if not self.done:
            self.done = True
            yield from self.inside.finish()


class _Inside:
    """Bytes that arrive in parts: their text in pieces, and the streams among them."""

    def __init__(self, start: int, stop: int, above: frozenset) -> None:
        self.place, self.above = (start, stop), above
        self.text, self.tail, self.open, self.most = bytearray(), b"", [], PIECE

    def feed(self, part: bytes) -> Iterator[Layer]:
        for stream in self.open:
            yield from stream.feed(part)
        around = self.tail + part
        for m in STREAM.finditer(around):
            if m.end() > len(self.tail):
                stream = _Stream(*self.place, self.above)
                yield from stream.feed(around[m.start() :])
                self.open.append(stream)
        self.open = [x for x in self.open if not x.done]
        self.tail = around[-2:]
        self.text += part
        if len(self.text) >= self.most:
            cut = max((m.end() for m in CUT.finditer(self.text)), default=0)
            # Without a place to cut, the next search waits until the run has doubled.
            self.most = max(PIECE, 2 * (len(self.text) - cut))
            if cut:
                yield self._layer(bytes(self.text[:cut]))
                del self.text[:cut]

    def _layer(self, data: bytes) -> Layer:
        n = len(data)
        return _spread(data, np.broadcast_to(self.place[0], n), np.broadcast_to(self.place[1], n))

    def finish(self) -> Iterator[Layer]:
        if self.text:
            yield self._layer(bytes(self.text))
            self.text = bytearray()
        for stream in self.open:
            yield from stream.finish()
        self.open = []


def _digits(points: np.ndarray, ahead: int) -> np.ndarray:
    """The value of the hex digit so many places after each point; negative if there is none."""
    out = np.full(len(points), -1)
    there = points[ahead:]
    out[: len(there)] = np.where(there < 128, _HEX_VALUE[np.minimum(there, 127)], -1)
    return out


def _from_url(piece: Layer) -> Iterator[Layer]:
    data, char = _spelled_out(piece.text)
    high, low = _digits(data, 1), _digits(data, 2)
    at = np.flatnonzero((data == 37) & (high >= 0) & (low >= 0))
    stays, value, last = np.ones(len(data), bool), data.copy(), char.copy()
    stays[at + 1] = stays[at + 2] = False
    value[at], last[at] = high[at] * 16 + low[at], char[at + 2]
    plain, start, stop = value[stays].tobytes(), piece.start[char[stays]], piece.stop[last[stays]]
    yield _spread(plain, start, stop)
    yield from _streams(plain, start, stop)


def _from_escapes(piece: Layer) -> Iterator[Layer]:
    point = np.frombuffer(piece.text.encode("utf-32-le", "surrogatepass"), "<u4")
    digit = [_digits(point, k) for k in range(2, 6)]
    mark = np.concatenate([point[1:], [0]])
    short = (point == 92) & (mark == ord("x")) & (digit[0] >= 0) & (digit[1] >= 0)
    long = (point == 92) & (mark == ord("u")) & np.logical_and.reduce([d >= 0 for d in digit])
    stays, value, last = np.ones(len(point), bool), point.copy(), np.arange(len(point))
    for which, n in ((np.flatnonzero(short), 2), (np.flatnonzero(long), 4)):
        value[which] = sum(d[which] << (4 * (n - 1 - k)) for k, d in enumerate(digit[:n]))
        last[which] += n + 1
        for k in range(1, n + 2):
            stays[which + k] = False
    text, start, stop = value[stays].tobytes().decode("utf-32-le", "surrogatepass"), piece.start[stays], piece.stop[last[stays]]
    # Escapes may spell bytes, one to a character.
    yield from _streams(text.encode("latin-1", "replace"), start, stop)
    yield Layer(text, start, stop)


def _from_base64(piece: Layer) -> Iterator[Layer]:
    """The layers of a run by alignment: what stands before the encoded part only decodes to noise before it."""
    whole = piece.text.rstrip("=").replace("-", "+").replace("_", "/")
    for skip in range(4):
        body = whole[skip:]
        if len(body) % 4 == 1:
            body = body[:-1]
        try:
            data = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
        except (binascii.Error, ValueError):
            continue
        if not data:
            continue
        k = np.arange(len(data))
        start, stop = piece.start[skip + k * 4 // 3], piece.stop[skip + np.minimum((4 * k + 6) // 3, len(body)) - 1]
        yield _spread(data, start, stop)
        # Padding belongs to a stream that ends the run.
        yield from _streams(data, start, np.concatenate([stop[:-1], piece.stop[-1:]]))


def _from_wrapped(piece: Layer) -> Iterator[Layer]:
    inside = np.array([not c.isspace() for c in piece.text])
    yield from _from_base64(Layer("".join(piece.text.split()), piece.start[inside], piece.stop[inside]))


def _inner(layer: Layer) -> Iterator[Layer]:
    """What the encoded stretches of a layer hold."""
    text = layer.text
    kinds = [(BASE64, None, _from_base64)]
    if "\n" in text:
        kinds.append((WRAPPED, None, _from_wrapped))
    if "%" in text:
        kinds.append((RUN, _URL_PART, _from_url))
    if "\\" in text:
        kinds.append((RUN, _ESCAPE_PART, _from_escapes))
    for pattern, sign, unwrap in kinds:
        for m in pattern.finditer(text):
            if sign is not None and sign.search(text, m.start(), m.end()) is None:
                continue
            piece = Layer(m[0], layer.start[m.start() : m.end()], layer.stop[m.start() : m.end()])
            for found in unwrap(piece):
                if found.text and found.text != piece.text:
                    yield found


class _Whole:
    """Offsets of the text itself, without an array for it."""

    def __init__(self, shift: int) -> None:
        self.shift = shift

    def __getitem__(self, at: slice) -> np.ndarray:
        return np.arange(at.start, at.stop) + self.shift


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(finds of the text itself, all finds), each sorted by start, then kind, then stop."""
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    if not text:
        return [], []
    base = sorted(finds(text), key=order)
    every, seen, work = set(base), set(), [_inner(Layer(text, _Whole(0), _Whole(1)))]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        name = (hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), int(layer.start[0]), int(layer.stop[-1]))
        if name in seen:
            continue
        seen.add(name)
        for kind, a, b in finds(layer.text):
            every.add((kind, int(layer.start[a:b].min()), int(layer.stop[a:b].max())))
        work.append(_inner(layer))
    return base, sorted(every, key=order)


def spelled(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each stretch covered by spans replaced by the first one's kind in brackets."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def scanned(docs: DataFrame, redact: bool = False) -> DataFrame:
    """docs' doc_id with n_assign, n_access, n_hex, base_sha256, spans; redact: and the safe text."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [scan(t) for t in texts]
            counts = [pa.array([sum(k == kind for k, _, _ in base) for base, _ in found], pa.int64()) for kind in KINDS]
            digest = pa.array([hashlib.sha256(spelled(base).encode()).hexdigest() for base, _ in found])
            safe = pa.array([redacted(t, e) if redact and t else (t if redact else None) for t, (_, e) in zip(texts, found)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, digest, pa.array([spelled(e) for _, e in found]), safe],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "safe_text"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, safe_text string"
    )
    return out if redact else out.drop("safe_text")


def redacted_docs(docs: DataFrame) -> DataFrame:
    """docs with secrets of any layer replaced in text; every row stays, with the same columns."""
    names = docs.columns

    def run(batches):
        at = names.index("text")
        for batch in batches:
            safe = [redacted(t, scan(t)[1]) if t else t for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, "text", pa.array(safe, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


