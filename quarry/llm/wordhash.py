"""Vectorised words and hashes over Arrow string batches.

A batch's texts lie in one byte buffer. Words are found in the whole buffer at once, and a word's
hash comes from a prefix sum of byte_value * r**i modulo 2**64, divided by r**start; so a word costs
the same wherever it stands, and no Python object is made for it. Names are functions of content
alone, hence equal on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_RATIO = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_RATIO, -1, 1 << 64)
_WORD_RATIO = 0xD1342543DE82EF95
_WORD_INVERSE = pow(_WORD_RATIO, -1, 1 << 64)
#: Bytes handled at a time, so that intermediate arrays stay small; a longer text is one piece.
PIECE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose every output bit depends on every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x632BE59BD9B4E019))
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class _Powers:
    """ratio**i and inverse**i modulo 2**64, grown on demand."""

    def __init__(self, ratio: int, inverse: int) -> None:
        self.pair, self.up, self.down = (ratio, inverse), np.ones(1, U), np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * U(pow(self.pair[0], k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * U(pow(self.pair[1], k, 1 << 64))])
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_RATIO, _INVERSE), _Powers(_WORD_RATIO, _WORD_INVERSE)


@dataclass
class Piece:
    """Some texts of a batch. first: the row of the first; counts: words by text; bounds: their first words."""

    first: int
    counts: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    raw: np.ndarray

    def __len__(self) -> int:
        return len(self.counts)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array; nulls as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def pieces(texts: pa.Array, lower: bool) -> Iterator[Piece]:
    """Words of [^\\x20\\x09-\\x0D]+ and their hashes; lower: with A-Z taken as a-z."""
    if not len(texts):
        return
    offsets, data = _buffers(texts)
    table, row = _LOWER if lower else _BYTE, 0
    while row < len(offsets) - 1:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE_BYTES, "right")) - 1)
        lo, hi = offsets[row], offsets[end]
        raw = data[lo:hi]
        edges = offsets[row : end + 1] - lo
        space = _SPACE[raw]
        begin = ~space
        begin[1:] &= space[:-1]
        at_edge = edges[:-1][edges[:-1] < len(raw)]
        begin[at_edge] = ~space[at_edge]
        stop = ~space
        stop[:-1] &= space[1:]
        last = edges[1:][edges[1:] > 0] - 1
        stop[last] = ~space[last]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        up, down = _BYTES.upto(max(1, len(raw)))
        sums = np.zeros(len(raw) + 1, U)
        np.cumsum(table[raw] * up[: len(raw)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))
        bounds = np.searchsorted(starts, edges)
        yield Piece(row, np.diff(bounds), bounds, hashes, starts, ends, raw)
        row = end


def sequences(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the word sequences [starts, ends)."""
    up, down = _WORDS.upto(max(1, len(hashes)))
    sums = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    down = down if len(down) > len(hashes) else _WORDS.upto(len(hashes) + 1)[1]
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0xA24BAED4963EE407))


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return first, np.diff(np.concatenate([first, [len(sorted_keys)]]))
