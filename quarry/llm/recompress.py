"""Substring dedup by recompression.

A text's words are level-0 symbols. A round first names maximal runs of equal symbols, then names the
pairs that meet where a symbol of the left class stands before one of the right class. Names and
classes are hashes of content, so a round is a narrow step and yet every executor gives the same name
to the same content. With each symbol goes its reach: the words that decided its borders. If a window
of words contains a symbol's reach, every equal window contains the same symbol at the same place.

A window is known by the symbol of the smallest name whose reach it contains. Only windows whose
symbol's reach occurs in another document too are compared, by their whole word sequence; windows
without such a symbol (in long runs of one word) are always compared.

Edge cases: a null or blank text has no words and keeps none; texts shorter than a window lose
nothing; repeated rows of one doc_id are one document and share removals; a row without doc_id loses
nothing and removes nothing; an empty table gives no rows; other columns are ignored; texts may have
any length. Word sequences are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import packed, wordhash
from quarry.llm.wordhash import U

WINDOW, ROUNDS = 50, 3
#: Rows that a task combines before it deals them out.
COMBINED = 1 << 20
_KEYED = np.dtype([("key", "<u8"), ("doc", "<i8")])
_PLACED = np.dtype([("key", "<u8"), ("doc", "<i8"), ("pos", "<i4")])
_SPOT = np.dtype([("doc", "<i8"), ("pos", "<i4")])


class Symbols:
    """The symbols of a piece's texts: names, word ranges [start, stop), reaches [lo, hi), texts."""

    def __init__(self, piece: wordhash.Piece) -> None:
        n = len(piece.hashes)
        self.name, self.start, self.text = piece.hashes, np.arange(n), np.repeat(np.arange(len(piece)), piece.counts)
        self.stop, self.lo, self.hi = self.start + 1, self.start.copy(), self.start + 1
        self.head, self.tail = piece.bounds[:-1] - 1, piece.bounds[1:] + 1

    def _merge(self, joined: np.ndarray, salt: int) -> None:
        """joined[j]: symbols j and j + 1 become part of one symbol."""
        n = len(self.name)
        if n == 0:
            return
        first = np.flatnonzero(np.concatenate([[True], ~joined]))
        last = np.concatenate([first[1:], [n]]) - 1
        merged = last > first
        name = self.name[first].copy()
        name[merged] = wordhash.mix(
            name[merged] * U(0x9FB21C651E98DF25) + wordhash.mix(self.name[last[merged]] + (last - first)[merged].astype(U) * U(salt | 1))
        )
        text = self.text[first]
        # A border exists or not by the two symbols beside it, so a symbol reaches over its neighbours.
        before, after = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
        lo = np.where((first > 0) & (self.text[before] == text), self.lo[before], self.head[text])
        hi = np.where((last < n - 1) & (self.text[after] == text), self.hi[after], self.tail[text])
        self.name, self.text, self.lo, self.hi = name, text, lo, hi
        self.start, self.stop = self.start[first], self.stop[last]

    def round(self, k: int) -> None:
        same = self.text[1:] == self.text[:-1]
        self._merge((self.name[1:] == self.name[:-1]) & same, 4 * k + 1)
        same = self.text[1:] == self.text[:-1]
        side = (wordhash.mix(self.name + U(k + 1)) & U(1)) == 1
        self._merge(~side[:-1] & side[1:] & same, 4 * k + 3)


def _smallest(name: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For ranges [lo, hi), the first index of the smallest name; -1 for empty ones."""
    out = np.full(len(lo), -1, np.int64)
    length = hi - lo
    table, k = np.arange(len(name)), 0
    while True:
        now = (length >= 1 << k) & (length < 2 << k)
        if now.any():
            a, b = table[lo[now]], table[hi[now] - (1 << k)]
            out[now] = np.where(name[b] < name[a], b, a)
        if not (length >= 2 << k).any():
            return out
        a, b = table[: -(1 << k)], table[1 << k :]
        table = np.where(name[b] < name[a], b, a)
        k += 1


def windows(piece: wordhash.Piece, size: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, key, free) of all windows of a piece: key names the reach that a window is known by;
    free windows contain none."""
    room = np.maximum(piece.counts - size + 1, 0)
    start = np.repeat(piece.bounds[:-1] - np.concatenate([[0], np.cumsum(room)[:-1]]), room) + np.arange(room.sum())
    if not len(start):
        return start, np.zeros(0, U), np.zeros(0, bool)
    symbols = Symbols(piece)
    for k in range(rounds):
        symbols.round(k)
    a = np.searchsorted(symbols.lo, start, "left")
    b = np.searchsorted(symbols.hi, start + size, "right")
    best = _smallest(symbols.name, a, np.maximum(a, b))
    free = best < 0
    used = np.unique(best[~free])
    key = np.zeros(len(symbols.name), U)
    key[used] = wordhash.sequences(piece.hashes, symbols.lo[used], symbols.hi[used])
    return start, np.where(free, U(0), key[best]), free


def _docs_of(piece: wordhash.Piece, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The rows of a batch that words at belong to, as doc_ids."""
    return ids[piece.first + np.searchsorted(piece.bounds, at, "right") - 1]


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """doc_ids and whether they are known."""
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ~np.array(column.is_null())


def _per_doc(docs: np.ndarray, values: np.ndarray, name: str):
    """Batches (doc_id, bytes of its values)."""
    if len(docs):
        order = np.argsort(docs, kind="stable")
        docs, values = docs[order], values[order]
        first, length = wordhash.runs(docs)
        data = [values[f : f + k].tobytes() for f, k in zip(first, length)]
        yield pa.RecordBatch.from_arrays([pa.array(docs[first]), pa.array(data, pa.binary())], ["doc_id", name])


def shared_reaches(docs: DataFrame, size: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, keys): of each document, the window keys that another document has too; a document
    with free windows has a row as well."""
    n = packed.buckets(docs)

    def deal(batches):
        parts, held = [], 0

        def flush():
            rows = np.concatenate(parts)
            rows = rows[np.lexsort((rows["doc"], rows["key"]))]
            new = np.concatenate([[True], rows[1:] != rows[:-1]])
            rows = rows[new]
            first, length = wordhash.runs(rows["key"])
            live = np.repeat(length > 1, length)
            head = np.zeros(len(rows), bool)
            head[first] = True
            # Keys that documents of this task share go on once, marked; their rows are settled here.
            out = rows[head]
            flag = live[head]
            yield from packed.dealt((out["key"] % U(n)).astype(np.int64)[flag], out[flag], 1)
            yield from packed.dealt((out["key"] % U(n)).astype(np.int64)[~flag], out[~flag], 0)
            rest = rows[live]
            yield from packed.dealt((rest["doc"].astype(U) % U(n)).astype(np.int64), rest, 2)

        for batch in batches:
            ids, known = _ids(batch.column(0))
            for piece in wordhash.pieces(batch.column(1), lower=False):
                start, key, free = windows(piece, size, rounds)
                row = np.searchsorted(piece.bounds, start, "right") - 1 + piece.first
                some = known[row]
                rows = np.empty(int(some.sum()), _KEYED)
                rows["key"], rows["doc"] = key[some], ids[row[some]]
                if len(rows):
                    new = np.concatenate([[True], rows[1:] != rows[:-1]])
                    alone = free[some]
                    one = np.unique(rows["doc"][alone])
                    mark = np.zeros(len(one), _KEYED)
                    mark["doc"] = one
                    yield from packed.dealt((mark["doc"].astype(U) % U(n)).astype(np.int64), mark, 2)
                    parts.append(rows[new & ~alone])
                    held += len(parts[-1])
                if held >= COMBINED:
                    yield from flush()
                    parts, held = [], 0
        if held:
            yield from flush()

    def meet(batches):
        for _, found in packed.grouped(batches):
            if 2 in found:
                rows = np.frombuffer(found[2], _KEYED)
                yield from _per_doc(rows["doc"], rows["key"], "keys")
            plain = np.frombuffer(found.get(0, b""), _KEYED)
            marked = np.frombuffer(found.get(1, b""), _KEYED)
            rows = np.concatenate([plain, marked])
            if not len(rows):
                continue
            mark = np.concatenate([np.zeros(len(plain), bool), np.ones(len(marked), bool)])
            order = np.lexsort((rows["doc"], rows["key"]))
            rows, mark = rows[order], mark[order]
            first, length = wordhash.runs(rows["key"])
            live = (rows["doc"][first] != rows["doc"][first + length - 1]) | np.logical_or.reduceat(mark, first)
            hit = rows[np.repeat(live, length) & ~mark]
            yield from _per_doc(hit["doc"], hit["key"], "keys")

    blocks = packed.by_bucket(docs.select("doc_id", "text").mapInArrow(deal, packed.BLOCKS))
    return blocks.mapInArrow(meet, "doc_id long, keys binary").groupBy("doc_id").agg(F.collect_list("keys").alias("keys"))


def repeated_windows(docs: DataFrame, shared: DataFrame, size: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, starts): the windows of each document that also start in one with a smaller doc_id."""
    n = packed.buckets(docs)

    def deal(batches):
        parts, held = [], 0

        def flush():
            rows = np.concatenate(parts)
            rows = rows[np.lexsort((rows["doc"], rows["key"]))]
            first, length = wordhash.runs(rows["key"])
            least = np.repeat(rows["doc"][first], length)
            later = rows["doc"] > least
            yield from packed.dealt((rows["key"] % U(n)).astype(np.int64)[~later], rows[~later], 0)
            late = rows[later]
            spots = np.empty(len(late), _SPOT)
            spots["doc"], spots["pos"] = late["doc"], late["pos"]
            yield from packed.dealt((spots["doc"].astype(U) % U(n)).astype(np.int64), spots, 2)

        for batch in batches:
            ids, known = _ids(batch.column(0))
            keys = batch.column(2)
            asked = np.array(keys.is_valid()) & known
            texts = pa.compute.if_else(pa.array(asked), batch.column(1), pa.scalar("", batch.column(1).type))
            for piece in wordhash.pieces(texts, lower=False):
                start, key, free = windows(piece, size, rounds)
                if not len(start):
                    continue
                row = np.searchsorted(piece.bounds, start, "right") - 1
                first, length = wordhash.runs(row)
                live = free.copy()
                for f, k in zip(first, length):
                    own = np.frombuffer(b"".join(x for x in keys[piece.first + int(row[f])].as_py()), U)
                    live[f : f + k] |= np.isin(key[f : f + k], own)
                at = start[live]
                rows = np.empty(len(at), _PLACED)
                rows["key"] = wordhash.sequences(piece.hashes, at, at + size)
                rows["doc"], rows["pos"] = ids[piece.first + row[live]], at - piece.bounds[row[live]]
                parts.append(rows)
                held += len(rows)
                if held >= COMBINED:
                    yield from flush()
                    parts, held = [], 0
        if held:
            yield from flush()

    def meet(batches):
        for _, found in packed.grouped(batches):
            if 2 in found:
                rows = np.frombuffer(found[2], _SPOT)
                yield from _per_doc(rows["doc"], rows["pos"], "starts")
            if 0 in found:
                rows = np.frombuffer(found[0], _PLACED)
                rows = rows[np.lexsort((rows["doc"], rows["key"]))]
                first, length = wordhash.runs(rows["key"])
                late = rows[rows["doc"] > np.repeat(rows["doc"][first], length)]
                yield from _per_doc(late["doc"], late["pos"], "starts")

    asked = docs.join(shared, "doc_id", "left").select("doc_id", "text", "keys")
    blocks = packed.by_bucket(asked.mapInArrow(deal, packed.BLOCKS))
    return blocks.mapInArrow(meet, "doc_id long, starts binary").groupBy("doc_id").agg(F.collect_list("starts").alias("starts"))


def deduplicated(docs: DataFrame, size: int = WINDOW, rounds: int = ROUNDS, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text): texts without what a smaller doc_id has.

    kept_text: the kept words joined by one space; null unless with_text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    starts = repeated_windows(docs, shared_reaches(docs, size, rounds), size, rounds)

    def cut(batches):
        for batch in batches:
            texts = batch.column(1).fill_null("").cast(pa.large_binary())
            total, gone, digest, kept_text = [], [], [], []
            for text, found in zip(texts, batch.column(2)):
                words = text.as_py().split()
                removed = 0
                if found.is_valid:
                    at = np.frombuffer(b"".join(found.as_py()), "<i4")
                    edge = np.bincount(at, minlength=len(words) + size + 1) - np.bincount(at + size, minlength=len(words) + size + 1)
                    stays = np.cumsum(edge)[: len(words)] == 0
                    removed = len(words) - int(stays.sum())
                    total.append(len(words))
                    words = list(compress(words, stays.tolist()))
                else:
                    total.append(len(words))
                kept = b" ".join(words)
                gone.append(removed)
                digest.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest), pa.array(kept_text, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    rows = docs.join(starts, "doc_id", "left").select("doc_id", "text", "starts")
    return rows.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
