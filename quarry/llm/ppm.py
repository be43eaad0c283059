"""LM scoring by prediction by partial matching over a byte-context trie.

Training counts every byte after its three-byte context, over all training texts. Shorter contexts are
suffix sums of the same trie. A byte unseen in its context escapes to the next shorter one with
probability d / (t + d), d being the distinct bytes seen there and t their count; bytes seen in the
longer context are excluded from the shorter (symbol exclusion), and after the empty context every
byte left is equally likely. The pretrained trie is walked by table look-ups, so a text's code length
accumulates at a few array reads a byte. The most frequent contexts are broadcast; bytes after any other
context meet its counts in a shuffle, so the model keeps every context whatever the size of the corpus.

Beside it stands a unigram model of words. Frequent words are looked up in a broadcast table of bounded
size; the others meet their counts in a shuffle, so that no vocabulary needs to fit in a task.

Texts are lower-cased in A-Z and taken as UTF-8; byte 0 ends a text and pads the first contexts.

Edge cases: a null text is empty: one token, the end; every row is scored on its own, also rows that
repeat a doc_id or have none, and equal texts get equal scores; a null doc_id counts as neither held
out nor training; an empty table gives no rows; without training texts every byte is equally likely;
other columns are ignored; texts are scored whole. Words are told apart by 64-bit hashes. A row's
parts meet by its number in the table, so docs should be a table that is read, not one computed anew.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import packed, wordhash
from quarry.llm.tables import written
from quarry.llm.wordhash import U

#: Three-byte contexts of the broadcast trie (1 KB each in a worker), and their counts (12 bytes each on the driver).
BROADCAST_CONTEXTS, BROADCAST_CODES = 1 << 17, 1 << 22
#: Words of the broadcast table.
FREQUENT = 1 << 18
#: The smoothing of the unigram model.
ADDED = 0.1
HELD_OUT_OF, HELD_OUT = 10, 0
COMBINED = 1 << 22
_WORD = np.dtype([("h", "<u8"), ("n", "<i8")])
_CODE = np.dtype([("c", "<u4"), ("n", "<i8")])
_USE = np.dtype([("h", "<u8"), ("doc", "<i8"), ("n", "<i8")])
_SYMBOL = np.dtype([("c", "<u4"), ("n", "<u4"), ("doc", "<i8")])
#: doc: the row's number; rows: 1 where id is the row's doc_id, with the rest of the row's own part.
_DOC = np.dtype([("doc", "<i8"), ("rows", "<i8"), ("id", "<i8"), ("tokens", "<i8"), ("known", "<i8"), ("base", "<f8"), ("score", "<f8")])
_NO_ID = np.iinfo(np.int64).min
#: The hash that stands for the end of a text.
END = U(0x5851F42D4C957F2D)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo of; 1 for a null id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % of, F.lit(1))


def _summed(keys: np.ndarray, n: np.ndarray, kind: np.dtype) -> np.ndarray:
    names = kind.names
    key, inverse = np.unique(keys, return_inverse=True)
    out = np.zeros(len(key), kind)
    out[names[0]] = key
    np.add.at(out[names[1]], inverse, n)
    return out


def _streams(texts: pa.Array):
    """(bytes with three zeros before each text and one after, places of the symbols, their texts, first row)."""
    offsets, data = wordhash._buffers(texts)
    row = 0
    while row < len(offsets) - 1:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + wordhash.PIECE_BYTES, "right")) - 1)
        sizes = np.diff(offsets[row : end + 1])
        count = sizes + 1
        text = np.repeat(np.arange(end - row), count)
        begin = np.concatenate([[0], np.cumsum(count)[:-1]])
        places = np.arange(count.sum()) + 3 * (text + 1)
        stream = np.zeros(int(count.sum()) + 3 * (end - row), np.uint8)
        body = np.ones(len(places), bool)
        body[begin + sizes] = False
        stream[places[body]] = _LOWER[data[offsets[row] : offsets[end]]]
        yield stream, places, text, row
        row = end


def _codes(stream: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Each symbol with its three-byte context, as one number."""
    x = stream.astype(np.uint32)
    return (x[places - 3] << 24) | (x[places - 2] << 16) | (x[places - 1] << 8) | x[places]


def _context_bucket(codes: np.ndarray, n: int) -> np.ndarray:
    return (wordhash.mix((codes >> 8).astype(U)) % U(n)).astype(np.int64)


def trained(docs: DataFrame) -> DataFrame:
    """(bucket, kind, payload): counts of words (kind 0) and of bytes after contexts (kind 1)."""
    n = packed.buckets(docs)

    def deal(batches):
        held = {0: [], 1: []}

        def flush(kind, dtype):
            every = np.concatenate(held[kind])
            rows = _summed(every[dtype.names[0]], every["n"], dtype)
            bucket = rows["h"] % U(n) if kind == 0 else _context_bucket(rows["c"], n)
            held[kind] = []
            yield from packed.dealt(bucket.astype(np.int64), rows, kind)

        for batch in batches:
            column = batch.column(0)
            for piece in wordhash.pieces(column, lower=True):
                keys = np.concatenate([piece.hashes, np.full(len(piece), END, U)])
                held[0].append(_summed(keys, np.ones(len(keys), np.int64), _WORD))
            for stream, places, _, _ in _streams(column):
                code, count = np.unique(_codes(stream, places), return_counts=True)
                rows = np.empty(len(code), _CODE)
                rows["c"], rows["n"] = code, count
                held[1].append(rows)
            for kind, dtype in ((0, _WORD), (1, _CODE)):
                if sum(map(len, held[kind])) > COMBINED:
                    yield from flush(kind, dtype)
        for kind, dtype in ((0, _WORD), (1, _CODE)):
            if held[kind]:
                yield from flush(kind, dtype)

    def add(batches):
        for bucket, found in packed.grouped(batches):
            for kind, dtype in ((0, _WORD), (1, _CODE)):
                if kind in found:
                    rows = np.frombuffer(found[kind], dtype)
                    rows = _summed(rows[dtype.names[0]], rows["n"], dtype)
                    yield from packed.dealt(np.full(len(rows), bucket), rows, kind)

    return packed.by_bucket(docs.select("text").mapInArrow(deal, packed.BLOCKS)).mapInArrow(add, packed.BLOCKS)


def _root(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, open) of the empty context: see _after()."""
    left = 256 - np.count_nonzero(total)
    every = np.zeros((1, 256))
    seen = total > 0
    t, d = total.sum(), seen.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        every[0, seen] = np.log10(total[seen] / (t + d)) if d else 0.0
        if left:
            every[0, ~seen] = (np.log10(d / (t + d)) if d else 0.0) - np.log10(left)
    return every, np.where(seen, 0.0, -np.log10(max(left, 1)))[None, :]


def _after(table: np.ndarray, lower: np.ndarray, lower_open: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, open) of contexts with these counts: what symbols cost from the context on, and the same once
    its own symbols are excluded, for the symbols it lacks. lower, lower_open: of the next shorter contexts."""
    own = table > 0
    t, d = table.sum(1), own.sum(1)
    fresh = (lower > 0) & ~own
    tx, dx = (lower * fresh).sum(1), fresh.sum(1)
    # Without fresh symbols below, the escape below is certain and costs nothing.
    step = np.log10(np.where(dx > 0, dx / np.maximum(tx + dx, 1), 1.0))
    unseen = np.where(fresh, np.log10(np.maximum(lower, 1) / np.maximum(tx + dx, 1)[:, None]), step[:, None] + lower_open)
    first = np.log10(d / (t + d))
    return np.where(own, np.log10(np.maximum(table, 1) / (t + d)[:, None]), first[:, None] + unseen), np.where(own, 0.0, unseen)


class Trie:
    """Log10 probabilities from counts of code = context byte, .., symbol, for contexts of `order` bytes.

    base: (codes, counts) of all contexts of order - 1 bytes, if codes holds only some of order bytes.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int, base: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.order, levels = order, {}
        for k in range(order, -1, -1):
            of, n = (codes, counts) if base is None or k == order else base
            low = of.astype(np.int64) & ((1 << (8 * (k + 1))) - 1)
            code, inverse = np.unique(low, return_inverse=True)
            levels[k] = (code, np.bincount(inverse, n) if len(code) else np.zeros(0))
        total = np.zeros(256)
        total[levels[0][0]] = levels[0][1]
        every, open_ = _root(total)
        self.ids, self.values = {0: np.zeros(1, np.int64)}, {0: every}
        below_counts, below_open = total[None, :], open_
        below_index = lambda c: np.zeros(len(c), np.int64)
        for k in range(1, order + 1):
            code, count = levels[k]
            context, row = np.unique(code >> 8, return_inverse=True)
            parents = below_index(context & ((1 << (8 * (k - 1))) - 1))
            value = np.zeros((len(context), 256), np.float32 if k == order else np.float64)
            tables, opens = [], []
            for a in range(0, len(context), 4096):
                b = min(a + 4096, len(context))
                here = slice(*np.searchsorted(row, [a, b]))
                table = np.zeros((b - a, 256))
                table[row[here] - a, code[here] & 255] = count[here]
                parent = parents[a:b]
                value[a:b], open_ = _after(table, below_counts[parent], below_open[parent])
                if k < order:
                    tables.append(table), opens.append(open_)
            self.values[k] = value
            index = np.full(1 << (8 * k), -1, np.int32) if k <= 2 else None
            if index is not None:
                index[context] = np.arange(len(context))
                self.ids[k] = index
                below_index = lambda c, i=index: i[c].astype(np.int64)
            else:
                # A third byte hangs below the two-byte context before it.
                child = np.full((len(self.values[2]), 256), -1, np.int32)
                child[self.ids[2][context >> 8], context & 255] = np.arange(len(context))
                self.ids[k] = child
            if tables:
                below_counts, below_open = np.concatenate(tables), np.concatenate(opens)

    def score(self, stream: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Log10 probability of the symbol at each place."""
        x = stream.astype(np.int32)
        s, c1, c2, c3 = x[3:], x[2:-1], x[1:-2], x[:-3]
        out = np.empty(len(s))
        left = np.arange(len(s))
        for k in range(self.order, -1, -1):
            if not len(self.values[k]):
                continue
            if k == 3:
                row = self.ids[2].take((c3 << 8) | c2)
                row = np.where(row >= 0, self.ids[3].ravel().take(np.maximum(row, 0) * 256 + c1), -1)
            else:
                row = self.ids[k].take((c2[left] << 8) | c1[left] if k == 2 else c1[left] if k == 1 else np.zeros(len(left), np.int32))
            here = row >= 0
            if k == self.order and here.all():
                return self.values[k].ravel().take(row.astype(np.int64) * 256 + s).astype(float)[places - 3]
            at = left[here]
            out[at] = self.values[k].ravel().take(row[here].astype(np.int64) * 256 + s[at])
            left = left[~here]
            if not len(left):
                break
        return out[places - 3]


    def holds(self, codes: np.ndarray) -> np.ndarray:
        """Which of these codes of three-byte contexts have their context in the trie."""
        if not len(self.values[3]):
            return np.zeros(len(codes), bool)
        row = self.ids[2].take(codes >> 16)
        return (row >= 0) & (self.ids[3].ravel().take(np.maximum(row, 0) * 256 + ((codes >> 8) & 255).astype(np.int64)) >= 0)


class Shard:
    """The trie's values for a bucket of three-byte contexts, computed as they are asked for.

    codes, counts: of all two-byte contexts, sorted.
    """

    CONTEXTS = 1024

    def __init__(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.codes, self.counts = codes.astype(np.int64), counts.astype(float)
        self.two = np.unique(self.codes >> 8)
        pairs = np.zeros(1 << 16)
        np.add.at(pairs, self.codes & 0xFFFF, self.counts)
        self.counts1 = pairs.reshape(256, 256)
        total = self.counts1.sum(0)
        self.values0, open_ = _root(total)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.values1, self.open1 = _after(self.counts1, total[None, :], open_)

    @staticmethod
    def _table(codes: np.ndarray, counts: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """Counts of all symbols after contexts, from sorted codes."""
        first, end = np.searchsorted(codes, contexts << 8), np.searchsorted(codes, (contexts + 1) << 8)
        row = np.repeat(np.arange(len(contexts)), end - first)
        at = np.arange(len(row)) + np.repeat(first - np.cumsum(end - first) + (end - first), end - first)
        out = np.zeros((len(contexts), 256))
        out[row, codes[at] & 255] = counts[at]
        return out

    def _two(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        table = self._table(self.codes, self.counts, contexts)
        return table, *_after(table, self.counts1[contexts & 255], self.open1[contexts & 255])

    def score(self, codes: np.ndarray, counts: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Log10 probability of each asked code; codes, counts: what training saw after the bucket's contexts, sorted."""
        codes, (code, inverse) = codes.astype(np.int64), np.unique(asked.astype(np.int64), return_inverse=True)
        context, symbol = code >> 8, code & 255
        out = np.where(self.counts1[context & 255].any(1), self.values1[context & 255, symbol], self.values0[0, symbol])
        deep = np.isin(context, codes >> 8)
        for here, of in ((~deep & np.isin(context & 0xFFFF, self.two), context & 0xFFFF), (deep, context)):
            at = np.flatnonzero(here)
            every, row = np.unique(of[at], return_inverse=True)
            for a in range(0, len(every), self.CONTEXTS):
                some, hit = every[a : a + self.CONTEXTS], (row >= a) & (row < a + self.CONTEXTS)
                if of is context:
                    parent, own = np.unique(some & 0xFFFF, return_inverse=True)
                    lower, _, open_ = self._two(parent)
                    value = _after(self._table(codes, counts, some), lower[own], open_[own])[0].astype(np.float32)
                else:
                    value = self._two(some)[1]
                out[at[hit]] = value[row[hit] - a, symbol[at[hit]]]
        return out[inverse]


_TRIES: dict = {}


def _trie(name: str, *data) -> Trie | Shard:
    """The trie, or with counts of two-byte contexts alone the shard, built once in each Python worker."""
    if name not in _TRIES:
        _TRIES.clear()
        _TRIES[name] = Trie(*data) if len(data) > 2 else Shard(*data)
    return _TRIES[name]


def fitted(model: DataFrame) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray] | None]:
    """(codes, counts, base): base holds the counts of two-byte contexts if codes has only the most frequent of the
    three-byte contexts, by powers of two, within BROADCAST_CONTEXTS and BROADCAST_CODES."""
    trie = model.where("kind = 1").select("payload")

    def times(rows):
        # A context's counts lie in one bucket, so a payload has all of them.
        _, row = np.unique(rows["c"] >> 8, return_inverse=True)
        total = np.bincount(row, rows["n"])
        return row, np.log2(total).astype(np.int64)

    def sizes(batches):
        for batch in batches:
            contexts, codes = np.zeros(64, np.int64), np.zeros(64, np.int64)
            for x in batch.column(0):
                row, size = times(np.frombuffer(x.as_buffer(), _CODE))
                contexts += np.bincount(size, minlength=64)
                codes += np.bincount(size[row], minlength=64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(64)), pa.array(contexts), pa.array(codes)], ["e", "n", "m"])

    found = trie.mapInArrow(sizes, "e long, n long, m long").groupBy("e").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).collect()
    have, base = {r["e"]: (r["n"], r["m"]) for r in found}, None
    least, contexts, codes = 64, 0, 0
    while least > 0:
        n, m = have.get(least - 1, (0, 0))
        if contexts + n > BROADCAST_CONTEXTS or codes + m > BROADCAST_CODES:
            break
        least, contexts, codes = least - 1, contexts + n, codes + m
    if least > 0:

        def shorter(batches):
            for batch in batches:
                rows = [np.frombuffer(x.as_buffer(), _CODE) for x in batch.column(0)]
                rows = np.concatenate(rows)
                key, inverse = np.unique(rows["c"] & 0xFFFFFF, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.astype(np.int64)), pa.array(np.bincount(inverse, rows["n"]).astype(np.int64))], ["c", "n"]
                )

        rows = trie.mapInArrow(shorter, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).toArrow()
        code, n = rows["c"].to_numpy().astype(np.uint32), rows["n"].to_numpy().astype(np.int64)
        base = code[np.argsort(code)], n[np.argsort(code)]

        def frequent(batches):
            for batch in batches:
                for x in batch.column(0):
                    rows = np.frombuffer(x.as_buffer(), _CODE)
                    row, size = times(rows)
                    yield pa.RecordBatch.from_arrays([pa.array([rows[size[row] >= least].tobytes()], pa.binary())], ["payload"])

        trie = trie.mapInArrow(frequent, "payload binary")
    raw = b"".join(r["payload"] for r in trie.collect())
    rows = np.sort(np.frombuffer(raw, _CODE), order="c")
    return rows["c"].copy(), rows["n"].copy(), base


def _frequent(model: DataFrame) -> np.ndarray:
    """The words of the largest counts, by powers of two, at most FREQUENT of them."""
    words = model.where("kind = 0").select("payload")

    def sizes(batches):
        for batch in batches:
            out = np.zeros(64, np.int64)
            for x in batch.column(0):
                out += np.bincount(np.log2(np.frombuffer(x.as_buffer(), _WORD)["n"]).astype(np.int64), minlength=64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(64)), pa.array(out)], ["e", "n"])

    have = {r["e"]: r["n"] for r in words.mapInArrow(sizes, "e long, n long").groupBy("e").agg(F.sum("n").alias("n")).collect()}
    least, total = 64, 0
    while least > 0 and total + have.get(least - 1, 0) <= FREQUENT:
        least -= 1
        total += have.get(least, 0)

    def large(batches):
        for batch in batches:
            rows = np.concatenate([np.frombuffer(x.as_buffer(), _WORD) for x in batch.column(0)])
            yield pa.RecordBatch.from_arrays([pa.array([rows[rows["n"] >= 1 << least].tobytes()], pa.binary())], ["payload"])

    if least > 62:
        return np.zeros(0, _WORD)
    raw = b"".join(r["payload"] for r in words.mapInArrow(large, "payload binary").collect())
    return np.sort(np.frombuffer(raw, _WORD), order="h")


def scored(docs: DataFrame, train: Column | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of docs(doc_id, text).

    train: which rows to learn from; by default those not held out.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    chosen = docs.where(remainder(F.col("doc_id"), HELD_OUT_OF) != HELD_OUT if train is None else train).where("doc_id IS NOT NULL")
    model = written(trained(chosen), "ppm-model")
    codes, counts, base = fitted(model)
    top = _frequent(model)

    def totals(batches):
        for batch in batches:
            for x in batch.column(0):
                n = np.frombuffer(x.as_buffer(), _WORD)["n"]
                yield pa.RecordBatch.from_arrays([pa.array([len(n)]), pa.array([int(n.sum())])], ["v", "n"])

    size = model.where("kind = 0").select("payload").mapInArrow(totals, "v long, n long").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    distinct, total = size["v"] or 0, size["n"] or 0
    # A vocabulary of nothing still has the end, unseen.
    floor = total + ADDED * (distinct + 1)
    n = packed.buckets(docs)
    trie_data, name = spark.sparkContext.broadcast((codes, counts, 3, base)), uuid.uuid4().hex
    base_data = spark.sparkContext.broadcast(base) if base else None
    top_data = spark.sparkContext.broadcast(top)

    def deal(batches):
        trie = _trie(name, *trie_data.value)
        top = top_data.value
        top_log = np.log10((top["n"] + ADDED) / floor)
        uses, symbols, held = [], [], 0

        def flush():
            if uses:
                rows = np.concatenate(uses)
                yield from packed.dealt((rows["h"] % U(n)).astype(np.int64), rows, 2)
            if symbols:
                rows = np.concatenate(symbols)
                yield from packed.dealt(_context_bucket(rows["c"], n), rows, 4)

        for batch in batches:
            ids = batch.column(2).to_numpy()
            out = np.zeros(batch.num_rows, _DOC)
            out["doc"], out["rows"] = ids, 1
            out["id"] = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            for stream, places, text, row in _streams(batch.column(1)):
                each = trie.score(stream, places)
                if base_data:
                    code = _codes(stream, places)
                    far = np.flatnonzero(~trie.holds(code))
                    each[far] = 0
                    key, times = np.unique(text[far].astype(U) << U(32) | code[far].astype(U), return_counts=True)
                    rows = np.empty(len(key), _SYMBOL)
                    rows["c"], rows["n"], rows["doc"] = key & U(0xFFFFFFFF), times, ids[row + (key >> U(32)).astype(np.int64)]
                    symbols.append(rows)
                    held += len(rows)
                part = np.bincount(text, each)
                out["score"][row : row + len(part)] = part
            for piece in wordhash.pieces(batch.column(1), lower=True):
                k = len(piece)
                text = np.concatenate([np.repeat(np.arange(k), piece.counts), np.arange(k)])
                word = np.concatenate([piece.hashes, np.full(k, END, U)])
                own = slice(piece.first, piece.first + k)
                out["tokens"][own] = piece.counts + 1
                spot = np.minimum(np.searchsorted(top["h"], word), max(len(top) - 1, 0))
                hit = top["h"][spot] == word if len(top) else np.zeros(len(word), bool)
                out["known"][own] = np.bincount(text[hit], minlength=k)
                out["base"][own] = np.bincount(text[hit], top_log[spot[hit]], minlength=k) if len(top) else 0
                rest, of = word[~hit], text[~hit]
                order_ = np.lexsort((rest, of))
                rest, of = rest[order_], of[order_]
                new = np.flatnonzero(np.concatenate([[True], (rest[1:] != rest[:-1]) | (of[1:] != of[:-1])])) if len(rest) else np.zeros(0, int)
                rows = np.empty(len(new), _USE)
                rows["h"], rows["doc"] = rest[new], ids[piece.first + of[new]]
                rows["n"] = np.diff(np.concatenate([new, [len(rest)]])) if len(rest) else 0
                uses.append(rows)
                held += len(rows)
            yield from packed.dealt((out["doc"].astype(U) % U(n)).astype(np.int64), out, 3)
            if held > COMBINED // 4:
                yield from flush()
                uses, symbols, held = [], [], 0
        if held:
            yield from flush()

    def meet(batches):
        for _, found in packed.grouped(batches):
            parts = []
            if 3 in found:
                parts.append(np.frombuffer(found[3], _DOC))
            if 2 in found:
                use, have = np.frombuffer(found[2], _USE), np.frombuffer(found.get(0, b""), _WORD)
                have = have[np.argsort(have["h"])]
                spot = np.minimum(np.searchsorted(have["h"], use["h"]), max(len(have) - 1, 0))
                c = np.where(have["h"][spot] == use["h"], have["n"][spot], 0) if len(have) else np.zeros(len(use), np.int64)
                rows = np.zeros(len(use), _DOC)
                rows["doc"], rows["known"], rows["base"] = use["doc"], use["n"] * (c > 0), use["n"] * np.log10((c + ADDED) / floor)
                parts.append(rows)
            if 4 in found:
                use, have = np.frombuffer(found[4], _SYMBOL), np.sort(np.frombuffer(found.get(1, b""), _CODE), order="c")
                rows = np.zeros(len(use), _DOC)
                rows["doc"], rows["score"] = use["doc"], use["n"] * _trie(name + "shard", *base_data.value).score(have["c"], have["n"], use["c"])
                parts.append(rows)
            rows = np.concatenate(parts) if parts else np.zeros(0, _DOC)
            if len(rows):
                doc, at = np.unique(rows["doc"], return_inverse=True)
                out = np.zeros(len(doc), _DOC)
                out["doc"] = doc
                for c in _DOC.names[1:]:
                    np.add.at(out[c], at, rows[c])
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(out[c])) for c in _DOC.names], list(_DOC.names))

    blocks = numbered.mapInArrow(deal, packed.BLOCKS).union(model if base else model.where("kind = 0"))
    kinds = {"base": "double", "score": "double"}
    parts = packed.by_bucket(blocks).mapInArrow(meet, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in _DOC.names))
    sums = parts.groupBy("doc").agg(*(F.sum(c).alias(c) for c in _DOC.names[1:]))
    return sums.select(
        F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"),
        F.col("tokens").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )
