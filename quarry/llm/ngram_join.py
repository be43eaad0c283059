"""N-gram Jaccard join by multiple-global-order filtering.

Two sets with Jaccard similarity of 0.75 or more share a token among the first n - ceil(0.75 n) + 1
of each, under any one order of all tokens, and l tokens among the first n - ceil(0.75 n) + l.
Several orders are applied one after the other, and a pair must pass all of them:

1. By hash. The l-extended prefix of every document is dealt out by token; a document of which fewer
   than l prefix tokens occur elsewhere has no partner and leaves.
2. Rarest first, counted among those left. Tokens found nowhere else come first, so texts that only
   share passages leave. With its place in this order a token tells the sizes that a partner may have:
   two sets of n and m need an overlap of ceil(0.75 (n + m) / 1.75), and share a token among the first
   n - overlap + 1 of one and m - overlap + 1 of the other. So texts that share less than that, however
   much of them is a common passage, never form groups of candidates.
3. By hash from the top, checked with the first order on each candidate before its exact comparison,
   in pairs and in blocks alike.

Documents with equal sets are one class from the start. Links are verified from each class to one
leader of a token group, in rounds; classes that a chain of links already joins need no further
comparison, and what is then left across components is compared in full: small groups as pairs,
large ones in blocks of bounded size against blocks of texts of fitting length. No link between different components is missed, and no group is
ever expanded into all pairs. Tokens of large groups are dealt out in several ways, so no task gets a
group whole.

Edge cases: a null or blank text has no set, links with nothing and is its own component; fewer than
five words are one shingle; repeated rows and repeated doc_ids are one node; ties in rarity go by the
token, and a component is named by its smallest doc_id; a null doc_id gets the component of equal
texts, or null; an empty table gives no rows; other columns are ignored; texts may have any length.
Tokens are 64-bit hashes of the words; sets are told apart by a 64-bit hash and their size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import packed, wordhash
from quarry.llm.components import components
from quarry.llm.tables import arrow_rows, written
from quarry.llm.wordhash import U

WORDS, SIMILARITY = 5, 75
#: Classes up to which the survivors of the first order are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Rounds of comparing with one leader before what is left is compared in full.
LEADER_ROUNDS = 3
#: Group size from which the full comparison works in blocks, and the tokens of a block, about.
BLOCKED_FROM, BLOCK_TOKENS = 48, 1 << 15
#: Rows of a token that are dealt out as one, and tokens with more up to which their table is broadcast.
HOT_ROWS, BROADCAST_HOT = 256, 500_000
#: Pairs or blocks, each with its token arrays, that a Python worker gets at once.
ROWS_AT_ONCE = 128
#: Tokens that a task combines before it deals them out.
COMBINED = 1 << 19
_48 = (1 << 48) - 1


def _need(n, percent: int):
    """The smallest overlap that a set of n can have with a partner: ceil(percent n / 100)."""
    return (n * percent + 99) // 100


def _overlap(n, m, percent: int):
    """The smallest overlap of two sets of n and m that are similar enough."""
    return (percent * (n + m) + 99 + percent) // (100 + percent)


def _extra(n):
    """l of the extended prefix: tokens of it that must occur elsewhere."""
    return 1 + n // 12


def shingle_sets(texts: pa.Array, size: int = WORDS):
    """(row, sorted distinct uint64 hashes) of every text of a batch."""
    for piece in wordhash.pieces(texts, lower=True):
        h, b = piece.hashes, piece.bounds
        full = max(0, len(h) - size + 1)
        starts = np.arange(full)
        every = wordhash.sequences(h, starts, starts + size) if full else np.zeros(0, U)
        for k, n in enumerate(piece.counts):
            if n >= size:
                yield piece.first + k, np.unique(every[b[k] : b[k + 1] - size + 1])
            elif n:
                yield piece.first + k, wordhash.sequences(h, b[k : k + 1], b[k + 1 : k + 2])
            else:
                yield piece.first + k, np.zeros(0, U)


def _signature(tokens: np.ndarray) -> int:
    """A 64-bit name of a set."""
    if not len(tokens):
        return 0
    x = np.array([tokens.sum(dtype=U), np.bitwise_xor.reduce(wordhash.mix(tokens)), U(len(tokens))], U)
    return int(wordhash.mix(x * np.array([3, 5, 7], U)).sum(dtype=U).astype(np.int64))


def sets(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """(doc_id, n, sig): size and name of each document's set."""

    def run(batches):
        for batch in batches:
            n, sig = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for row, tokens in shingle_sets(batch.column(1), size):
                n[row], sig[row] = len(tokens), _signature(tokens)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(sig)], ["doc_id", "n", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, sig long")


_POSTING = np.dtype([("t", "<u8"), ("s", "<u8")])


def _pack6(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), 8)[:, :6])


def _unpack6(a: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), 8), np.uint8)
    out[:, :6] = a
    return out.view(U).ravel()


def _live_runs(t: np.ndarray, s: np.ndarray):
    """Sorted by (t, s) and without repeats: t, s, and whether another s has the same t."""
    order = np.lexsort((s, t))
    t, s = t[order], s[order]
    keep = np.concatenate([[True], (t[1:] != t[:-1]) | (s[1:] != s[:-1])]) if len(t) else np.zeros(0, bool)
    t, s = t[keep], s[keep]
    first, length = wordhash.runs(t)
    return t, s, np.repeat(length > 1, length), first


def prefix_survivors(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """classes(sig, n, rep) of which enough tokens of the hash-order prefix occur in other classes."""
    buckets = packed.buckets(docs)

    def deal(batches):
        held_t, held_s, seen, held = [], [], set(), 0

        def flush():
            if not held_t:
                return
            t, s = np.concatenate(held_t), np.concatenate(held_s)
            t, s, live, first = _live_runs(t, s)
            # A token that two classes of this task share is known to be live: its own classes are
            # counted here, and one row tells the others. Hot tokens thus leave once for each task.
            head = np.zeros(len(t), bool)
            head[first] = True
            out = head | ~live
            rows = np.concatenate([_pack6(t[out]), _pack6(s[out]), live[out].astype(np.uint8)[:, None]], axis=1)
            yield from packed.dealt((t[out] % U(buckets)).astype(np.int64), rows, 0)
            if live.any():
                names, counts = np.unique(s[live], return_counts=True)
                yield from packed.dealt((names % U(buckets)).astype(np.int64), np.stack([names, counts.astype(U)], 1), 1)

        for batch in batches:
            for _, tokens in shingle_sets(batch.column(0), size):
                n = len(tokens)
                sig = _signature(tokens)
                if n and sig not in seen:
                    seen.add(sig)
                    p = n - _need(n, percent) + _extra(n)
                    held_t.append(wordhash.mix(tokens[:p]) & U(_48))
                    held_s.append(np.full(min(p, n), sig & _48, U))
                    held += p
                    if held >= COMBINED:
                        yield from flush()
                        held_t, held_s, held = [], [], 0
        yield from flush()

    def count(batches):
        names, counts = [], []
        for _, found in packed.grouped(batches):
            if 0 in found:
                rows = np.frombuffer(found[0], np.uint8).reshape(-1, 13)
                t, s, flag = _unpack6(rows[:, :6]), _unpack6(rows[:, 6:12]), rows[:, 12] > 0
                order = np.lexsort((s, t))
                t, s, flag = t[order], s[order], flag[order]
                first, length = wordhash.runs(t)
                live = np.repeat((s[first] != s[first + length - 1]) | np.logical_or.reduceat(flag, first), length)
                # A flagged row was counted where it came from; the same class may come from two tasks.
                new = np.concatenate([[True], (t[1:] != t[:-1]) | (s[1:] != s[:-1])])
                own = np.logical_or.reduceat(flag, np.flatnonzero(new))
                hit = s[new][live[new] & ~own]
                if len(hit):
                    k, c = np.unique(hit, return_counts=True)
                    names.append(k), counts.append(c)
            if 1 in found:
                rows = np.frombuffer(found[1], U).reshape(-1, 2)
                names.append(rows[:, 0]), counts.append(rows[:, 1].astype(np.int64))
            if sum(map(len, names)) > COMBINED:
                yield from sums(names, counts)
                names, counts = [], []
        yield from sums(names, counts)

    def sums(names, counts):
        if names:
            k, inverse = np.unique(np.concatenate(names), return_inverse=True)
            rows = np.stack([k, np.bincount(inverse, np.concatenate(counts)).astype(U)], 1)
            yield from packed.dealt((k % U(buckets)).astype(np.int64), rows, 0)

    def total(batches):
        for _, found in packed.grouped(batches):
            rows = np.frombuffer(found[0], U).reshape(-1, 2)
            k, inverse = np.unique(rows[:, 0], return_inverse=True)
            c = np.bincount(inverse, rows[:, 1]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(c)], ["s", "c"])

    counted = packed.by_bucket(docs.select("text").mapInArrow(deal, packed.BLOCKS)).mapInArrow(count, packed.BLOCKS)
    live = packed.by_bucket(counted).mapInArrow(total, "s long, c long")
    least = F.expr("1 + floor(n / 12)")
    return classes.where("n > 0 AND rep IS NOT NULL").join(live, F.col("sig").bitwiseAND(F.lit(_48)) == F.col("s")).where(
        F.col("c") >= least
    ).select("sig", "n", "rep")


def rare_prefixes(docs: DataFrame, survivors: DataFrame, size: int, percent: int) -> DataFrame:
    """(rep, n, tokens, prefix) of survivors that keep a partner under the rarest-first order.

    tokens: the hashes, sorted, that another survivor has too, as bytes; the others can't be in any
    intersection. prefix: those within the first n - ceil(percent n / 100) + 1, rarest first.
    """
    buckets = packed.buckets(docs)
    few = survivors.count() <= BROADCAST_ROWS
    chosen = survivors.select(F.col("rep").alias("_rep"), F.col("sig").alias("_sig"))
    texts = docs.join(F.broadcast(chosen) if few else chosen, F.col("doc_id") == F.col("_rep")).select("_rep", "_sig", "text")

    def deal(batches):
        for batch in batches:
            rep, sig = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            parts, held = [], 0
            for row, tokens in shingle_sets(batch.column(2), size):
                if _signature(tokens) == sig[row]:
                    rows = np.empty(len(tokens), _POSTING)
                    rows["t"], rows["s"] = tokens, U(int(rep[row]) & (2**64 - 1))
                    parts.append(rows)
                    held += len(rows)
                    if held >= COMBINED:
                        every = np.concatenate(parts)
                        yield from packed.dealt((every["t"] % U(buckets)).astype(np.int64), every, 0)
                        parts, held = [], 0
            if parts:
                every = np.concatenate(parts)
                yield from packed.dealt((every["t"] % U(buckets)).astype(np.int64), every, 0)

    back = np.dtype([("s", "<u8"), ("t", "<u8"), ("df", "<u4")])

    def weigh(batches):
        parts, held = [], 0
        for _, found in packed.grouped(batches):
            rows = np.frombuffer(found[0], _POSTING)
            t, s, live, first = _live_runs(rows["t"], rows["s"])
            df = np.repeat(np.diff(np.concatenate([first, [len(t)]])), np.diff(np.concatenate([first, [len(t)]])))
            out = np.empty(int(live.sum()), back)
            out["s"], out["t"], out["df"] = s[live], t[live], df[live]
            parts.append(out)
            held += len(out)
            if held >= COMBINED:
                every = np.concatenate(parts)
                yield from packed.dealt((every["s"] % U(buckets)).astype(np.int64), every, 0)
                parts, held = [], 0
        if parts:
            every = np.concatenate(parts)
            yield from packed.dealt((every["s"] % U(buckets)).astype(np.int64), every, 0)

    def choose(batches):
        for _, found in packed.grouped(batches):
            if 0 not in found or 2 not in found:
                continue
            rows, heads = np.frombuffer(found[0], back), np.frombuffer(found[2], "<i8").reshape(-1, 2)
            size_of = dict(heads.tolist())
            rows = rows[np.argsort(rows["s"], kind="stable")]
            first, length = wordhash.runs(rows["s"])
            out = []
            for f, k in zip(first, length):
                rep = int(rows["s"][f].astype(np.int64))
                n = size_of[rep]
                own = rows[f : f + k]
                left = n - _need(n, percent) + 1 - (n - k)
                if left > 0:
                    rare = own["t"][np.lexsort((own["t"], own["df"]))[:left]]
                    out.append((rep, n, np.sort(own["t"]).tobytes(), rare.astype(np.int64)))
            if out:
                a, b, c, d = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary()), pa.array(d, pa.list_(pa.int64()))],
                    ["rep", "n", "tokens", "prefix"],
                )

    def headers(batches):
        for batch in batches:
            heads = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1).astype("<i8")
            yield from packed.dealt((heads[:, 0].astype(U) % U(buckets)).astype(np.int64), heads, 2)

    weighed = packed.by_bucket(texts.mapInArrow(deal, packed.BLOCKS)).mapInArrow(weigh, packed.BLOCKS)
    heads = survivors.select("rep", "n").mapInArrow(headers, packed.BLOCKS)
    return packed.by_bucket(weighed.union(heads)).mapInArrow(choose, "rep long, n long, tokens binary, prefix array<long>")


def _similar(na: int, a: np.ndarray, nb: int, b: np.ndarray, percent: int) -> bool:
    """The exact test, after the orders that a candidate was not found by."""
    least = _overlap(na, nb, percent)
    if min(len(a), len(b)) < least:
        return False
    for order in (slice(None), slice(None, None, -1)):
        # Tokens found nowhere else count as the first of any order.
        if not np.isin(a[order][: len(a) - least + 1], b[order][: len(b) - least + 1]).any():
            return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (na + nb - both)


def verified(pairs: DataFrame, kept: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b) that are similar enough."""

    def run(batches):
        for batch in batches:
            a, na, ta, b, nb, tb = (batch.column(k) for k in range(6))
            ok = [
                _similar(x, np.frombuffer(p.as_buffer(), U), y, np.frombuffer(q.as_buffer(), U), percent)
                for x, p, y, q in zip(na.to_pylist(), ta, nb.to_pylist(), tb)
            ]
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda x: kept.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "na", "ta", "b", "nb", "tb")
    return both.mapInArrow(run, "a long, b long")


class _Block:
    """Sets of a block: their tokens, flat, and the parts that may hold the first shared one by hash from either end."""

    def __init__(self, rows: list[dict], percent: int) -> None:
        arrays = [np.frombuffer(r["tokens"], U) for r in rows]
        self.c = np.array([r["c"] for r in rows])
        self.n, self.pos = np.array([r["n"] for r in rows]), np.array([r["pos"] for r in rows])
        self.size = np.array([len(v) for v in arrays])
        self.offset = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.vocab, self.at = np.unique(np.concatenate(arrays), return_inverse=True)
        head = np.clip(self.size - _need(self.n, percent) + 1, 1, self.size)
        self.first = np.concatenate([[0], np.cumsum(head)[:-1]])
        step = np.arange(head.sum()) - np.repeat(self.first, head)
        self.low = self.at[np.repeat(self.offset, head) + step]
        self.high = self.at[np.repeat(self.offset + self.size - 1, head) - step]

    def similar(self, q: dict, percent: int) -> np.ndarray:
        """The components of the block's sets that are similar to q and of another component."""
        own = np.frombuffer(q["tokens"], U)
        least = _overlap(self.n, q["n"], percent)
        fits = (self.c != q["c"]) & (self.pos <= self.n - least) & (q["pos"] <= q["n"] - least) & (np.minimum(self.size, len(own)) >= least)
        if not fits.any():
            return self.c[:0]
        spot = np.minimum(np.searchsorted(self.vocab, own), len(self.vocab) - 1)
        known = self.vocab[spot] == own
        head = max(1, len(own) - _need(q["n"], percent) + 1)
        for part, there in ((self.low, slice(None, head)), (self.high, slice(-head, None))):
            mark = np.zeros(len(self.vocab), bool)
            mark[spot[there][known[there]]] = True
            fits &= np.logical_or.reduceat(mark[part], self.first)
        chosen = np.flatnonzero(fits)
        if not len(chosen):
            return self.c[:0]
        mark = np.zeros(len(self.vocab), np.int32)
        mark[spot[known]] = 1
        size = self.size[chosen]
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        flat = np.repeat(self.offset[chosen] - begin, size) + np.arange(size.sum())
        both = np.add.reduceat(mark[self.at[flat]], begin)
        return self.c[chosen[100 * both >= percent * (self.n[chosen] + q["n"] - both)]]


def _blocked(mixed: DataFrame, kept: DataFrame, hot: DataFrame, percent: int) -> DataFrame:
    """Links between components, as (a, b) of their names, in large groups: blocks of classes outside a
    group's largest component against blocks of its classes of fitting size."""
    base = 100.5 / percent
    rows = mixed.withColumn("band", F.floor(F.log("n") / F.log(F.lit(base))).cast("int"))
    main = rows.groupBy("t", "c").agg(F.count(F.lit(1)).alias("_k")).groupBy("t").agg(F.max_by("c", F.struct("_k", "c")).alias("_main"))
    rows = rows.join(_spread(main, hot), ["t", "z"])
    parts = lambda w: F.ceil(F.coalesce(F.sum(w), F.lit(0)) / BLOCK_TOKENS).cast("int")
    count = written(
        rows.groupBy("t", "band").agg(parts(F.col("n")).alias("_every"), parts(F.when(F.col("c") != F.col("_main"), F.col("n"))).alias("_asks")), "block-counts"
    )
    rows = rows.join(_spread(count, hot), ["t", "band", "z"]).join(kept.select("rep", "tokens"), "rep")
    body = F.collect_list(F.struct("rep", "c", "n", "pos", "tokens"))
    block = lambda of: F.pmod(F.xxhash64("rep"), F.greatest(F.col(of), F.lit(1))).cast("int")
    every = rows.groupBy("t", F.col("band").alias("_band"), block("_every").alias("_blk")).agg(body.alias("x"))
    asks = rows.where("c <> _main").groupBy("t", "band", block("_asks").alias("_q")).agg(body.alias("y"))
    # Sets of fitting size lie in the same or in neighbouring bands.
    numbers = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    near = F.explode(F.array(*(F.col("band") + d for d in (-1, 0, 1))))
    pairs = (
        count.where("_asks > 0").select("t", "band", numbers("_asks").alias("_q")).withColumn("_band", near)
        .join(count.select("t", F.col("band").alias("_band"), numbers("_every").alias("_blk")), ["t", "_band"])
    )

    def run(batches):
        top: dict[int, int] = {}

        def root(c: int) -> int:
            while top.setdefault(c, c) != c:
                top[c] = top[top[c]]
                c = top[c]
            return c

        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                x, y = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                block = _Block(x, percent)
                for q in y:
                    # Of the links found, those that join what this task has not joined yet say it all.
                    for c in np.unique(block.similar(q, percent)).tolist():
                        a, b = root(q["c"]), root(c)
                        if a != b:
                            top[max(a, b)] = min(a, b)
                            out.append((q["c"], c))
            if out:
                a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return pairs.join(asks, ["t", "band", "_q"]).join(every, ["t", "_band", "_blk"]).select("x", "y").mapInArrow(run, "a long, b long").distinct()


def _labelled(posts: DataFrame, labels: DataFrame | None) -> DataFrame:
    """posts(t, z, rep, n, ..) with c, the component so far."""
    if labels is None:
        return posts.withColumn("c", F.col("rep"))
    own = labels.select(F.col("node").alias("rep"), F.col("component").alias("c"))
    return posts.join(own, "rep", "left").withColumn("c", F.coalesce("c", "rep"))


def _fits(percent: int):
    """Whether two sets, of n and n2 with the token at pos and pos2, may be similar enough and have it in both prefixes."""
    least = F.expr(f"({percent} * (n + n2) + {99 + percent}) div {100 + percent}")
    return (F.col("pos") <= F.col("n") - least) & (F.col("pos2") <= F.col("n2") - least)


def _postings(kept: DataFrame, percent: int) -> DataFrame:
    """(t, rep, n, pos, lo, hi): prefix tokens with their place in the rarest-first order and the sizes of partners."""
    live = (F.octet_length("tokens") / 8).cast("long")
    rows = kept.select("rep", "n", (F.col("n") - live).alias("_dead"), F.posexplode("prefix").alias("_j", "t"))
    rows = rows.select("t", "rep", "n", (F.col("_dead") + F.col("_j")).alias("pos"))
    lo, most = F.expr(f"({percent} * n + 99) div 100"), F.expr(f"({100 + percent} * (n - pos)) div {percent} - n")
    return rows.withColumn("lo", lo).withColumn("hi", F.least(most, F.expr(f"(100 * n) div {percent}"))).where("hi >= lo")


def _spread(by_token: DataFrame, hot: DataFrame) -> DataFrame:
    """by_token(t, ..) once for each way z in which the token's rows are dealt out."""
    ways = F.sequence(F.lit(0), F.coalesce(F.col("ways"), F.lit(1)) - 1)
    return by_token.join(hot, "t", "left").withColumn("z", F.explode(ways)).drop("ways")


def class_links(kept: DataFrame, percent: int) -> DataFrame:
    """(node, component) of classes with a link; every link across components was looked for."""
    posts = written(_postings(kept, percent), "prefixes")
    hot = written(
        posts.groupBy("t").agg(F.ceil(F.count(F.lit(1)) / HOT_ROWS).cast("int").alias("ways")).where("ways > 1"), "hot-tokens"
    )
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_HOT else hot
    way = F.pmod(F.xxhash64("rep"), F.coalesce(F.col("ways"), F.lit(1))).cast("int")
    posts = posts.join(hot, "t", "left").withColumn("z", way).drop("ways")
    links, labels = None, None
    for k in range(LEADER_ROUNDS):
        at = _labelled(posts, labels)
        lead = at.groupBy("t").agg(
            F.min_by(
                F.struct(F.col("rep").alias("a"), F.col("c").alias("c2"), F.col("n").alias("n2"), F.col("pos").alias("pos2")),
                F.xxhash64("rep", F.lit(k)),
            ).alias("_l"),
            F.min("c").alias("_c0"),
            F.max("c").alias("_c1"),
        ).where("_c0 <> _c1").select("t", "_l.*")
        pairs = (
            at.join(_spread(lead, hot), ["t", "z"])
            .where((F.col("c") != F.col("c2")) & _fits(percent))
            .groupBy(F.col("rep").alias("b"), "a")
            .agg(F.count(F.lit(1)).alias("_k"))
            .groupBy("b")
            .agg(F.max_by("a", F.struct("_k", "a")).alias("a"))
        )
        found = verified(pairs, kept, percent)
        links = written(found if links is None else links.union(found), "found-links")
        labels = components(links)
    at = written(_labelled(posts, labels), "prefixes-labelled")
    groups = at.groupBy("t").agg(
        F.min("c").alias("_c0"), F.max("c").alias("_c1"), F.count(F.lit(1)).alias("_size"), F.min("n").alias("_n0"), F.max("n").alias("_n1")
    ).where("_c0 <> _c1").select("t", "_size", "_n0", "_n1")
    # A class stays in a group only if the group has sizes that its partners may have.
    mixed = written(at.join(_spread(groups, hot), ["t", "z"]).where("lo <= _n1 AND hi >= _n0").select("t", "z", "rep", "n", "pos", "c", "_size"), "mixed")
    small = mixed.where(F.col("_size") <= BLOCKED_FROM)
    other = small.select("t", F.col("rep").alias("a"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("c").alias("c2"))
    pairs = small.join(other, "t").where((F.col("rep") < F.col("a")) & (F.col("c") != F.col("c2")) & _fits(percent)).select(F.col("rep").alias("b"), "a").distinct()
    rest = verified(pairs, kept, percent)
    large = mixed.where(F.col("_size") > BLOCKED_FROM)
    if not large.isEmpty():
        rest = rest.union(_blocked(large, kept, hot, percent))
    last = written(rest, "last-links")
    return labels if last.isEmpty() else components(links.union(last))


def join(docs: DataFrame, size: int = WORDS, percent: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every document.

    class_id: the smallest doc_id with an equal set; component_id: the smallest reachable by links.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = written(sets(docs, size), "sets")
    counted = written(own.groupBy("sig", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("_rows")), "classes")
    classes = counted.drop("_rows")
    survivors = written(prefix_survivors(docs, classes, size, percent), "survivors")
    kept = written(rare_prefixes(docs, survivors, size, percent), "rare-prefixes")
    with arrow_rows(docs.sparkSession, ROWS_AT_ONCE):
        labels = class_links(kept, percent)
    # Rows of a set that many documents have are dealt out in several ways, and its name once for each.
    ways = counted.where(F.col("_rows") > HOT_ROWS).select("sig", "n", F.ceil(F.col("_rows") / HOT_ROWS).cast("int").alias("ways"))
    ways = F.broadcast(ways) if ways.count() <= BROADCAST_HOT else ways
    several = F.coalesce(F.col("ways"), F.lit(1))
    named = (
        classes.where("n > 0").join(labels, F.col("rep") == F.col("node"), "left")
        .join(ways, ["sig", "n"], "left")
        .select("sig", "n", F.explode(F.sequence(F.lit(0), several - 1)).alias("_way"), "rep", F.coalesce("component", "rep").alias("component"))
    )
    dealt = own.join(ways, ["sig", "n"], "left").withColumn("_way", F.pmod(F.xxhash64("doc_id"), several).cast("int"))
    return dealt.join(named, ["sig", "n", "_way"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("rep", "doc_id").alias("class_id"),
        F.coalesce("component", "doc_id").alias("component_id"),
    )
