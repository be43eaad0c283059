import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import ppm

from .common import awkward, clashing, empty, frame, lower, words


def counted(texts):
    out = defaultdict(Counter)
    for t in texts:
        b = b"\0\0\0" + lower(t).encode() + b"\0"
        for i in range(3, len(b)):
            for k in range(4):
                out[b[i - k : i]][b[i]] += 1
    return out


def logp(counts, text, order=3):
    """Prediction by partial matching with exclusion, as it is told."""
    total, b = 0.0, b"\0\0\0" + lower(text).encode() + b"\0"
    for i in range(3, len(b)):
        gone = set()
        for k in range(order, -1, -1):
            seen = counts.get(b[i - k : i])
            if not seen:
                continue
            live = {x: n for x, n in seen.items() if x not in gone}
            if live:
                t, d = sum(live.values()), len(live)
                if b[i] in live:
                    total += math.log10(live[b[i]] / (t + d))
                    break
                total += math.log10(d / (t + d))
            gone |= set(seen)
        else:
            total -= math.log10(256 - len(gone))
    return total


def trie(texts, order):
    codes = np.concatenate([ppm._codes(s, p) for s, p, _, _ in ppm._streams(pa.array(texts))])
    c, n = np.unique(codes if order == 3 else codes & 0xFFFFFF, return_counts=True)
    return ppm.Trie(c, n, order)


@pytest.mark.parametrize("order", [2, 3])
def test_trie_matches_the_method(order):
    train = ["Abracadabra", "banana band", None, "", "é zé é"]
    model, counts = trie(train, order), counted(train)
    tests = ["abracadabra", "bandana zed", "", None, "zzz é", "q"]
    for s, p, t, _ in ppm._streams(pa.array(tests)):
        got = np.bincount(t, model.score(s, p))
    assert got == pytest.approx([logp(counts, x, order) for x in tests], abs=1e-5)
    for table in model.values.values():
        assert np.allclose((10.0 ** table.astype(float)).sum(1), 1, atol=1e-5)


ROWS = awkward(n=80)


def check(spark, rows, df=None, order=3):
    out = {r.doc_id: r for r in ppm.scored(frame(spark, rows) if df is None else df).collect()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, *_ in rows}
    tokens = {d: [*words(lower(t)), None] for d, t, *_ in rows}
    c = Counter(w for d in tokens if not held[d] for w in tokens[d])
    n, v = sum(c.values()), len(c)
    counts = counted([t for d, t, *_ in rows if not held[d]])
    for d, t, *_ in rows:
        r = out[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens[d]), sum(c[w] > 0 for w in tokens[d]), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[d]))
        if len(t or "") < 3000:
            assert r.score == pytest.approx(logp(counts, t, order), rel=1e-4, abs=1e-4)


def test_scores(spark):
    check(spark, ROWS)


def test_rare_words_meet_their_counts_in_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(ppm, "FREQUENT", 4)
    monkeypatch.setattr(ppm, "COMBINED", 256)
    check(spark, ROWS)


def test_held_out_texts_of_the_corpus_are_likelier_than_noise(spark):
    rows = awkward(seed=8, n=100)
    noise = [(1000 + i, " ".join("xqzjkv"[(i + k) % 6] * 4 for k in range(20)), None, None, 0) for i in range(5)]
    out = ppm.scored(frame(spark, rows + noise), train=F.col("doc_id") < 90).collect()
    rate = {r.doc_id: r.score / len((dict((d, t) for d, t, *_ in rows + noise)[r.doc_id] or "").encode() + b"0") for r in out}
    assert min(rate[d] for d in range(90, 100)) > max(rate[d] for d in range(1000, 1005))


def test_empty_repeats_nulls_and_clashing_columns(spark):
    assert ppm.scored(empty(spark)).collect() == []
    rows = [(1, "a b a", None, None, 0), (1, "a b a", None, None, 0), (None, "a b", None, None, 0), (2, None, None, None, 0)]
    out = sorted((r.doc_id or -1, r.n_tokens) for r in ppm.scored(clashing(frame(spark, rows), "score", "rows", "n")).collect())
    assert out == [(-1, 3), (1, 4), (1, 4), (2, 1)]


@pytest.mark.parametrize("most", [0, 10, 150])
def test_three_byte_contexts_at_every_size(spark, monkeypatch, most):
    monkeypatch.setattr(ppm, "BROADCAST_CONTEXTS", most)
    monkeypatch.setattr(ppm.Shard, "CONTEXTS", 7)
    check(spark, ROWS)


def test_rows_without_an_id_are_scored_apart(spark):
    texts = ["x", "completely different longer text here", None, "x"]
    rows = [(None, t, None, None, 0) for t in texts] + [(7, "x", None, None, 0), (7, "y z", None, None, 0), (3, "x y", None, None, 0)]
    out = ppm.scored(frame(spark, rows)).collect()
    assert sorted(r.n_tokens for r in out if r.doc_id is None) == [1, 2, 2, 6]
    assert sorted(r.n_tokens for r in out if r.doc_id == 7) == [2, 3]
    assert len({r.score for r in out if r.n_tokens == 2}) == 1


def test_codes_bound_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ppm, "BROADCAST_CODES", 200)
    check(spark, ROWS)
