import hashlib

import numpy as np
import pyarrow as pa

from quarry.llm import recompress, wordhash

from .common import awkward, clashing, empty, frame, words


def expected(rows, size):
    seen, out = {}, {}
    for doc, text, *_ in rows:
        w = words(text)
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            seen[key] = min(doc, seen.get(key, doc))
    for doc, text, *_ in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] < doc:
                gone |= set(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[doc] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def got(df, **o):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in recompress.deduplicated(df, **o).collect()}


def test_matches_all_windows(spark):
    rows = awkward(n=100)
    want = expected(rows, 50)
    assert sum(x[1] for x in want.values()) > 500
    assert got(frame(spark, rows)) == want


def test_short_windows_and_small_batches(spark, monkeypatch):
    monkeypatch.setattr(recompress, "COMBINED", 64)
    rows = awkward(seed=2)
    assert got(frame(spark, rows), size=20, rounds=2) == expected(rows, 20)


def test_equal_windows_get_equal_names():
    """A window's key depends on the window alone, whatever stands around it."""
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(12)]
    common = list(rng.choice(vocab, 80))
    texts = [" ".join([*rng.choice(vocab, rng.integers(0, 60)), *common, *rng.choice(vocab, rng.integers(0, 60))]) for _ in range(40)]
    keys = {}
    for text in texts:
        w = text.split()
        for piece in wordhash.pieces(pa.array([text]), False):
            start, key, free = recompress.windows(piece)
            assert len(start) == max(0, len(w) - 49)
            for s, k, f in zip(start, key, free):
                assert keys.setdefault(tuple(w[s : s + 50]), (int(k), bool(f))) == (int(k), bool(f))


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    text = " ".join(f"t{i}" for i in range(60))
    rows = [(1, text, None, None, 0), (2, text, None, None, 0), (2, text, None, None, 0), (None, text, None, None, 0)]
    out = sorted((r.doc_id or -1, r.n_removed) for r in recompress.deduplicated(clashing(frame(spark, rows), "keys", "starts")).collect())
    assert out == [(-1, 0), (1, 0), (2, 60), (2, 60)]


def test_empty_table(spark):
    assert recompress.deduplicated(empty(spark)).collect() == []
