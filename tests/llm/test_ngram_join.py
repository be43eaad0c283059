import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import ngram_join, wordhash

from .common import awkward, clashing, empty, frame, lower, words


def expected(rows):
    sets, ids = {}, defaultdict(set)
    for doc, text, *_ in rows:
        w = words(lower(text))
        sets[doc] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    top = {d: d for d in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    docs = sorted(d for d in sets if sets[d])
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()}


def test_matches_all_pairs(spark):
    rows = awkward(n=120)
    assert got(frame(spark, rows)) == expected(rows)


def test_borderline_chain_in_a_large_group(spark, monkeypatch):
    """Near copies that link only through each other, some groups compared in blocks."""
    monkeypatch.setattr(ngram_join, "BLOCKED_FROM", 6)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 400)
    monkeypatch.setattr(ngram_join, "HOT_ROWS", 5)
    monkeypatch.setattr(ngram_join, "LEADER_ROUNDS", 1)
    r = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(60):
        text = list(base)
        for _ in range(r.randint(0, 6)):
            text[r.randrange(100)] = f"x{r.randrange(500)}"
        rows.append((i, " ".join(text), None, None, 0))
    found = got(frame(spark, rows))
    assert found == expected(rows)
    assert 1 < len({c for _, c in found.values()}) < 60


@pytest.mark.parametrize("rounds", [1, 2])
def test_groups_of_many_sizes_in_blocks(spark, monkeypatch, rounds):
    """Texts of many lengths around shared passages: similarity on both sides of the bound, in blocks and bands."""
    monkeypatch.setattr(ngram_join, "BLOCKED_FROM", 3)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 150)
    monkeypatch.setattr(ngram_join, "HOT_ROWS", 4)
    monkeypatch.setattr(ngram_join, "BROADCAST_HOT", 0)
    monkeypatch.setattr(ngram_join, "LEADER_ROUNDS", rounds)
    r = random.Random(rounds)
    rows = []
    for i in range(150):
        body = [f"p{i % 3}w{k}" for k in range(r.randint(20, 60))]
        rows.append((i, " ".join(body + [f"x{r.randrange(40)}" for _ in range(r.randint(0, 14))]), None, None, 0))
    found = got(frame(spark, rows))
    assert found == expected(rows)
    assert 3 < len({c for _, c in found.values()}) < 140


def test_a_common_passage_below_the_bound_forms_no_group(spark):
    """Texts that share 36 of 44 shingles, 0.69: in the rarest-first order none has a partner of its size."""
    texts = [" ".join([f"c{k}" for k in range(40)] + [f"u{i}x{k}" for k in range(8)]) for i in range(400)]
    docs = frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])
    found = got(docs)
    assert {n for n, _ in found.values()} == {44} and len({c for _, c in found.values()}) == 400
    classes = ngram_join.sets(docs).select("sig", "n", F.col("doc_id").alias("rep"))
    kept = ngram_join.rare_prefixes(docs, classes, 5, 75)
    posts = ngram_join._postings(kept, 75)
    assert posts.count() > 0 and posts.where("hi >= 44").count() == 0


def test_joins_by_shuffle_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    rows = awkward(seed=9)
    assert got(frame(spark, rows)) == expected(rows)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(1, "a b c d e f", None, None, 0), (1, "a b c d e f", None, None, 0), (None, "a b c d e f", None, None, 0), (2, "A b c d e f", None, None, 0)]
    out = ngram_join.join(clashing(frame(spark, rows), "n", "sig", "rep")).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in out) == [(-1, 1), (1, 1), (1, 1), (2, 1)]


def test_empty_table(spark):
    assert ngram_join.join(empty(spark)).collect() == []


@pytest.mark.parametrize("lower_case", [True, False])
def test_word_hashes_follow_content(lower_case):
    texts = ["Hello World hello\tworld", None, "", " a ", "x", "é É b\x0bB", " lead", "trail ", "ab", "a b"]
    names = {}
    for piece in wordhash.pieces(pa.array(texts), lower_case):
        found = [bytes(piece.raw[s:e]).decode() for s, e in zip(piece.starts, piece.ends)]
        assert found == [w for t in texts for w in words(t)]
        for w, h in zip(found, piece.hashes):
            assert names.setdefault(lower(w) if lower_case else w, h) == h
    assert len(set(names.values())) == len(names)
