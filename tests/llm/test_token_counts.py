import os

import numpy as np
import pytest

from quarry.llm import token_counts

from .common import awkward, clashing, empty, frame

pytestmark = pytest.mark.skipif(not os.path.exists(token_counts.VOCABULARY), reason="no vocabulary")


def lengths(rows):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_counts.VOCABULARY, "rb"))}
    own = tiktoken.Encoding("own", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return {d: len(own.encode_ordinary(t or "")) for d, t, *_ in rows}


def test_lengths_histogram_and_suffix_sums(spark):
    rows = awkward(n=100)
    want = lengths(rows)
    counted = token_counts.lengths(frame(spark, rows))
    assert {r.doc_id: r.n_tokens for r in counted.collect()} == want
    sums = token_counts.suffix_sums(token_counts.histogram(counted))
    x = np.array(list(want.values()))
    got = {r.n_tokens: r for r in sums.collect()}
    assert set(got) == set(x.tolist()) and max(got) > token_counts.BLOCK
    for n, r in got.items():
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == ((x == n).sum(), (x >= n).sum(), x[x >= n].sum())
        assert (r.truncated_tokens, r.docs_at_most, r.total_docs, r.total_tokens) == (np.minimum(x, n).sum(), (x <= n).sum(), len(x), x.sum())
    limits = [0, 1, 7, 100, 100_000]
    assert {r.context: (r.docs_over, r.truncated_tokens) for r in token_counts.at_limits(sums, limits).collect()} == {
        n: ((x > n).sum(), np.minimum(x, n).sum()) for n in limits
    }
    shares = [0.1, 0.5, 0.9, 1.0]
    assert {r.share: r.n_tokens for r in token_counts.quantiles(sums, shares).collect()} == {s: int(np.sort(x)[int(np.ceil(s * len(x))) - 1]) for s in shares}


def test_empty_nulls_repeats_and_clashing_columns(spark):
    assert token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(empty(spark)))).collect() == []
    rows = [(1, None, None, None, 0), (1, None, None, None, 0), (None, "one", None, None, 0)]
    got = token_counts.histogram(token_counts.lengths(clashing(frame(spark, rows), "n_tokens", "n_docs"))).collect()
    assert {(r.n_tokens, r.n_docs) for r in got} == {(0, 2), (1, 1)}


def test_a_large_vocabulary_is_refused(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "VOCABULARY_BYTES", 10)
    with pytest.raises(ValueError):
        token_counts.vocabulary(spark)
