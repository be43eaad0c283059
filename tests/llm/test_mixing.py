import pytest
from pyspark.sql import functions as F

from quarry.llm import mixing

from .common import awkward, clashing, empty, frame, words


def filled(sizes, epochs=3.0):
    """Water-filling as it is told: share, stop, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if target[s] + left * weight[s] / total >= epochs * sizes[s]}
        if not over:
            for s in open_:
                target[s] += left * weight[s] / total
            break
        for s in over:
            left -= epochs * sizes[s] - target[s]
            target[s] = epochs * sizes[s]
        rest = sum(target[s] for s in open_ - over)
        left += rest
        for s in open_ - over:
            target[s] = 0.0
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1, "c": 1, None: 100}, {"a": 5}, {"a": 0, "b": 7}, {"x": 1, "y": 1, "z": 1000, "zz": 2}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.water_fill(mixing.cycle_weights(df)).collect()}
    assert got == pytest.approx(filled(sizes))


def test_taken_words(spark):
    rows = awkward(n=200)
    first, again = (sorted(map(tuple, mixing.mix(frame(spark, rows)).select("doc_id", "size", "taken", "target", "source").collect())) for _ in range(2))
    assert first == again
    assert {r[0]: r[1] for r in first} == {d: len(words(t)) for d, t, *_ in rows}
    assert all(t <= 3 * s for _, s, t, _, _ in first)
    for source in {r[4] for r in first}:
        own = [r for r in first if r[4] == source]
        assert abs(sum(r[2] for r in own) - own[0][3]) <= 3 * len(own) ** 0.5


def test_expanded_mix_has_the_words_taken(spark):
    mixed = mixing.mix(frame(spark))
    want = {r.doc_id: r.taken for r in mixed.collect() if r.taken}
    got = {}
    for r in mixing.expanded(mixed).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(words(r.text))
    assert {k: v for k, v in got.items() if v} == want


def test_given_weights_leave_out_a_source(spark):
    weights = spark.createDataFrame([("s1", 1), ("s2", 0)], "source string, weight int")
    rows = mixing.mix(frame(spark), weights=weights).groupBy("source").agg(F.sum("taken").alias("n")).collect()
    got = {r.source: r.n for r in rows}
    assert got["s2"] == 0 and got[None] == 0 and got["s1"] > 0


def test_empty_nulls_and_clashing_columns(spark):
    assert mixing.mix(empty(spark)).collect() == []
    rows = [(None, None, None, None, 0), (None, "a b", None, None, 0), (1, "a b", None, "s", 0), (1, "a b", None, "s", 0)]
    out = mixing.mix(clashing(frame(spark, rows), "size", "target", "taken", "weight", "repeats")).collect()
    assert len(out) == 4 and all(r.taken <= 3 * r.size for r in out)
