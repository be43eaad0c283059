import re

import numpy as np

from quarry.llm import quality, textcols

from .common import awkward, clashing, empty, frame, words


def expected(text):
    t, w = text or "", words(text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {x for x in tri if tri.count(x) > 1} if len(tri) < 400 else {x for x in set(tri) if tri.count(x) > 1}
    covered = {i + k for i, x in enumerate(tri) if x in twice for k in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


ROWS = awkward() [:60] + [
    (100, "a a a a", None, None, 0), (101, "a b a b a b", None, None, 0), (102, "x y z q x y z", None, None, 0), (103, "l1 é\nl1 é\n \n \nl2\nl1 é", None, None, 0),
    (104, "# a * b $ % & | < >\r\n#", None, None, 0), (105, "one two", None, None, 0), (106, None, None, None, 0), (107, "", None, None, 0), (108, "w " * 5000, None, None, 0),
]


def test_statistics(spark):
    got = {r.doc_id: tuple(r[k] for k in quality.BASE) for r in quality.statistics(frame(spark, ROWS)).collect()}
    assert got == {d: expected(t) for d, t, *_ in ROWS}


def test_windows_of_a_very_long_text_are_told_apart(spark):
    text = " ".join(map(str, range(1_100_000)))
    r = quality.statistics(frame(spark, [(1, text, None, None, 0)])).first()
    assert (r.n_words, r.n_repeat_words) == (1_100_000, 0)


def test_covering_finds_planted_rules():
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.uniform(0, 100, 3000), rng.uniform(0, 1, 3000), rng.uniform(0, 1, 3000)])
    junk = ((x[:, 0] > 80) & (x[:, 1] > 0.5)) | (x[:, 2] > 0.9)
    rules = quality.cover(x, junk, ["n_words", "repeat_share", "symbols_per_word"])
    hit = np.zeros(3000, bool)
    for r in rules:
        hit |= quality._covers(r.conditions, x, ["n_words", "repeat_share", "symbols_per_word"])
    assert (hit == junk).mean() > 0.98 and len(rules) <= 6


def test_learned_list_is_a_spark_conditional(spark):
    good = [(i, " ".join(f"w{(i * 7 + k) % 997}" for k in range(80)), None, None, 0) for i in range(120)]
    bad = [(200 + i, " ".join(f"w{(i * 7 + k) % 997}$$$" for k in range(80)), None, None, 0) for i in range(60)]
    docs = frame(spark, good + bad)
    labels = spark.createDataFrame([(d, int(d < 200), 0) for d, *_ in good + bad] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rules = quality.learn(docs, labels)
    assert rules and all(isinstance(c.bound, float) for r in rules for c in r.conditions)
    got = {r.doc_id: r.kept for r in quality.judged(docs, rules).collect()}
    assert sum(got[d] for d, *_ in good) >= 118 and sum(got[d] for d, *_ in bad) <= 2
    plan = quality.judged(docs, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_base_rules_hold_without_labels(spark):
    docs = frame(spark, ROWS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.learn(docs, labels) == []
    got = {r.doc_id: r.kept for r in quality.judged(docs, []).collect()}
    assert not got[106] and not got[107] and not got[108] and got[0] == (expected(ROWS[0][1])[0] >= 50)


def test_empty_clashing_and_held_filter(spark):
    assert quality.judged(empty(spark), []).collect() == []
    df = clashing(frame(spark, ROWS), "n_words", "kept", "base_failed")
    judged = quality.judged(df, [])
    from pyspark.sql import functions as F

    assert textcols.where_computed(judged, F.col("kept")).count() == sum(r.kept for r in judged.collect())
