import math
import random
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.llm import langid
from quarry.llm.queries import op8_language_id

from .common import clashing, empty, frame

SF = "/root/testdata/sf0.01"


def corpus(n=60, seed=1):
    r = random.Random(seed)
    parts = {"de": ["sch", "ung", "ein", "der", "ü"], "fr": ["eau", "oi", "les", "qu", "é"], "en": ["th", "ing", "the", "wh", "ed"]}
    rows = []
    for i in range(n):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 4))) for _ in range(40)), lang, None, 0))
    return rows


def test_held_out_accuracy(spark):
    rows = op8_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert len(held) > 100 and sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_unseen_words_back_off(spark):
    model = langid.fit(frame(spark, corpus()))
    assert model.langs == ["de", "en", "fr"]
    assert model.predict("Schungschein schungderung")[0] == "de" and model.predict("eauqueaules")[0] == "fr"
    assert "schungscheinungder" not in model.words.index
    assert model.predict("ЖЖЖ")[0] == "de"


def test_und_nulls_repeats_and_clashing_columns(spark):
    rows = corpus() + [(100, None, "de", None, 0), (101, "12 34 --", "de", None, 0), (102, "", None, None, 0), (103, "the ing", None, None, 0), (103, "the ing", None, None, 0), (None, "eau les", None, None, 0)]
    df = clashing(frame(spark, rows), "word", "n", "score")
    out = [(r.doc_id, r.lang_pred, r.score) for r in langid.predicted(df, langid.fit(df)).collect()]
    assert {d for d, p, s in out if p == "und" and s == 0} == {100, 101, 102}
    assert sum(d == 103 for d, _, _ in out) == 2 and [p for d, p, _ in out if d is None] == ["fr"]


def test_nothing_learned_and_empty_table(spark):
    model = langid.fit(frame(spark, corpus()).where(F.lit(False)))
    assert {r.lang_pred for r in langid.predicted(frame(spark, corpus()), model).collect()} == {"und"}
    assert langid.predicted(empty(spark), model).collect() == []


def letters(text):
    return "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower()).split()


def brute(train, texts):
    """(language, score) by the method's definition, on dictionaries."""
    langs = sorted({x for _, x in train})
    words, grams = {x: Counter() for x in langs}, {(x, n): Counter() for x in langs for n in langid.LENGTHS}
    for text, lang in train:
        for w in letters(text):
            words[lang][w] += 1
            for n in langid.LENGTHS:
                for i in range(len(w) + 3 - n):
                    if f" {w} "[i : i + n] != " ":
                        grams[lang, n][f" {w} "[i : i + n]] += 1
    cost = lambda counts, key: min(langid.PENALTY, -math.log10(counts[key] / counts.total())) if counts[key] else langid.PENALTY

    def of(w):
        if any(w in words[x] for x in langs):
            return [cost(words[x], w) for x in langs]
        for n in langid.LENGTHS:
            cut = [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]
            seen = [g for g in cut if any(g in grams[x, n] for x in langs)]
            if seen:
                return [sum(cost(grams[x, n], g) for g in seen) / len(seen) for x in langs]
        return None

    for text in texts:
        if not letters(text):
            yield "und", 0.0
            continue
        costs = [c for c in map(of, letters(text)) if c]
        mean = [sum(c[k] for c in costs) / len(costs) for k in range(len(langs))] if costs else [0.0] * len(langs)
        best = min(range(len(langs)), key=lambda k: mean[k])
        yield langs[best], 1 / sum(10 ** (mean[best] - m) for m in mean)


def test_agrees_with_brute_force(spark):
    rows = corpus() + [(200, "Überflüßig THE éaux", "de", None, 0), (201, "x\u00b2y \u2167 z", "fr", None, 0)]
    texts = [t for _, t, *_ in corpus(30, seed=9)] + ["the ungschein zzz", "\u00b2\u00bd \u2154", "a\u00b2b", "\u2167", "", None, "ЖЖЖ the", "q"]
    model = langid.fit(frame(spark, rows))
    for got, want in zip((model.predict(t) for t in texts), brute([(t, x) for _, t, x, *_ in rows], texts), strict=True):
        assert got[0] == want[0] and got[1] == pytest.approx(want[1])


def test_sample_is_bounded_and_reaches_every_language(spark):
    rows = [(1 if i % 2 else None, "same words", "hot", None, 0) for i in range(400)] + [(i, f"word{i} the", "hot", None, 0) for i in range(100)]
    rows += [(1000, "lone text", "rare", None, 0), (1001, "z" * 5000, "long", None, 0)]
    got = [(r.lang, r.text) for r in langid.sample(frame(spark, rows), 20, 64 * 1000).collect()]
    assert len(got) == len(set(got)) <= 20 and ("rare", "lone text") in got and not any(x == "long" for x, _ in got)
    assert sum(x == "hot" for x, _ in got) >= 5
    assert sum(len(t) for _, t in langid.sample(frame(spark, rows), 500, 640).collect()) <= 640
