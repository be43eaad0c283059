import re

from pyspark.sql import functions as F

from quarry.llm import decontam

from .common import clashing, empty, frame, lower

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def expected(docs, items, size=13):
    asked = [(i, WORD.findall(lower(t))) for i, t in items]
    out = {}
    for doc, text, *_ in docs:
        w, hit, ids = WORD.findall(lower(text)), set(), set()
        for i, iw in asked:
            n = min(size, len(iw))
            for a in range(len(iw) - n + 1) if iw else ():
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == iw[a : a + n]:
                        hit |= set(range(b, b + n))
                        ids.add(str(i))
        out[doc] = (len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w))
    return out


ITEM = "The quick Brown fox, jumps over 12 lazy dogs while Émile and ÉMILE watch them from far away"
OTHER = "short item here"
DOCS = [
    (1, f"Before it. {ITEM}! After.", None, None, 0),
    (2, "word " * 400 + ITEM.upper().replace("É", "É"), None, None, 0),
    (3, ITEM.replace("fox", "cat"), None, None, 0),
    (4, "a Short, item here; and short item HERE short item", None, None, 0),
    (5, None, None, None, 0),
    (6, "... !", None, None, 0),
    (7, ITEM + " " + ITEM, None, None, 0),
    (8, ITEM.replace("Émile", "émile"), None, None, 0),
    (9, "KK " + ITEM, None, None, 0),
]
ITEMS = [(10, ITEM), (9, OTHER), (11, OTHER), (12, None), (13, "--")]


def got(spark, docs, items):
    df = decontam.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    return {r.doc_id: (r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in df.collect()}


def test_matches_brute_force(spark):
    assert got(spark, frame(spark, DOCS), ITEMS) == expected(DOCS, ITEMS)


def test_shuffles_beyond_the_broadcast_bounds(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_TERMS", 0)
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    assert got(spark, frame(spark, DOCS), ITEMS) == expected(DOCS, ITEMS)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(1, ITEM, None, None, 0), (1, ITEM, None, None, 0), (None, ITEM, None, None, 0), (None, "clean", None, None, 0)]
    df = clashing(frame(spark, rows), "n_words", "matches", "n_hit", "item_ids")
    out = decontam.contamination(df, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    n = len(WORD.findall(ITEM))
    assert sorted((r.doc_id or -1, r.n_hit) for r in out) == [(-1, 0), (-1, n), (1, n), (1, n)]


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.contamination(empty(spark), items).collect() == []
    none = decontam.contamination(frame(spark, DOCS), items.where("false")).collect()
    assert len(none) == len(DOCS) and not any(r.contaminated for r in none)


def test_proximity(spark):
    docs = frame(spark, [(1, "alpha x beta y gamma", None, None, 0), (2, "alpha " + "z " * 20 + "beta gamma", None, None, 0), (3, "gamma Beta Alpha", None, None, 0)])
    asked = spark.createDataFrame([(1, ["Alpha", "beta", "gamma"])], "query_id int, terms array<string>")
    assert {(r.doc_id, r.start) for r in decontam.proximity_matches(docs, asked, slop=2).collect()} == {(1, 0), (3, 0)}


def test_no_python_on_the_main_path(spark):
    df = decontam.contamination(frame(spark, DOCS), spark.createDataFrame(ITEMS, "item_id long, text string").where(F.lit(True)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
