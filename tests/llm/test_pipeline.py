import pytest

from quarry.llm import quality, queries

from .common import clashing, lower, words
from .test_decontam import WORD
from .test_decontam import expected as contaminated
from .test_mixing import filled
from .test_quality import expected as statistics
from .test_secrets import base

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def brute_components(docs):
    """The smallest reachable id of each document, from all pairs of shingle sets."""
    sets, top = {}, {}
    for i, text in docs.items():
        w = words(lower(text))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        top[i] = i

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in docs:
        for j in docs:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = root(i), root(j)
                    top[max(a, b)] = min(a, b)
    return {i: root(i) for i in docs}


def brute_stages(docs, rules, items):
    """What each stage keeps of docs: {id: (text, source)}, by plain definitions and without the operators."""
    size = lambda x, w: {"n_words": w[0], "n_symbols": w[2], "n_dup_lines": w[3], "mean_word_chars": w[1] / max(w[0], 1), "symbols_per_word": w[2] / max(w[0], 1), "dup_lines_per_word": w[3] / max(w[0], 1), "repeat_share": w[4] / max(w[0], 1)}[x]

    def junk(text):
        w = statistics(text)
        fires = lambda r: all(size(c.feature, w) >= c.bound if c.op == ">=" else size(c.feature, w) <= c.bound for c in r.conditions)
        return w[0] < 50 or 100 * w[4] > 50 * w[0] or any(map(fires, rules))

    docs = {i: x for i, x in docs.items() if not junk(x[0])}
    yield docs
    component = brute_components({i: t for i, (t, _) in docs.items()})
    docs = {i: x for i, x in docs.items() if component[i] == i}
    yield docs
    hit = contaminated([(i, t) for i, (t, _) in docs.items()], items)
    spans = {tuple(w[k : k + 13]) for _, t in items for w in [WORD.findall(lower(t))] for k in range(len(w) - 12)}
    whole = lambda t: any(tuple(w[k : k + 13]) in spans for w in [WORD.findall(lower(t))] for k in range(len(w) - 12))
    docs = {i: x for i, x in docs.items() if not hit[i][3] and not whole(x[0])}
    yield docs


def test_stages_agree_with_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rules = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    ids, columns = lambda d: {r.doc_id: r.text for r in d.select("doc_id", "text").collect()}, docs.columns
    before = {}
    for (name, stage), want in zip(corpus_pipeline.STAGES, brute_stages(plain, rules, items)):
        out = stage(spark, docs, SF)
        assert ids(out) == {i: t for i, (t, _) in want.items()}, name
        assert out.columns == columns
        docs, before = spark.createDataFrame(out.collect(), out.schema), want
    safe = corpus_pipeline.STAGES[3][1](spark, docs, SF)
    texts = ids(safe)
    assert texts.keys() == before.keys() and safe.columns == columns
    for i, (text, _) in before.items():
        # What is left has no plain secret, and other characters stand as they were.
        assert not base(texts[i]) and (base(text) or "%" in text or "\\" in text or len(text) > 16) or texts[i] == text
        assert base(text) or not any(k in texts[i] for k in ("[assign]", "[access]", "[hex]")) or texts[i] != text
    mix = corpus_pipeline.STAGES[4][1](spark, spark.createDataFrame(safe.collect(), safe.schema), SF).collect()
    sizes = {}
    for i, (_, source) in before.items():
        sizes[source] = sizes.get(source, 0) + len(words(texts[i]))
    target = filled(sizes)
    assert {r.doc_id for r in mix} == before.keys()
    for source in sizes:
        own = [r for r in mix if r.source == source]
        assert sum(r.taken for r in own) == pytest.approx(target[source], abs=len(own) + 1)
        assert all(r.taken <= 3 * r["size"] for r in own)


def test_planted_passages_go_however_long_the_document_is(spark, tmp_path):
    passage = " ".join(f"planted{k}" for k in range(20))
    filler = lambda seed, n: " ".join(f"w{(seed * 7919 + k * k) % 9973}x" for k in range(n))
    rows = [(i, f"{filler(i, 4000)} {part} {filler(i + 50, 4000)}") for i, part in enumerate([passage, passage.upper(), " ".join(passage.split()[3:16]), " ".join(passage.split()[:12]), "clean"])]
    rows += [(9, "tiny item in a long text " + filler(9, 500)), (10, "tiny item")]
    spark.createDataFrame([(1, passage), (2, "tiny item")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.uncontaminated(spark, docs, f"file://{tmp_path}").collect()}
    assert kept == {3, 4, 9}


def test_run_agrees_with_its_stages(spark):
    a = sorted((r.doc_id, r.taken) for r in corpus_pipeline.run(spark, SF).collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert a == sorted((r.doc_id, r.taken) for r in docs.collect())


def test_awkward_documents_pass_through_every_stage(spark, tmp_path):
    """Nulls, ties, an empty and a very long text, and columns of names that the operators use; an empty table."""
    long = " ".join(f"w{k * k % 99991}" for k in range(30_000))
    twice = " ".join(f"t{k}" for k in range(80))
    rows = [(None, None, None, None, None), (None, "w " * 3, "en", "s", 1), (1, None, None, None, None), (1, None, None, None, None), (2, long, "en", None, 0), (3, "", "en", "s", 0)]
    rows += [(5, twice, "en", "s", 1), (5, twice, "en", "s", 1), (5, twice + " end", "en", "s", 1), (6, twice, None, "s", None), (None, long + " end", None, None, None)]
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"file://{tmp_path}/{name}.parquet")
    more = ("n_words", "kept", "component_id", "matches", "row_key", "spans", "size", "target", "_id", "_row")
    for data in ([], rows):
        docs = clashing(spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long"), *more)
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, f"file://{tmp_path}")
            assert k == 4 or docs.columns == columns
        got = docs.select("doc_id", "text").collect()
        # Of id 5's rows the first text stays, and it stands for id 6; the row without id is its own.
        assert sorted((r.doc_id or -1, len(r.text.split())) for r in got) == ([] if not data else [(-1, 30_001), (2, 30_000), (5, 80)])


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_agree_with_their_sql(agree, name):
    agree(queries.queries()[name], queries.oracle_sql()[name])
