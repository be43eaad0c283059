"""Language identification by word-first backoff.

A word that training saw is scored by its relative frequency in each language. An unseen word is cut,
with a space at either end, into character n-grams of the greatest length of which training saw any,
and scored by the mean over those; if it saw none, shorter n-grams are tried. A language that lacks a
word or n-gram that others have gets a fixed penalty. A text's score is the mean over its words.

The model is fitted on a documented sample: whole documents, as many of each language as of another,
at most SAMPLE_DOCS of them with at most SAMPLE_CHARS characters. It keeps all that these documents
hold, so its size is bounded by theirs. Every document is predicted from its whole text alone.

Edge cases: a null text, or one without a letter (a character of category L), is `und` with score 0;
so is every text if nothing was learned; ties go to the first language by code point; in the sample,
equal documents count once, and rows without doc_id are taken like others; repeated rows are predicted
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.tables import written

#: Bounds of the sample that the model is fitted on, and so of what is broadcast.
SAMPLE_DOCS, SAMPLE_CHARS = 5_000, 8 << 20
LENGTHS = (4, 3, 2, 1)
#: -log10 of the frequency that an absent entry counts as.
PENALTY = 7.0
#: Runs of letters, and of what isalnum() takes beside letters and digits (fractions, superscripts, numerals).
LETTERS = re.compile(r"[^\W\d_]+")
#: Unseen words whose scores a worker keeps.
KEPT_WORDS = 100_000


class Table:
    """Entries and their rows in a sparse matrix: what each saves of the penalty in the languages that have it."""

    def __init__(self, index: dict[str, int], first: np.ndarray, lang: np.ndarray, saved: np.ndarray) -> None:
        self.index, self.first, self.lang, self.saved = index, first, lang, saved


def _table(rows: DataFrame, key: str, langs: list[str]) -> Table:
    """The table of rows(key, lang, n)."""
    found = rows.groupBy(key, "lang").agg(F.sum("n").cast("double").alias("n")).toArrow().sort_by(key)
    names, n = found[key].to_pylist(), found["n"].to_numpy()
    place = {x: i for i, x in enumerate(langs)}
    lang = np.array([place[x] for x in found["lang"].to_pylist()], np.int64)
    saved = np.maximum(PENALTY + np.log10(n / np.bincount(lang, n, minlength=len(langs))[lang]), 0.0)
    index: dict[str, int] = {}
    first = []
    for i, name in enumerate(names):
        if name not in index:
            index[name] = len(index)
            first.append(i)
    return Table(index, np.array([*first, len(names)], np.int64), lang, saved)


class Model:
    """langs, and tables for words and for each n-gram length, whose matrices are stacked so that one sum scores a text."""

    def __init__(self, langs: list[str], words: Table, grams: dict[int, Table]) -> None:
        self.langs, self.words, self.grams, self._unseen = langs, words, grams, {}
        tables = [words, *(grams[n] for n in LENGTHS)]
        starts = np.cumsum([0, *(len(t.index) for t in tables)])
        sizes = np.concatenate([np.diff(t.first) for t in tables])
        self._first = np.concatenate([[0], np.cumsum(sizes)])
        self._lang = np.concatenate([t.lang for t in tables])
        self._saved = np.concatenate([t.saved for t in tables])
        #: By n-gram length: its entries and the stacked row of the first; words keep their own rows.
        self._levels = [(n, grams[n].index, int(start)) for n, start in zip(LENGTHS, starts[1:])]

    def unseen(self, word: str) -> list[int]:
        """Rows of the n-grams that stand for a word that training did not see."""
        rows = self._unseen.get(word)
        if rows is None:
            padded = f" {word} "
            for n, index, start in self._levels:
                rows = [start + index[g] for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if g in index]
                if rows:
                    break
            if len(self._unseen) >= KEPT_WORDS:
                self._unseen.clear()
            self._unseen[word] = rows
        return rows

    def cost(self, rows: list[int], weights: list[float]) -> np.ndarray:
        """The summed cost, in each language, of rows with such weights."""
        rows, weights = np.array(rows), np.array(weights, float)
        begin = self._first[rows]
        size = self._first[rows + 1] - begin
        at = np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)
        return PENALTY * weights.sum() - np.bincount(self._lang[at], np.repeat(weights, size) * self._saved[at], minlength=len(self.langs))

    def predict(self, text: str | None) -> tuple[str, float]:
        found = Counter(LETTERS.findall(text.lower())) if text else Counter()
        for word in [w for w in found if not w.isalpha()]:
            # Fractions and the like part words.
            times_found = found.pop(word)
            for part in "".join(c if c.isalpha() else " " for c in word).split():
                found[part] += times_found
        if not found or not self.langs:
            return "und", 0.0
        index = self.words.index
        rows, weights, n = [], [], 0
        for word, k in found.items():
            row = index.get(word)
            if row is not None:
                rows.append(row)
                weights.append(k)
                n += k
            elif stand_in := self.unseen(word):
                rows += stand_in
                weights += [k / len(stand_in)] * len(stand_in)
                n += k
        if not n:
            return self.langs[0], 1.0 / len(self.langs)
        mean = self.cost(rows, weights) / n
        best = int(mean.argmin())
        weight = np.exp(-(mean - mean[best]) * math.log(10))
        return self.langs[best], float(1.0 / weight.sum())


def sample(docs: DataFrame, most_docs: int, most_chars: int) -> DataFrame:
    """(lang, text): at most so many whole documents and characters, of no document over 1/64 of most_chars.

    In the order of a hash, the first of every language is taken, then the second of each, and so on. Equal
    documents count once. Of more languages than documents, the most frequent are learned.
    """
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text", F.xxhash64("doc_id", "text").alias("_h"))
    langs = known.groupBy("lang").agg(F.count(F.lit(1)).alias("_all")).orderBy(F.desc("_all"), "lang").limit(most_docs)
    # By language about twice as many rows as can be taken go on, so that no language is dealt out whole.
    near = (
        known.join(F.broadcast(langs), "lang")
        .where((F.pmod("_h", "_all") < 2 * most_docs) & (64 * F.length("text") <= most_chars))
        .select("lang", "_h", F.length("text").alias("_chars"))
        .distinct()
    )
    order = ("_rank", "_h", "lang")
    first = near.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).orderBy(*order).limit(most_docs)
    so_far = F.sum("_chars").over(Window.partitionBy().orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    chosen = first.withColumn("_so_far", so_far).where(F.col("_so_far") <= most_chars).select("lang", "_h")
    return known.join(F.broadcast(written(chosen, "langid-sample")), ["lang", "_h"]).dropDuplicates(["lang", "_h"]).select("lang", "text")


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """The model from docs(doc_id, text, lang); rows without text or lang teach nothing."""
    words = written(
        sample(docs, sample_docs, sample_chars)
        .select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
        .where("word <> ''")
        .groupBy("lang", "word")
        .agg(F.count(F.lit(1)).alias("n")),
        "langid-words",
    )
    langs = sorted((r[0] for r in words.select("lang").distinct().collect()), key=lambda x: x.encode("utf-8", "surrogatepass"))
    padded = words.select("lang", "n", F.concat(F.lit(" "), "word", F.lit(" ")).alias("w"))
    grams = {}
    for n in LENGTHS:
        cut = padded.where(F.length("w") >= n).select(
            "lang", "n", F.explode(F.expr(f"transform(sequence(1, length(w) - {n - 1}), i -> substr(w, i, {n}))")).alias("gram")
        ).where("gram <> ' '")
        grams[n] = _table(cut, "gram", langs)
    return Model(langs, _table(words, "word", langs), grams)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of docs(doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast((model.langs, model.words, model.grams))

    def run(batches):
        own = Model(*held.value)
        for batch in batches:
            found = [own.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
