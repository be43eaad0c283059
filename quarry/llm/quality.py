"""Quality rules as a learned decision list, on DataFrame functions only.

Statistics of whole texts are native columns. Sequential covering learns ordered threshold
conjunctions that describe labelled junk from a bounded sample of labelled rows; the list becomes
one Spark CASE expression that judges every document.

Edge cases: a null or blank text has all statistics 0 and fails the base rules; an empty table gives
no rows; without labels (or with one class only) the list is empty and only base rules decide;
repeated rows are judged each; other columns are carried along or ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import textcols

#: Labelled rows that the list is fitted on, in expectation: the documented bound of the sample.
SAMPLE_ROWS = 20_000
#: The characters counted as symbols.
SYMBOLS = "[#*$%&|<>]"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long).

    n_repeat_words sorts 3-word windows by their 64-bit hash, whatever the text's length. Equal windows
    then stand side by side; their positions, sorted again, give the union of covered words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = [F.col(c) for c in docs.columns if c not in BASE]
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (
        docs.select(*kept)
        .withColumn("_w", textcols.words(F.col("text")))
        .withColumn("n_words", F.size("_w").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOLS)).cast("long"))
        .withColumn("_l", lines)
        .withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
        .withColumn(
            "_k",
            F.expr(
                "sort_array(CASE WHEN n_words >= 3 THEN transform(sequence(0, int(n_words) - 3),"
                " i -> struct(xxhash64(_w[i], _w[i + 1], _w[i + 2]) AS h, i AS p))"
                " ELSE cast(array() AS array<struct<h: bigint, p: int>>) END)"
            ),
        )
        .withColumn(
            "_p",
            F.expr(
                "filter(_k, (x, j) -> coalesce(x.h = get(_k, j - 1).h, false) OR coalesce(x.h = get(_k, j + 1).h, false))"
            ),
        )
        .withColumn("_p", F.expr("sort_array(transform(_p, x -> bigint(x.p)))"))
        .withColumn(
            "n_repeat_words",
            F.expr(
                "aggregate(_p, named_struct('end', 0L, 'n', 0L),"
                " (a, p) -> named_struct('end', p + 3, 'n', a.n + p + 3 - greatest(p, a.end)), a -> a.n)"
            ),
        )
        .drop("_w", "_l", "_k", "_p")
    )


def features() -> dict[str, Column]:
    """What conditions test: the statistics and their shares of the text."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_chars": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "n_symbols": F.col("n_symbols").cast("double"),
        "n_dup_lines": F.col("n_dup_lines").cast("double"),
        "dup_lines_per_word": F.col("n_dup_lines") / n,
        "repeat_share": F.col("n_repeat_words") / n,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    op: str
    bound: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value >= self.bound if self.op == ">=" else value <= self.bound

    def __str__(self) -> str:
        return f"{self.feature} {self.op} {self.bound:.6g}"


@dataclass(frozen=True)
class Rule:
    """If every condition holds, the document is junk. positives, negatives: of the pruning rows it covers."""

    conditions: tuple[Condition, ...]
    positives: int
    negatives: int

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out


def _cuts(values: np.ndarray, most: int = 48) -> np.ndarray:
    """Midpoints between neighbouring distinct quantiles."""
    q = np.unique(np.quantile(values, np.linspace(0, 1, most + 1), method="nearest"))
    return (q[1:] + q[:-1]) / 2


def _grow(x: np.ndarray, y: np.ndarray, names: list[str], max_conditions: int) -> list[Condition]:
    """Adds the condition of most information gain until no negative is covered."""
    live, out = np.ones(len(y), bool), []
    while len(out) < max_conditions:
        p0, n0 = int(y[live].sum()), int((~y[live]).sum())
        if not p0 or not n0:
            break
        before, best = np.log2(p0 / (p0 + n0)), (1e-9, None, None)
        for j, name in enumerate(names):
            for cut in _cuts(x[live, j]) if live.any() else ():
                for op in (">=", "<="):
                    hit = live & ((x[:, j] >= cut) if op == ">=" else (x[:, j] <= cut))
                    p, n = int((hit & y).sum()), int((hit & ~y).sum())
                    if p:
                        gain = p * (np.log2(p / (p + n)) - before)
                        if gain > best[0]:
                            best = (gain, Condition(name, op, float(cut)), hit)
        if best[1] is None:
            break
        out.append(best[1])
        live = best[2]
    return out


def _covers(conditions, x: np.ndarray, names: list[str]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for c in conditions:
        v = x[:, names.index(c.feature)]
        hit &= (v >= c.bound) if c.op == ">=" else (v <= c.bound)
    return hit


def _prune(conditions: list[Condition], x, y, names) -> tuple[list[Condition], int, int]:
    """Drops final conditions while that does not worsen (p - n) / (p + n) on the pruning rows."""
    best = None
    for k in range(len(conditions), 0, -1):
        hit = _covers(conditions[:k], x, names)
        p, n = int((hit & y).sum()), int((hit & ~y).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if best is None or worth >= best[0]:
            best = (worth, conditions[:k], p, n)
    return best[1], best[2], best[3]


def cover(
    x: np.ndarray, junk: np.ndarray, names: list[str], min_precision: float = 0.9, max_rules: int = 16, max_conditions: int = 4
) -> list[Rule]:
    """Sequential covering: grow on two thirds of the rows, prune on the rest, drop what is covered, go on."""
    rules: list[Rule] = []
    third = np.arange(len(junk)) % 3 == 2
    live = np.ones(len(junk), bool)
    while len(rules) < max_rules:
        grow, prune = live & ~third, live & third
        if not junk[grow].any() or not junk[prune].any():
            break
        conditions = _grow(x[grow], junk[grow], names, max_conditions)
        if not conditions:
            break
        conditions, p, n = _prune(conditions, x[prune], junk[prune], names)
        if not p or p / (p + n) < min_precision:
            break
        rules.append(Rule(tuple(conditions), p, n))
        live &= ~_covers(conditions, x, names)
    return rules


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, **options) -> list[Rule]:
    """The decision list from labels(doc_id, quality); only the sampled documents are measured."""
    labels = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(
        F.col("doc_id").alias("_id"), (F.col("quality") == 0).alias("_junk")
    )
    total = labels.count()
    if not total:
        return []
    some = labels.where(F.pmod(F.xxhash64("_id"), F.lit(total)) < sample_rows)
    names = list(features())
    rows = (
        statistics(docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id")))
        .select("_id", "_junk", *(c.alias(k) for k, c in features().items()))
        .collect()
    )
    rows.sort(key=lambda r: (hash(int(r["_id"]) * 2654435761 % 4294967291), r["_id"]))
    if not rows:
        return []
    x = np.array([[r[k] for k in names] for r in rows], float)
    return cover(x, np.array([bool(r["_junk"]) for r in rows]), names, **options)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the number of the first rule that fires, else null."""
    out = F.when(F.lit(False), F.lit(0))
    for k, rule in enumerate(rules):
        out = out.when(rule.column(), F.lit(k))
    return out


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs with the statistics, base_failed, fired_rule (int or null) and kept."""
    return (
        statistics(docs)
        .withColumn("base_failed", base_failed())
        .withColumn("fired_rule", verdict(rules))
        .withColumn("kept", ~F.col("base_failed") & F.col("fired_rule").isNull())
    )
