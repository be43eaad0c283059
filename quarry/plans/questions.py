"""What a question asks for: checks, tags, hints and variants, for a table of questions at once."""

from __future__ import annotations

import difflib
from collections.abc import Callable
from functools import reduce
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry import dims
from quarry.functions.extract import section_refs, statute_query
from quarry.functions.score import contains_any
from quarry.functions.text import alnum_tokens, preprocess_query
from quarry.plans.tables import written

#: Forms of questions that try to change the rules, and how long a question may be.
INJECTIONS = [r"ignore.*instruction", r"system.*prompt", r"disregard.*rule", r"override.*constraint"]
LONGEST = 1000
#: How many rows of a source injected sections take at most.
MOST_TAKEN = 24


def rejection(question: Column) -> Column:
    """Why a question is not answered: 'empty', 'long', 'pattern'; null if it is."""
    q = F.coalesce(question, F.lit(""))
    bad = reduce(lambda a, b: a | b, (q.rlike(f"(?i){p}") for p in INJECTIONS))
    return F.when(F.trim(q) == "", "empty").when(F.length(q) > LONGEST, "long").when(bad, "pattern")


def is_overview(question: Column) -> Column:
    return contains_any(F.lower(question), dims.OVERVIEW_CUES)


def _with(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), for which value is computed once however often it occurs in the result."""
    return F.transform(F.array(value), make)[0]


def tags(question: Column) -> Column:
    """array<string> of tags, in declaration order; cues count as substrings."""
    return _with(F.lower(F.coalesce(question, F.lit(""))), _tags_of)


def _tags_of(q: Column) -> Column:
    out = []
    for tag, cues in dims.TAG_CUES.items():
        hit = contains_any(q, cues)
        for name, some, others in dims.TAG_PAIRS:
            if name == tag:
                hit = hit | (contains_any(q, some) & contains_any(q, others))
        out.append(F.when(hit, F.lit(tag)))
    return F.array_compact(F.array(*out))


def asks_of_clause(question: Column) -> Column:
    """Whether it asks if a clause holds."""
    q = F.lower(F.coalesce(question, F.lit("")))
    implied = F.arrays_overlap(tags(q), F.array(*map(F.lit, dims.CLAUSE_TAGS)))
    return contains_any(q, dims.ENFORCEABLE_CUES) & (contains_any(q, dims.CLAUSE_CUES) | implied)


def sources_of(found: Column) -> Column:
    """array<string> of the sources that answer tags, each once, in declaration order."""
    rows = F.array(*(F.when(F.array_contains(found, t), F.array(*map(F.lit, s))).otherwise(F.array().cast("array<string>")) for t, s in dims.TAG_SOURCES.items()))
    return F.array_distinct(F.flatten(rows))


def variants(question: Column, found: Column, most: int = 6) -> Column:
    """array<string>: the question, then what stands for its tags, then synonyms put in and by themselves."""
    none = F.array().cast("array<string>")

    def parts(x: Column) -> Column:
        q, out = x["q"], [F.array(x["q"])]
        out += [F.when(F.array_contains(x["found"], tag), F.array(*map(F.lit, texts))).otherwise(none) for tag, texts in _grouped(dims.TAG_ANCHORS)]
        for term, others in dims.SYNONYMS.items():
            by_term = F.array(*(v for o in others for v in (F.replace(q, F.lit(term), F.lit(o)), F.lit(o))))
            out.append(F.when(q.contains(term), by_term).otherwise(none))
        every = F.filter(F.transform(F.flatten(F.array(*out)), lambda v: F.trim(v)), lambda v: v != "")
        return F.when(q == "", none).otherwise(F.slice(F.array_distinct(every), 1, most))

    return _with(F.struct(F.lower(F.trim(F.coalesce(question, F.lit("")))).alias("q"), found.alias("found")), parts)


def _grouped(rows: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    """(tag, texts) of neighbouring rows with the same tag."""
    return [(tag, [text for _, text in some]) for tag, some in groupby(rows, key=lambda r: r[0])]


def breadth(overview: Column, clause: Column, found: Column) -> Column:
    """How many documents a question needs."""
    return F.when(overview, 60).when(clause | (F.size(found) > 0), 45).otherwise(30)


def analysed(questions: DataFrame) -> DataFrame:
    """questions(query_id, text) with everything that retrieval needs to know."""
    return (
        questions.withColumn("rejected", rejection(F.col("text")))
        .withColumn("clean", preprocess_query(F.col("text")))
        .withColumn("overview", is_overview(F.col("text")))
        .withColumn("tags", tags(F.col("clean")))
        .withColumn("clause", asks_of_clause(F.col("clean")))
        .withColumn("breadth", breadth(F.col("overview"), F.col("clause"), F.col("tags")))
        .withColumn("fetch_k", F.greatest(5 * F.col("breadth"), F.lit(50)))
        .withColumn("statute", statute_query(F.col("text")))
        .withColumn("act_hint", F.col("statute.act"))
        .withColumn("sections", F.col("statute.sections"))
        .withColumn("boosted_sources", sources_of(F.col("tags")))
        .withColumn("variants", F.slice(variants(F.col("clean"), F.col("tags"), 8), F.lit(1), F.when(F.size("tags") >= 2, 8).otherwise(6)))
        .drop("statute")
    )


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; no built-in function agrees with it."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def best_act(questions: DataFrame, acts: DataFrame, least: float = 0.35) -> DataFrame:
    """(query_id, act, likeness): the likest of acts(query_id, act), those of a query's retrieved documents."""
    near = questions.join(acts.where("act <> ''").distinct(), "query_id").withColumn("likeness", likeness(F.lower("text"), F.lower("act")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("likeness"), "act"))
    return near.withColumn("_rn", rank).where((F.col("_rn") == 1) & (F.col("likeness") >= least)).select("query_id", "act", "likeness")


def _expanded(rows: DataFrame, column: str) -> DataFrame:
    """rows with abbreviations among the words spelled out and names abbreviated, in that order.

    One projection for each step: a single expression would repeat its input at every step.
    """
    for need, more in dims.NAME_EXPANSIONS:
        has = reduce(lambda a, b: a & b, (F.array_contains(column, w) for w in need))
        rows = rows.withColumn(column, F.when(has, F.array_union(column, F.array(*map(F.lit, more)))).otherwise(F.col(column)))
    return rows


def best_source(questions: DataFrame, inventory: DataFrame, least: float = 0.35) -> DataFrame:
    """(query_id, source, score): the source whose name fits best; inventory(source, name, words) is a small
    dimension, broadcast only as far as Spark's own size limit allows."""
    q = F.btrim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    asked = questions.select("query_id", q.alias("q"), alnum_tokens(F.col("text"), stopwords=True).alias("t"))
    asked = written(_expanded(asked, "t"), "asked").where(F.size("t") > 0)
    pairs = asked.withColumn("_k", F.lit(1)).join(inventory.where(F.size("words") > 0).withColumn("_k", F.lit(1)), "_k")
    fit = 0.7 * F.size(F.array_intersect("t", "words")) / F.size("words") + 0.3 * likeness("q", "name")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "source"))
    return pairs.withColumn("score", fit).withColumn("_rn", rank).where((F.col("_rn") == 1) & (F.col("score") >= least)).select("query_id", "source", "score")


def injections(questions: DataFrame, most: int = 6) -> DataFrame:
    """(query_id, source, section, take): sections that tags and explicit references bring in, at most `most`.

    questions: analysed(), with `source_hint` for explicit references (else the first boosted source).
    """
    by_tag = F.flatten(
        F.array(
            *(
                F.when(F.array_contains("tags", tag), F.array(*(F.struct(F.lit(s).alias("source"), F.lit(x).alias("section")) for s, xs in by.items() for x in xs)))
                .otherwise(F.array().cast("array<struct<source:string,section:string>>"))
                for tag, by in dims.TAG_SECTIONS.items()
            )
        )
    )
    hint = F.coalesce("source_hint", F.get("boosted_sources", F.lit(0)))
    explicit = F.when(hint.isNotNull(), F.transform(section_refs(F.col("text")), lambda s: F.struct(hint.alias("source"), s.alias("section"))))
    every = F.slice(F.array_distinct(F.concat(by_tag, F.coalesce(explicit, F.array().cast("array<struct<source:string,section:string>>")))), 1, most)
    rows = questions.select("query_id", F.posexplode(every).alias("at", "x")).select("query_id", "at", "x.source", "x.section")
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id", "source"))
    return rows.withColumn("take", F.least(F.lit(MOST_TAKEN), F.greatest(F.lit(6), 4 * n)))


def cached_answers(cache: DataFrame, now: Column, days: int = 7, longest: int = LONGEST, most: int = 10_000) -> DataFrame:
    """Rows of cache(query, answer, timestamp) that may be served: whole days of age at most `days`, a
    timestamp that reads, a question of allowed length; the newest `most`."""
    at = F.try_to_timestamp("timestamp")
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp(at)) / 86_400)
    live = cache.where(at.isNotNull() & (age <= days) & (F.length("query") <= longest))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(at), "answer"))
    return live.withColumn("_rn", rank).where("_rn = 1").drop("_rn").orderBy(F.desc(at), "query").limit(most)
