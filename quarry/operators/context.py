"""Bounded contexts from ranked documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import score
from quarry.functions.text import alnum_tokens

DOC_CHARS, CONTEXT_CHARS, OVERVIEW_CHARS = 2400, 12_000, 16_000


def source_label() -> Column:
    """What a block is headed with: citation or act and section, chapter; for case law act and source."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    statute = F.concat_ws(
        " | ",
        F.when(has("citation"), F.concat(F.lit("**"), F.col("citation"), F.lit("**"))).when(has("act"), F.concat(F.lit("Act: "), F.col("act"))),
        F.when(has("section") & ~has("citation"), F.concat(F.lit("Section: "), F.col("section"))),
        F.when(has("chapter"), F.concat(F.lit("Chapter: "), F.col("chapter"))),
    )
    case = F.concat_ws(
        " | ", F.lit("Case Law"), F.when(has("act"), F.concat(F.lit("Act: "), F.col("act"))), F.when(has("source"), F.concat(F.lit("Source: "), F.col("source")))
    )
    named = F.when(statute != "", statute).otherwise(F.coalesce("source", F.lit("Unknown")))
    return F.when(F.col("doc_type") == "qa", case).otherwise(named)


def prefix_budget(pool: DataFrame, budget: int = CONTEXT_CHARS, doc_chars: int = DOC_CHARS) -> DataFrame:
    """pool(query_id, rank, text) up to the budget: the running sum of cut lengths, a plain window."""
    cost = F.least(F.length("text"), F.lit(doc_chars)) + 10
    run = F.sum(cost).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return pool.withColumn("used_chars", run).where((F.col("used_chars") <= budget) | (F.col("rank") == 1))


def overview_mix(pool: DataFrame, question: Column, target_act: Column, most: int, early: int = 8) -> DataFrame:
    """For an overview of an act: its documents by outline score, then its first sections, `most` of them."""
    terms = alnum_tokens(question, stopwords=True)
    own = (F.lower(F.coalesce("act", F.lit(""))) == F.lower(F.coalesce(target_act, F.lit("")))) & F.col("doc_type").isin(*score.STATUTORY)
    by = Window.partitionBy("query_id")
    rows = (
        pool.withColumn("_own", own)
        .withColumn("_any", F.max("_own").over(by))
        .where((F.col("_own") | ~F.col("_any")) & F.col("doc_type").isin(*score.STATUTORY))
        .withColumn("_score", score.outline(F.col("text"), F.col("section"), terms))
        .withColumn("_a", F.row_number().over(by.orderBy(F.desc("_score"), F.length("text"), "rank")))
        .withColumn("_b", F.row_number().over(by.orderBy(F.col("section").isNull(), score.section_number(F.col("section")), "rank")))
        .where((F.col("_a") <= most) | (F.col("_b") <= early))
    )
    order = F.when(F.col("_a") <= most, F.col("_a")).otherwise(most + F.col("_b"))
    return (
        rows.withColumn("rank", F.row_number().over(by.orderBy(order)))
        .where(F.col("rank") <= most)
        .drop("_own", "_any", "_score", "_a", "_b")
    )


def assembled(pool: DataFrame, most_docs: int = 10, overview: bool = False) -> DataFrame:
    """(query_id, context, n_blocks) of pool(query_id, rank, text, doc_type, citation, act, section, chapter, source).

    Statutes come before case law. A block that would exceed the budget is passed over and a later,
    smaller one may still fit, so a query's bounded pool is walked in order.
    """
    most = most_docs * 2 if overview else most_docs
    budget = OVERVIEW_CHARS if overview else CONTEXT_CHARS
    statute_cap = most // 2 + (3 if overview else 2)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        blocks, used = [], 0

        def add(label: str, text: str | None) -> None:
            nonlocal used
            body = (text or "").strip()
            if not body or used >= budget:
                return
            if len(body) > DOC_CHARS:
                body = body[:DOC_CHARS].rstrip() + "\n...[truncated]"
            block = f"[Source {len(blocks) + 1}: {label}]\n{body}"
            if used and used + len(block) + 10 > budget:
                return
            blocks.append(block)
            used += len(block) + 10

        rows = rows.sort_values("rank").head(most)
        for r in rows[rows["doc_type"].isin(score.STATUTORY)].head(statute_cap).itertuples():
            add(r.label, r.text)
        for r in rows[rows["doc_type"] == "qa"].head(most - len(blocks)).itertuples():
            add(r.label, r.text)
        return pd.DataFrame({"query_id": [rows["query_id"].iloc[0]], "context": ["\n\n---\n\n".join(blocks)], "n_blocks": [len(blocks)]})

    kind = pool.schema["query_id"].dataType.simpleString()
    held = pool.withColumn("label", source_label()).select("query_id", "rank", "text", "doc_type", "label")
    return held.groupBy("query_id").applyInPandas(build, f"query_id {kind}, context string, n_blocks long")


def citation_prompt(pool: DataFrame, question: str = "question", most: int = 15) -> DataFrame:
    """(query_id, prompt): instructions, numbered sources in rank order, and the question."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    named = F.concat_ws(
        " | ",
        F.when(has("act"), F.col("act")),
        F.when(has("section"), F.concat(F.lit("Section "), F.col("section"))),
        F.when(has("citation"), F.col("citation")),
    )
    label = F.when(named != "", named).otherwise(F.coalesce("source_path", F.concat(F.lit("Source "), F.col("rank").cast("string"))))
    block = F.concat(F.lit("--- [Source "), F.col("rank").cast("string"), F.lit(": "), label, F.lit("] ---\n"), F.trim("text"))
    rows = pool.where(F.col("rank") <= most).groupBy("query_id", question).agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("_s"))
    return rows.select(
        "query_id",
        F.concat(
            F.lit("Answer only from the sources below, name the act and section of every statement, and say so if they do not answer.\n\n"),
            F.array_join(F.transform("_s", lambda x: x["b"]), "\n\n"),
            F.lit("\n\nQuestion: "),
            F.trim(question),
            F.lit("\nAnswer:"),
        ).alias("prompt"),
    )
