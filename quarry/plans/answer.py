"""From questions to contexts and answers: the whole plan for a batch of questions."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import score
from quarry.functions.text import alnum_tokens
from quarry.operators import context, dedup, filters, graph, hybrid, parents, rerank, vector
from quarry.plans import questions as asked
from quarry.plans.tables import written


class Encoder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class PairScorer(Protocol):
    def __call__(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class Generator(Protocol):
    def __call__(self, prompts: list[str]) -> list[str]: ...


@dataclass(frozen=True)
class Plan:
    encode: Encoder
    scorer: PairScorer | None = None
    generate: Generator | None = None
    options: hybrid.Options = hybrid.Options()
    most_docs: int = 10
    floor: float = 0.35
    pool_least: float = 0.25
    pool_rows: int = 60
    merge_parents: bool = False


def merged(*parts: tuple[DataFrame, float | None]) -> DataFrame:
    """(query_id, doc_id, relevance): the best score of each document over all parts, with each part's floor."""
    rows = [p.select("query_id", "doc_id", (F.col("score") if floor is None else F.greatest("score", F.lit(floor))).alias("score")) for p, floor in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy("query_id", "doc_id").agg(F.max("score").alias("relevance"))


def pooled(found: DataFrame, least: float, at_least: int = 12, most: int = 60) -> DataFrame:
    """found(query_id, doc_id, relevance) above a threshold, filled up to a minimum, at most so many, ranked."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id"))
    return found.withColumn("rank", rank).where(((F.col("relevance") >= least) | (F.col("rank") <= at_least)) & (F.col("rank") <= most))


def run(chunks: DataFrame, questions: DataFrame, plan: Plan, tables: graph.Graph | None = None) -> DataFrame:
    """(query_id, rejected, context, n_blocks, confidence, label, prompt, answer) for questions(query_id, text)."""
    known = written(asked.analysed(questions), "questions")
    live = written(vector.embedded(known.where("rejected IS NULL"), plan.encode, "clean").withColumnRenamed("embedding", "vec"), "live-questions")
    each = live.select("query_id", F.explode("variants").alias("clean_text"))
    # Variants are questions of their own whose hits go back to the question they came from; one search serves all.
    wide = vector.embedded(each, plan.encode, "clean_text").select(
        "query_id", F.concat_ws("\u0001", F.col("query_id").cast("string"), "clean_text").alias("key"), F.col("clean_text").alias("text"), F.col("embedding").alias("vec"), F.lit(True).alias("variant")
    )
    own = live.select("query_id", F.col("query_id").cast("string").alias("key"), F.col("clean").alias("text"), "vec", F.lit(False).alias("variant"))
    searched = written(own.unionByName(wide), "searched")
    hits = hybrid.candidates(chunks, searched.select(F.col("key").alias("query_id"), "text", "vec"), plan.options)
    hits = written(hits.withColumnRenamed("query_id", "key").join(searched.select("key", "query_id", "variant"), "key").drop("key"), "hits")
    alone = live.select("query_id", F.col("clean").alias("text"), "vec", "act_hint", "sections")
    first = hybrid.retrieve(chunks, alone, plan.options, tables, plan.scorer, hits.where("NOT variant").drop("variant"))
    more = hits.where("variant")
    meta = chunks.drop("embedding")
    injected = (
        written(asked.injections(live.withColumn("source_hint", F.lit(None).cast("string"))), "injections")
        .join(meta.select("doc_id", "source", "section"), ["source", "section"])
        .withColumn("_rn", F.row_number().over(Window.partitionBy("query_id", "source").orderBy("at", "doc_id")))
        .where((F.col("_rn") <= F.col("take")) & (F.col("_rn") <= asked.MOST_TAKEN))
        .withColumn("score", F.lit(0.0))
    )
    found = merged((first, None), (more, None), (injected, max(plan.pool_least + 0.05, 0.45)))
    found = written(pooled(found, plan.pool_least, most=plan.pool_rows), "found")
    question = live.select("query_id", F.col("text").alias("question"), "overview")
    pool = found.join(hybrid.rows_of(meta, found), "doc_id").join(question, "query_id")
    pool = dedup.exact(pool, F.concat_ws("\u0001", F.col("query_id").cast("string"), dedup.doc_key(F.col("doc_id"), F.col("text"))), [F.col("rank")])
    pool = dedup.near_greedy(pool)
    if plan.merge_parents:
        pool = parents.reconstructed(pool)
    pool = written(rerank.by_authority(pool, alnum_tokens(F.col("question"))), "answer-pool")
    trust = pool.groupBy("query_id").agg(score.context_confidence(F.col("doc_type"), F.col("section")).alias("confidence"))
    brief = context.assembled(pool.where("NOT overview"), plan.most_docs)
    long = context.assembled(pool.where("overview"), plan.most_docs, overview=True)
    out = brief.unionByName(long).join(trust, "query_id").join(context.citation_prompt(pool), "query_id")
    if plan.generate is not None:
        make = plan.generate

        @F.pandas_udf(T.StringType())
        def answer(prompt: pd.Series) -> pd.Series:
            return pd.Series(make(prompt.tolist()))

        out = out.withColumn("answer", answer("prompt")).withColumn("answer", score.annotated(F.col("answer"), F.col("confidence")))
    else:
        out = out.withColumn("answer", F.lit(None).cast("string"))
    return known.select("query_id", "rejected").join(out.withColumn("label", score.confidence_label(F.col("confidence"))), "query_id", "left")


def overview_scope(chunks: DataFrame, where: dict, sections: int = 40, fetch: int = 80) -> DataFrame:
    """Chunks of a scope for an overview: its first numbered sections, some without a section, and if
    there are none of either a plain sample."""
    own = filters.compile_where(where)
    if own is None:
        return chunks.limit(0)
    rows = chunks.where(own)
    numbered = rows.where(score.section_number(F.col("section")).between(1, sections)).orderBy("doc_id").limit(fetch)
    bare = rows.where(F.coalesce("section", F.lit("")) == "").orderBy("doc_id").limit(fetch)
    both = numbered.unionByName(bare)
    return both.unionByName(rows.orderBy("doc_id").limit(fetch)).dropDuplicates(["doc_id"])
