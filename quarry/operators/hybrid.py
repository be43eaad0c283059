"""Hybrid retrieval: vector and lexical hits fused, boosted, expanded over the citation graph and reranked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import score
from quarry.functions.text import alnum_tokens
from quarry.operators import graph, lexical, rerank, vector
from quarry.plans.tables import written

#: Hits up to which their ids are named in the filter of a scan, and up to which they are broadcast.
LISTED_HITS, BROADCAST_HITS = 2_000, 500_000


@dataclass(frozen=True)
class Options:
    k: int = 10
    fetch_k: int = 40
    most_vector: int = 128
    max_distance: float = 0.58
    fallback: int = 5
    vector_weight: float = 0.6
    lexical_weight: float = 0.4
    use_mmr: bool = True
    mmr_lambda: float = 0.7
    section_penalty: float = 0.2
    case_penalty: float = 0.1
    lowercase: bool = False
    exclude_self: bool = False


def fused(vectors: DataFrame, words: DataFrame, options: Options = Options()) -> DataFrame:
    """(query_id, doc_id, vector, lexical, score): the full outer union of both sides, a missing side as 0.

    vectors(query_id, doc_id, dist), words(query_id, doc_id, norm).
    """
    v = vectors.select("query_id", "doc_id", F.greatest(F.lit(0.0), 1 - F.col("dist")).alias("vector"))
    w = words.select("query_id", "doc_id", F.col("norm").alias("lexical"))
    both = v.join(w, ["query_id", "doc_id"], "full_outer").withColumns(
        {"vector": F.coalesce("vector", F.lit(0.0)), "lexical": F.coalesce("lexical", F.lit(0.0))}
    )
    return both.withColumn("score", options.vector_weight * F.col("vector") + options.lexical_weight * F.col("lexical"))


def candidates(chunks: DataFrame, queries: DataFrame, options: Options = Options()) -> DataFrame:
    """fused() of chunks(doc_id, text, embedding) and queries(query_id, text, vec)."""
    k = min(options.most_vector, max(options.fetch_k, options.k))
    near = vector.within_or_nearest(
        vector.knn(chunks, queries, k, exclude_self=options.exclude_self), options.max_distance, options.fallback
    )
    words = lexical.bm25(chunks, queries, options.lowercase, top=max(options.fetch_k, options.k, 20))
    if options.exclude_self:
        words = words.where(F.col("query_id").cast("string") != F.col("doc_id").cast("string"))
    return fused(near, words, options)


def rows_of(chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """The rows of chunks that a written table of hits names, without a shuffle of chunks as long as hits are few.

    Unlike a join, a filter is applied before vectors are computed.
    """
    ids, n = hits.select("doc_id").distinct(), hits.count()
    if n <= LISTED_HITS:
        return chunks.where(F.col("doc_id").isin([r.doc_id for r in ids.where("doc_id IS NOT NULL").collect()]))
    return chunks.join(F.broadcast(ids) if n <= BROADCAST_HITS else ids, "doc_id", "left_semi")


def boosted(hits: DataFrame) -> DataFrame:
    """hits(score, act, section, doc_type, act_hint, sections) with statute hints added to score."""
    add = score.statute_boost(F.col("act"), F.col("section"), F.col("doc_type"), F.col("act_hint"), F.col("sections"))
    # Rounded, so that equal sums of unequal order tie.
    return hits.withColumn("score", F.round(F.col("score") + add, 9))


def ranked(hits: DataFrame, by: str = "score", name: str = "rank") -> DataFrame:
    return hits.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), "doc_id")))


def section_first(hits: DataFrame, name: str = "rank") -> DataFrame:
    """hits(query_id, section, sections, rank), of the asked sections first, then of others, then of none."""
    own = F.coalesce(F.upper("section"), F.lit(""))
    bucket = (
        F.when(F.size("sections") <= 0, 0)
        .when(F.array_contains("sections", own), 0)
        .when(own != "", 1)
        .otherwise(2)
    )
    order = Window.partitionBy("query_id").orderBy("_bucket", name)
    return hits.withColumn("_bucket", bucket).withColumn(name, F.row_number().over(order)).drop("_bucket")


def with_graph(hits: DataFrame, chunks: DataFrame, tables: graph.Graph, queries: DataFrame, limit: int = 60) -> DataFrame:
    """hits joined by what the citation graph adds to each query's best 20; scores merge by maximum."""
    extra = graph.expanded(hits, chunks, tables, queries, limit)
    rows = extra.join(chunks.select("doc_id", "text", "act", "section", "doc_type"), "doc_id").join(
        queries.select("query_id", F.col("text").alias("question"), "act_hint", "sections"), "query_id"
    )
    points = score.graph_candidate(
        F.col("text"), F.col("act"), F.col("section"), F.col("doc_type"), alnum_tokens(F.col("question")), F.col("act_hint"), F.col("sections")
    )
    new = rows.select("query_id", "doc_id", points.alias("score"))
    return hits.select("query_id", "doc_id", "score").unionByName(new).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


def retrieve(chunks: DataFrame, queries: DataFrame, options: Options = Options(), tables: graph.Graph | None = None, scorer=None, found: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the whole chain for a batch of queries.

    chunks(doc_id, text, embedding, act, section, doc_type, source_path); queries(query_id, text, vec,
    act_hint, sections). scorer: a pair scorer for rerank.cross_encoded(), or None. found: the questions' candidates(),
    if they are written already.
    """
    meta = chunks.select("doc_id", "text", "embedding", "act", "section", "doc_type", "source_path")
    hints = queries.select("query_id", F.col("text").alias("question"), "vec", "act_hint", "sections")
    found = written(candidates(chunks, queries, options), "candidates") if found is None else found
    hits = boosted(found.join(rows_of(meta.drop("embedding", "text"), found), "doc_id").join(hints, "query_id"))
    if tables is not None:
        hits = with_graph(ranked(hits), chunks, tables, queries)
    pool = written(ranked(hits.select("query_id", "doc_id", "score")).where(F.col("rank") <= max(options.fetch_k, options.k, 30)), "pool")
    pool = pool.join(rows_of(meta, pool), "doc_id").join(hints, "query_id")
    if options.use_mmr:
        pool = rerank.mmr(pool, max(options.k, options.fetch_k // 2), options.mmr_lambda, options.section_penalty, options.case_penalty)
    if scorer is not None:
        pool = rerank.cross_encoded(pool, scorer)
    return section_first(pool).where(F.col("rank") <= options.k).select("query_id", "doc_id", "score", "rank")
