"""The citation graph of acts, sections and chunks as three tables, and walks over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.extract import section_refs


@dataclass(frozen=True)
class Graph:
    """sections(key, act, section, subsection, clause), section_chunks(key, doc_id), section_cites(src_key, dst_key)."""

    sections: DataFrame
    section_chunks: DataFrame
    section_cites: DataFrame


def _blank(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def section_key(act: Column, section: Column, subsection: Column, clause: Column) -> Column:
    """act|section|subsection|clause; null without act or section."""
    return F.when((_blank(act) != "") & (_blank(section) != ""), F.concat_ws("|", act, section, _blank(subsection), _blank(clause)))


def build(chunks: DataFrame) -> Graph:
    """From chunks(doc_id, text, act, section, subsection, clause). Cited sections exist even without chunks."""
    key = section_key(F.col("act"), F.col("section"), F.col("subsection"), F.col("clause"))
    rows = chunks.withColumn("key", key).where("key IS NOT NULL")
    own = rows.select("key", "act", "section", _blank("subsection").alias("subsection"), _blank("clause").alias("clause"))
    cites = (
        rows.select("key", "act", "section", F.explode(section_refs(F.col("text"))).alias("ref"))
        .where(F.upper("section") != F.col("ref"))
        .select(F.col("key").alias("src_key"), "act", "ref", section_key(F.col("act"), F.col("ref"), F.lit(""), F.lit("")).alias("dst_key"))
        .distinct()
    )
    cited = cites.select(F.col("dst_key").alias("key"), "act", F.col("ref").alias("section"), F.lit("").alias("subsection"), F.lit("").alias("clause"))
    return Graph(own.unionByName(cited).distinct(), rows.select("key", "doc_id").distinct(), cites.select("src_key", "dst_key").distinct())


def upserted(graph: Graph, new: Graph) -> Graph:
    """graph with the chunks of new in place of what it had of them; sections and citations are kept."""
    chunks = graph.section_chunks.join(new.section_chunks.select("doc_id").distinct(), "doc_id", "left_anti").select("key", "doc_id")
    return Graph(
        graph.sections.unionByName(new.sections).dropDuplicates(["key"]),
        chunks.unionByName(new.section_chunks),
        graph.section_cites.unionByName(new.section_cites).distinct(),
    )


def without_chunks(graph: Graph, ids: DataFrame) -> Graph:
    """graph without the chunks in ids(doc_id); their sections stay."""
    return Graph(graph.sections, graph.section_chunks.join(ids, "doc_id", "left_anti").select("key", "doc_id"), graph.section_cites)


def candidate_ids(graph: Graph, asked: DataFrame, limit: int | None = 1500, hops: int = 1) -> DataFrame:
    """(query_id, doc_id) for asked(query_id, act, sections): chunks of the named sections and of what
    they cite within `hops`; of the whole act if no section is named; none without an act."""
    asked = asked.where(_blank("act") != "")
    nodes = asked.join(graph.sections.select("key", "act", "section"), "act").select("query_id", "key", "section", "sections")
    start = nodes.where((F.size("sections") <= 0) | F.array_contains("sections", F.upper("section")))
    reached = start.select("query_id", "key").distinct()
    # Only from named sections are citations followed; a whole act is reached already.
    front = start.where(F.size("sections") > 0).select("query_id", "key").distinct()
    for _ in range(hops):
        front = front.join(graph.section_cites, front.key == F.col("src_key")).select("query_id", F.col("dst_key").alias("key")).distinct()
        reached = reached.unionByName(front)
    found = reached.distinct().join(graph.section_chunks, "key").select("query_id", "doc_id").distinct()
    if limit is None:
        return found
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))
    return found.withColumn("_rn", rank).where(F.col("_rn") <= limit).drop("_rn")


def expanded(hits: DataFrame, chunks: DataFrame, graph: Graph, queries: DataFrame, limit: int = 60, top: int = 20) -> DataFrame:
    """(query_id, doc_id) that the graph adds to hits(query_id, doc_id, rank): from the acts and sections of
    each query's best rows and of its hints; the limit holds for each query."""
    best = hits.where(F.col("rank") <= top).select("query_id", "doc_id").join(chunks.select("doc_id", "act", "section"), "doc_id")
    from_hits = best.where(_blank("act") != "").select("query_id", "act", F.nullif(F.col("section"), F.lit("")).alias("section"))
    hint = queries.where(_blank("act_hint") != "").select("query_id", F.col("act_hint").alias("act"), F.explode_outer("sections").alias("section"))
    asked = (
        from_hits.unionByName(hint)
        .groupBy("query_id", "act")
        .agg(F.collect_set(F.upper("section")).alias("_own"))
        .join(queries.select("query_id", "sections"), "query_id")
        .select("query_id", "act", F.when(F.size("_own") > 0, F.col("_own")).otherwise(F.col("sections")).alias("sections"))
    )
    new = candidate_ids(graph, asked, None).join(hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))
    return new.withColumn("_rn", rank).where(F.col("_rn") <= limit).drop("_rn")


def graph_vector_hits(chunks: DataFrame, queries: DataFrame, graph: Graph, k: int = 10, most: int = 2000) -> DataFrame:
    """(query_id, doc_id, dist, rank): nearest chunks among a query's graph candidates, filled up from all
    chunks of its act where fewer than max(5, k // 2) are found. A query with more than `most` candidates
    is not restricted by them."""
    from quarry.operators.vector import distance

    asked = queries.select("query_id", F.col("act_hint").alias("act"), "sections")
    ids = candidate_ids(graph, asked, None)
    size = ids.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = chunks.select("doc_id", "act", "embedding")
    wanted = queries.select("query_id", "vec", F.col("act_hint").alias("_act"))
    at = lambda df: df.select("query_id", "doc_id", distance(F.col("embedding"), F.col("vec")).alias("dist"))
    inside = at(
        ids.join(size.where(F.col("_n") <= most), "query_id", "left_semi")
        .join(rows, "doc_id")
        .join(wanted, "query_id")
        .where(F.col("act") == F.col("_act"))
    )
    rank = lambda *o: F.row_number().over(Window.partitionBy("query_id").orderBy(*o))
    first = inside.withColumn("_rn", rank("dist", "doc_id")).where(F.col("_rn") <= k).drop("_rn")
    enough = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= max(5, k // 2))
    more = at(rows.join(wanted.join(enough, "query_id", "left_anti"), rows.act == F.col("_act")))
    more = more.join(first.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    every = first.withColumn("_from", F.lit(0)).unionByName(more.withColumn("_from", F.lit(1)))
    return every.withColumn("rank", rank("_from", "dist", "doc_id")).where(F.col("rank") <= k).drop("_from")
