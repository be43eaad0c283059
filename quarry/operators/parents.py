"""Sections put together again from their chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _clean(c: str) -> Column:
    return F.nullif(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(""))


def chunk_index(doc_id: Column) -> Column:
    """i of an id path:i:hash, else null."""
    return F.nullif(F.regexp_extract(F.coalesce(doc_id, F.lit("")), r"^.*:([0-9]+):[^:]*$", 1), F.lit("")).cast("long")


def source_of(doc_id: Column) -> Column:
    """path of an id path:i:hash, else null."""
    return F.nullif(F.regexp_extract(F.coalesce(doc_id, F.lit("")), r"^(.*):[^:]*:[^:]*$", 1), F.lit(""))


def reconstructed(selected: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """One row for each section of selected, its text joined from all its chunks in pool.

    selected(rank, doc_id, source_path, source, act, section, text, paragraph_number, paragraph_start);
    pool: the same with `rank` as its order, by default selected. Chunks are ordered by paragraph number,
    else start, else the index in their id. Rows without source, act or section pass through as they are.
    """
    pool = selected if pool is None else pool
    key = F.struct(
        F.coalesce(_clean("source_path"), source_of(F.col("doc_id")), _clean("source")).alias("s"), _clean("act").alias("a"), _clean("section").alias("n")
    )
    whole = F.col("_key.s").isNotNull() & F.col("_key.a").isNotNull() & F.col("_key.n").isNotNull()
    place = (
        F.when(F.col("paragraph_number").isNotNull(), F.struct(F.lit(0).alias("c"), F.col("paragraph_number").cast("long").alias("v")))
        .when(F.col("paragraph_start").isNotNull(), F.struct(F.lit(1).alias("c"), F.col("paragraph_start").cast("long").alias("v")))
        .when(chunk_index(F.col("doc_id")).isNotNull(), F.struct(F.lit(2).alias("c"), chunk_index(F.col("doc_id")).alias("v")))
        .otherwise(F.struct(F.lit(3).alias("c"), F.lit(0).cast("long").alias("v")))
    )
    first = (
        selected.withColumn("_key", key)
        .withColumn("_whole", whole)
        .withColumn("_rn", F.row_number().over(Window.partitionBy("_key").orderBy("rank", "doc_id")))
        .where("NOT _whole OR _rn = 1")
    )
    # Only pool rows of chosen sections are grouped, so a group is a section's chunks.
    wanted = first.where("_whole").select("_key")
    joined = (
        pool.withColumn("_key", key)
        .where(whole)
        .join(wanted, "_key", "left_semi")
        .where(_clean("text").isNotNull())
        .groupBy("_key")
        .agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col("rank").alias("r"), F.trim("text").alias("t")))).alias("_parts"))
        .select("_key", F.array_join(F.transform("_parts", lambda x: x["t"]), "\n\n").alias("_text"))
    )
    return (
        first.join(joined, "_key", "left")
        .withColumn("parent_reconstructed", F.col("_whole"))
        .withColumn("text", F.when(F.col("_whole"), F.coalesce("_text", F.lit(""))).otherwise(F.col("text")))
        .drop("_key", "_whole", "_rn", "_text")
    )
