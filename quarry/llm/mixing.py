"""Mixing sources to target weights by capped water-filling.

Edge cases: a null text has size 0; a source of size 0 has target 0 and takes nothing; null is a
source of its own and comes last; an empty table gives no rows; repeated rows count each; columns
beyond those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import textcols
from quarry.llm.tables import written

#: Rows of the source table up to which it is broadcast; beyond, the join shuffles.
BROADCAST_SOURCES = 100_000


def water_fill(sources: DataFrame, max_epochs: float = 3.0, budget: float = 1.0) -> DataFrame:
    """sources(source, source_size, weight) with `target`.

    The budget (a share of the total size) is poured in proportion to weight; a source stops at
    max_epochs times its size and what it leaves over is poured on the rest. Sorted by the level at
    which a source fills up, the filled ones are a prefix, so the final level follows from running
    sums: no iteration is needed.
    """
    ahead = Window.orderBy("_full_at", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (
        sources.withColumn("_cap", F.col("source_size") * F.lit(max_epochs))
        .withColumn("_full_at", F.col("_cap") / F.col("weight"))
        .withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("_pool", F.sum("source_size").over(everything) * F.lit(budget))
        .withColumn("_left", F.col("_pool") - F.coalesce(F.sum("_cap").over(ahead), F.lit(0.0)))
        .withColumn("_open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(ahead), F.lit(0)))
        .withColumn("_level", F.col("_left") / F.col("_open"))
        .withColumn("_fits", F.col("_level") <= F.col("_full_at"))
        .withColumn("_water", F.min_by("_level", F.when(F.col("_fits"), F.struct("_full_at", "_rank"))).over(everything))
    )
    target = F.least(F.col("_cap"), F.coalesce(F.col("_water"), F.col("_full_at")) * F.col("weight"))
    return level.select("source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def cycle_weights(sizes: DataFrame, cycle: int = 3) -> DataFrame:
    """Adds weight 1, 2, .., cycle, repeating over the sources by code point, null last."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sizes.withColumn("weight", (rank - 1) % cycle + 1)


def mix(
    docs: DataFrame,
    size: Column | None = None,
    weights: DataFrame | None = None,
    max_epochs: float = 3.0,
    budget: float = 1.0,
    seed: int = 20240,
) -> DataFrame:
    """Every row of docs with size, source_size, target, repeats, excerpt_start, excerpt_size, taken.

    A document is taken `repeats` times whole and once in part: `excerpt_size` words from word
    `excerpt_start` on. The part's size is the fractional repetition rounded up or down by a seeded
    draw, so a source's words come within a few words of its target however few documents it has.
    weights: (source, weight); by default cycle_weights().
    """
    size = F.size(textcols.words(F.col("text"))).cast("long") if size is None else size
    per = written(
        docs.select("source", size.alias("_size")).groupBy("source").agg(F.sum("_size").alias("source_size")),
        "source-sizes",
    )
    per = cycle_weights(per) if weights is None else per.join(weights, per.source.eqNullSafe(weights.source), "left").select(
        per.source, "source_size", F.coalesce("weight", F.lit(0)).alias("weight")
    )
    fill = water_fill(per.where("weight > 0"), max_epochs, budget).withColumnRenamed("source", "_source")
    if per.count() <= BROADCAST_SOURCES:
        fill = F.broadcast(fill)
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "weight")]
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    part = F.col("size") * (F.col("_rate") - F.col("repeats"))
    draw = textcols.seeded_unit(seed, F.col("doc_id"))
    spot = textcols.seeded_unit(seed + 1, F.col("doc_id"))
    return (
        docs.select(*kept, size.alias("size"))
        .join(fill, F.col("source").eqNullSafe(F.col("_source")), "left")
        .withColumn("target", F.coalesce("target", F.lit(0.0)))
        .withColumn("_rate", rate)
        .withColumn("repeats", F.floor("_rate").cast("long"))
        .withColumn("_part", part)
        .withColumn("excerpt_size", (F.floor("_part") + (draw < F.col("_part") - F.floor("_part")).cast("long")).cast("long"))
        .withColumn("excerpt_size", F.least("excerpt_size", F.floor(F.col("size") * F.lit(max_epochs)).cast("long") - F.col("size") * F.col("repeats"), F.col("size")))
        .withColumn("excerpt_start", F.floor(spot * (F.col("size") - F.col("excerpt_size") + 1)).cast("long"))
        .withColumn("taken", F.col("size") * F.col("repeats") + F.col("excerpt_size"))
        .drop("_source", "weight", "_rate", "_part")
    )


def expanded(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row (doc_id, source, repetition, text) for each whole and partial repetition."""
    parts = F.expr("sequence(0L, repeats)")
    return (
        mixed.withColumn("repetition", F.explode(parts))
        .where((F.col("repetition") < F.col("repeats")) | (F.col("excerpt_size") > 0))
        .withColumn(
            "text",
            F.when(F.col("repetition") < F.col("repeats"), F.col("text")).otherwise(
                F.array_join(
                    F.slice(textcols.words(F.col("text")), F.col("excerpt_start").cast("int") + 1, F.col("excerpt_size").cast("int")), " "
                )
            ),
        )
        .select("doc_id", "source", "repetition", "text")
    )
