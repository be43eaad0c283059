"""Column expressions shared by the text operators; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space that separates words.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """array<string> of the maximal runs without ASCII white space; empty for null or blank text."""
    body = F.btrim(text, F.lit(SPACES))
    return F.when(body.isNull() | (body == ""), F.array().cast("array<string>")).otherwise(
        F.split(body, SPACE_RUN)
    )


def seeded_unit(seed: int, key: Column) -> Column:
    """A double in [0, 1) that depends on seed and key alone, so that reruns agree."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """df filtered by a condition on costly computed columns.

    Catalyst would push the filter below their projections and write the expressions out once for each
    mention; a row number that the filter reads keeps it where it is, so each is computed once.
    """
    held = df.withColumn("_row", F.monotonically_increasing_id())
    return held.where(condition & (F.col("_row") >= 0)).drop("_row")
