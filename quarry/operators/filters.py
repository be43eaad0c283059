"""Metadata filters: where-dicts as Column predicates, and look-ups by them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compile_where(where: dict | None) -> Column | None:
    """A predicate for equality, $in, $and and $or; several keys all hold; None if nothing is asked.

    Values are compared as strings, and a null column equals the empty string. Other operators raise.
    """
    if not where:
        return None
    parts = []
    for key, want in where.items():
        if key in ("$and", "$or"):
            inner = [c for c in map(compile_where, want or []) if c is not None]
            if inner:
                parts.append(reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), inner))
        elif key.startswith("$"):
            raise ValueError(f"unsupported operator {key}")
        else:
            column = F.coalesce(F.col(key).cast("string"), F.lit(""))
            if isinstance(want, dict):
                if set(want) != {"$in"}:
                    raise ValueError(f"unsupported operator in {want}")
                parts.append(column.isin(*(_text(v) for v in want["$in"])))
            else:
                parts.append(column == _text(want))
    return reduce(lambda a, b: a & b, parts) if parts else None


def _text(value) -> str:
    return "" if value is None else str(value)


def lookup(chunks: DataFrame, where: dict | None, limit: int | None = 10_000, order: str = "doc_id") -> DataFrame:
    """The first rows by `order` that a filter lets through; none for an empty filter."""
    condition = compile_where(where)
    if condition is None:
        return chunks.limit(0)
    found = chunks.where(condition)
    return found if limit is None else found.orderBy(order).limit(limit)


def by_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of chunks whose doc_id is in ids(doc_id); Spark picks a broadcast if ids are few."""
    return chunks.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def injected(chunks: DataFrame, where: dict, limit: int = 10_000) -> DataFrame:
    """lookup() with the mark of documents that the knowledge layer brings in."""
    return lookup(chunks, where, limit).withColumn("kb_injected", F.lit(True))


def anchored_by_name(candidates: DataFrame, key: str = "query_id") -> DataFrame:
    """candidates(query, text) with a question word of four letters or more; all of a question's if none has."""
    from pyspark.sql import Window

    words = F.filter(F.split(F.lower("query"), r"\s+"), lambda w: F.length(w) > 3)
    hit = F.exists(words, lambda w: F.lower(F.col("text")).contains(w))
    rows = candidates.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    return rows.withColumn("_any", F.max("_hit").over(Window.partitionBy(key))).where("_hit OR NOT _any").drop("_hit", "_any")
