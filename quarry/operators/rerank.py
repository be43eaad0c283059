"""Reranking of a query's candidates, a bounded number of rows each."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import score


def _with_rank(df: DataFrame):
    """The schema of df with rank as int."""
    return df.drop("rank").withColumn("rank", F.lit(0)).schema


def mmr(pool: DataFrame, k: int, trade: float = 0.7, section_penalty: float = 0.2, case_penalty: float = 0.1) -> DataFrame:
    """The k rows of each query that are near it and unlike each other, ranked in order of choice.

    pool(query_id, rank, embedding, vec, source_path, act, section, optional case_id). Each choice
    depends on those before, so a query's rows, at most its fetch size, are handled together.
    """
    names = [f.name for f in _with_rank(pool)]
    has_case = "case_id" in pool.columns

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank").reset_index(drop=True)
        if len(rows) > k:
            x, q = np.array(rows["embedding"].tolist(), float), np.array(rows["vec"].iloc[0], float)
            to_query = x @ q / (np.linalg.norm(x, axis=1) * np.linalg.norm(q) + 1e-9)
            unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
            place = list(zip(*(rows[c].where(rows[c].notna(), None) for c in ("source_path", "act", "section"))))
            case = rows["case_id"].where(rows["case_id"].notna(), None).tolist() if has_case else [None] * len(rows)
            near, malus = np.full(len(rows), -np.inf), np.zeros(len(rows))
            same_place, same_case = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
            chosen, free, now = [], np.ones(len(rows), bool), int(np.argmax(to_query))
            while True:
                chosen.append(now)
                free[now] = False
                if len(chosen) == k:
                    break
                near = np.maximum(near, unit @ unit[now])
                if place[now] != (None, None, None):
                    same_place |= np.array([p == place[now] for p in place])
                if case[now]:
                    same_case |= np.array([c == case[now] for c in case])
                malus = section_penalty * same_place + case_penalty * same_case
                worth = np.where(free, trade * to_query - (1 - trade) * near - malus, -np.inf)
                now = int(np.argmax(worth))
            rows = rows.iloc[chosen]
        return rows.assign(rank=np.arange(1, len(rows) + 1, dtype=np.int32))[names]

    return pool.groupBy("query_id").applyInPandas(choose, _with_rank(pool))


def cross_encoded(pool: DataFrame, scorer, batch: int = 8) -> DataFrame:
    """pool(query_id, question, text, rank) reranked by scorer(list of (question, text)) -> list of numbers."""

    @F.pandas_udf(T.DoubleType())
    def run(question: pd.Series, text: pd.Series) -> pd.Series:
        pairs = list(zip(question, text))
        return pd.Series([float(s) for a in range(0, len(pairs), batch) for s in scorer(pairs[a : a + batch])])

    order = Window.partitionBy("query_id").orderBy(F.desc("pair_score"), "_before")
    return (
        pool.withColumn("pair_score", run("question", "text"))
        .withColumnRenamed("rank", "_before")
        .withColumn("rank", F.row_number().over(order))
        .drop("_before")
    )


def by_authority(pool: DataFrame, terms) -> DataFrame:
    """pool(query_id, rank, text, act, section, doc_type) by authority points; earlier rank breaks ties."""
    points = score.authority(F.col("text"), F.col("act"), F.col("section"), F.col("doc_type"), terms)
    order = Window.partitionBy("query_id").orderBy(F.desc("authority"), "_before")
    return (
        pool.withColumn("authority", points).withColumnRenamed("rank", "_before").withColumn("rank", F.row_number().over(order)).drop("_before")
    )
