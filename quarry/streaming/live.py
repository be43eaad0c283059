"""Structured Streaming: incremental ingestion and an answer cache with a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.plans import manifest
from quarry.plans.tables import exists


def upsert_stream(chunks: DataFrame, path: str, checkpoint: str, key: str = "doc_id", order: str | None = None, parts: int = 64) -> StreamingQuery:
    """Writes a stream of chunks into a manifest.write_partitioned() table. Of a key's rows in one batch the one of
    the greatest `order` column wins; rows that tie in it, or have none, go by all their columns, so reruns agree.

    A batch overwrites whole parts, so a batch that runs twice after a lost executor leaves the same table. A table
    that is there but can't be read is an error: it is never taken for one that is yet to be made.
    """

    def write(batch: DataFrame, _: int) -> None:
        first = [F.desc(c) for c in ([order] if order else [])] + [F.desc(c) for c in batch.columns if c != key]
        one = F.row_number().over(Window.partitionBy(key).orderBy(*first))
        rows = batch.withColumn("_nth_of_key", one).where("_nth_of_key = 1").drop("_nth_of_key")
        spark = batch.sparkSession
        if exists(spark, path):
            manifest.overwrite_parts(spark, path, rows, key, parts=parts)
        else:
            manifest.write_partitioned(rows, path, key, parts)

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_stream(spark: SparkSession, root: str, schema: str, pattern: str = "*.json", per_batch: int = 25) -> DataFrame:
    """New JSON files below root as a stream."""
    return (
        spark.readStream.format("json").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", per_batch).load(root)
    )


def activity(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) over tumbling windows; later events than the watermark are dropped."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", window), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )


def cache_stream(events: DataFrame, days: int = 7) -> DataFrame:
    """(query, answer, hit) of events(query, answer, ts): whether the last answer was still alive.

    State is one answer for each query; it times out when the watermark passes its end.
    """
    life = (days + 1) * 86_400_000

    def serve(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        answer, since = state.get if state.exists else (None, None)
        for rows in batches:
            out = []
            for r in rows.sort_values("ts").itertuples():
                at = r.ts.value // 1_000_000
                hit = since is not None and at - since < life
                if not hit:
                    answer, since = r.answer, at
                out.append((key[0], answer, hit))
            yield pd.DataFrame(out, columns=["query", "answer", "hit"])
        state.update((answer, since))
        state.setTimeoutTimestamp(max(since + life, state.getCurrentWatermarkMs() + 1))

    return (
        events.withWatermark("ts", "1 day")
        .groupBy("query")
        .applyInPandasWithState(serve, "query string, answer string, hit boolean", "answer string, since long", "append", GroupStateTimeout.EventTimeTimeout)
    )
