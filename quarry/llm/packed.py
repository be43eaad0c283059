"""Rows dealt out by bucket as packed byte blocks, so that a shuffle moves few and large rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm import wordhash

BLOCKS = "bucket int, kind int, payload binary"


def dealt(bucket: np.ndarray, rows: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows, a 2-d or structured array, cut by bucket."""
    if not len(rows):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    first, length = wordhash.runs(bucket)
    data = [rows[f : f + k].tobytes() for f, k in zip(first, length)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(bucket[first].astype(np.int32)), pa.array(np.full(len(first), kind, np.int32)), pa.array(data, pa.binary())],
        ["bucket", "kind", "payload"],
    )


def by_bucket(blocks: DataFrame) -> DataFrame:
    """blocks with each bucket's rows together, bucket after bucket."""
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(parts, "bucket").sortWithinPartitions("bucket")


def buckets(df: DataFrame) -> int:
    """Enough buckets that one fits in memory however many rows there are for each partition."""
    return max(2048, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def grouped(batches) -> Iterator[tuple[int, dict[int, bytes]]]:
    """(bucket, {kind: bytes}) from what by_bucket() gives."""
    last, found = None, {}
    for batch in batches:
        for bucket, kind, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if bucket != last and found:
                yield last, {k: b"".join(v) for k, v in found.items()}
                found = {}
            last = bucket
            found.setdefault(kind, []).append(payload.as_buffer())
    if found:
        yield last, {k: b"".join(v) for k, v in found.items()}
