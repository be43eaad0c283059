"""Token counts as an exact length histogram.

Every text is encoded whole. Documents are then counted by encoded length, and suffix sums over the
histogram answer, for every context limit at once: how many documents and tokens reach it, how many
tokens remain when texts are cut to it, and quantiles of length. The histogram has a row for each
length that occurs, so all answers cost nothing beside the encoding.

Edge cases: a null text has length 0; repeated rows count each; an empty table gives no rows; other
columns are ignored. The vocabulary's path is a parameter; its file, read on the driver, is broadcast
if it has at most VOCABULARY_BYTES and refused otherwise.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
VOCABULARY_BYTES = 64 << 20
#: Fixed value: how the byte-level vocabularies cut text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths whose sums are taken together first.
BLOCK = 1024

_ENCODINGS: dict = {}


def _encoding(name, raw: bytes):
    """The encoder, built once in each Python worker."""
    if name not in _ENCODINGS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x)}
        _ENCODINGS[name] = tiktoken.Encoding(str(name), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[name]


def vocabulary(spark: SparkSession, path: str = VOCABULARY):
    if os.path.getsize(path) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def lengths(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of docs(doc_id, text)."""
    raw = vocabulary(docs.sparkSession, path)

    def run(batches):
        encoder = _encoding(path, raw.value)
        for batch in batches:
            n = [len(encoder.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(n, np.int64))], ["doc_id", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long")


def histogram(counted: DataFrame) -> DataFrame:
    """(n_tokens, n_docs)."""
    return counted.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """hist with docs_at_least, tokens_at_least, docs_at_most, total_docs, total_tokens, truncated_tokens
    and share_at_most; truncated_tokens: what is left when every text is cut to n_tokens.

    Sums run inside blocks of lengths in parallel and over the few blocks after that.
    """
    up = Window.partitionBy("_block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    rows = hist.withColumn("_block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("_tokens", F.col("n_tokens") * F.col("n_docs"))
    later = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = rows.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    blocks = blocks.select(
        "_block",
        F.coalesce(F.sum("_d").over(later), F.lit(0)).alias("_docs_after"),
        F.coalesce(F.sum("_t").over(later), F.lit(0)).alias("_tokens_after"),
        F.sum("_d").over(whole).alias("total_docs"),
        F.sum("_t").over(whole).alias("total_tokens"),
    )
    return (
        rows.withColumn("_own_docs", F.sum("n_docs").over(up))
        .withColumn("_own_tokens", F.sum("_tokens").over(up))
        .join(blocks, "_block")
        .select(
            "n_tokens",
            "n_docs",
            (F.col("_own_docs") + F.col("_docs_after")).alias("docs_at_least"),
            (F.col("_own_tokens") + F.col("_tokens_after")).alias("tokens_at_least"),
            "total_docs",
            "total_tokens",
        )
        .withColumn("docs_at_most", F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs"))
        .withColumn("truncated_tokens", F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least"))
        .withColumn("share_at_most", F.col("docs_at_most") / F.col("total_docs"))
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least this share of documents does not exceed."""
    each = sums.withColumn("share", F.explode(F.array(*(F.lit(float(x)) for x in shares))))
    return each.where(F.col("docs_at_most") >= F.col("share") * F.col("total_docs")).groupBy("share").agg(
        F.min("n_tokens").alias("n_tokens")
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context, docs_over, truncated_tokens) for each context limit, whether or not it occurs as a length."""
    each = sums.withColumn("context", F.explode(F.array(*(F.lit(int(x)).cast("long") for x in limits))))
    return each.groupBy("context").agg(
        F.sum(F.when(F.col("n_tokens") > F.col("context"), F.col("n_docs")).otherwise(0)).alias("docs_over"),
        F.sum(F.least("n_tokens", "context") * F.col("n_docs")).alias("truncated_tokens"),
    )
