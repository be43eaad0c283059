"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it and rereads it as the
next stage's docs. All but the last return the columns of documents, further columns of any name
included. A null doc_id is a document of its own everywhere; of rows that repeat a doc_id one stays; a
null or empty text fails the quality rules; texts may have any length; an empty table passes through
as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import decontam, mixing, ngram_join, quality, secrets, textcols
from quarry.llm.tables import written


def _bare(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns as one, out of reach of the names that operators add."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest, F.lit(0).alias("_")).alias("_rest"))


def _dressed(bare: DataFrame, docs: DataFrame) -> DataFrame:
    """bare's rows with the columns of docs."""
    return bare.select(*(c if c in ("doc_id", "text") else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    rules = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _dressed(textcols.where_computed(quality.judged(_bare(docs), rules), F.col("kept")), docs)


def one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one of the smallest doc_id; of rows that repeat it, the first by text
    and the other columns. Rows without doc_id are judged by text alone: they stay, since no row can stand for them."""
    first = ngram_join.join(docs).where("doc_id = component_id").select(F.col("doc_id").alias("_first_id")).distinct()
    bare = _bare(docs)
    named = bare.join(first, bare.doc_id == F.col("_first_id"), "left_semi").withColumn(
        "_nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("text", "_rest"))
    )
    return _dressed(named.where("_nth = 1").drop("_nth").union(bare.where("doc_id IS NULL")), docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no whole benchmark window, however long they are, and of which less than a twentieth is
    passages of items too short for one."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    clean = ~(F.col("holds_window") | F.col("contaminated"))
    return _dressed(textcols.where_computed(decontam.contamination(_bare(docs), items), clean), docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets of any encoding layer replaced by their kind."""
    return secrets.redacted_docs(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with how often the mix takes it, whole and in part."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", good_quality),
    ("n-gram jaccard join", one_of_a_kind),
    ("benchmark decontamination", uncontaminated),
    ("secret scans", without_secrets),
    ("mixing sources", mixed),
]

#: The decision list is learned, and secrets are decoded recursively: SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k + 1}")
    return docs
