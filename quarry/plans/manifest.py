"""Keeping derived tables in step with files: diffs, upserts and rebuilds on plain Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.plans.tables import drop_path, exists

SCHEMA_VERSION = 2


def diff(manifest: DataFrame, current: DataFrame, store_is_empty: bool = False, version: int = SCHEMA_VERSION) -> DataFrame:
    """(rel, action, doc_ids, old, new): new, changed, unchanged or removed.

    manifest(rel, fingerprint, doc_ids, schema_version), current(rel, fingerprint). Files without a known
    fingerprint are changed; so is everything if the store is empty, and Markdown under an older version.
    """
    old = manifest.select("rel", F.col("fingerprint").alias("old"), "doc_ids", "schema_version")
    both = old.join(current.select("rel", F.col("fingerprint").alias("new")), "rel", "full_outer")
    stale = (F.coalesce("schema_version", F.lit(0)) < version) & F.col("rel").endswith(".md")
    action = (
        F.when(F.col("new").isNull(), "removed")
        .when(F.col("schema_version").isNull() & F.col("old").isNull() & F.col("doc_ids").isNull(), "new")
        .when(F.lit(store_is_empty) | stale | ~F.col("old").eqNullSafe(F.col("new")), "changed")
        .otherwise("unchanged")
    )
    return both.select("rel", action.alias("action"), "doc_ids", "old", "new")


def replaced_ids(changes: DataFrame) -> DataFrame:
    """doc_ids that go: those of changed and removed files."""
    return changes.where(F.col("action").isin("changed", "removed")).select(F.explode("doc_ids").alias("doc_id")).distinct()


def upserted(table: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """table with rows of new in place of those of the same key. Of rows of new that repeat a key one stays, the last
    by its columns; a null key never replaces."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in table.columns if c != key)))
    new = new.select(*table.columns).withColumn("_nth_of_key", last).where(f"_nth_of_key = 1 OR `{key}` IS NULL").drop("_nth_of_key")
    return table.join(new.select(key).distinct(), key, "left_anti").select(*table.columns).unionByName(new.select(*table.columns))


def deleted(table: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti").select(*table.columns)


def rebuilt(chunks: DataFrame) -> DataFrame:
    """(rel, doc_ids): the manifest from chunks(doc_id, metadata_json)."""
    path = F.nullif(F.trim(F.get_json_object("metadata_json", "$.source_path")), F.lit(""))
    prefix = F.nullif(F.regexp_extract("doc_id", r"^(.*):[^:]*:[^:]*$", 1), F.lit(""))
    rel = F.regexp_replace(F.coalesce(path, prefix), r"\\", "/")
    return chunks.select(rel.alias("rel"), "doc_id").where("rel IS NOT NULL").groupBy("rel").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))


def backfilled(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """manifest with fingerprints of current files where it had none."""
    now = current.select("rel", F.col("fingerprint").alias("_now"))
    return manifest.join(now, "rel", "left").withColumn("fingerprint", F.coalesce("fingerprint", "_now")).drop("_now")


def advanced(manifest: DataFrame, changes: DataFrame, chunks: DataFrame, failed: DataFrame | None = None, version: int = SCHEMA_VERSION) -> DataFrame:
    """The manifest after a sync: unchanged entries, and entries of what chunks(rel, doc_id) now holds.
    Files in failed(rel) have no entry, so the next sync takes them again."""
    same = manifest.join(changes.where("action = 'unchanged'").select("rel"), "rel", "left_semi")
    made = chunks.groupBy("rel").agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))
    taken = changes.where(F.col("action").isin("new", "changed")).select("rel", F.col("new").alias("fingerprint")).join(made, "rel", "left")
    taken = taken.withColumns({"doc_ids": F.coalesce("doc_ids", F.array().cast("array<string>")), "schema_version": F.lit(version)})
    if failed is not None:
        taken = taken.join(failed.select("rel"), "rel", "left_anti")
    return same.select("rel", "fingerprint", "doc_ids", "schema_version").unionByName(taken.select("rel", "fingerprint", "doc_ids", "schema_version"))


def corpus_signature(chunks: DataFrame) -> DataFrame:
    """One row: a digest of (doc_id, text) of the whole table, in any order; keys caches of derived tables.

    Row digests are summed, so that no task sees all rows.
    """
    part = F.conv(F.substring(F.sha2(F.concat_ws("\u0001", F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))), 256), 1, 15), 16, 10)
    return chunks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(part.cast("decimal(38,0)")), F.lit(0)).alias("s")).select(
        F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("s").cast("string")), 256).alias("signature")
    )


def write_partitioned(table: DataFrame, path: str, key: str, parts: int = 64) -> None:
    """table under path, split by a hash of key, so that a later overwrite touches changed parts only."""
    table.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts))).write.mode("overwrite").partitionBy("part").parquet(path)


def overwrite_parts(spark: SparkSession, path: str, new: DataFrame, key: str, gone: DataFrame | None = None, parts: int = 64) -> None:
    """Replaces rows of new's keys (and drops gone's) in a table of write_partitioned(), part by part.

    The changed parts are staged beside the table first, in a folder of this call's own: Spark can't overwrite what the
    same plan reads. The staged parts stay until the overwrite is through, so after a lost driver they can be put in
    place again; the overwrite itself replaces parts one after the other and is not atomic for readers.
    """
    old = spark.read.parquet(path)
    touched = new.select(key) if gone is None else new.select(key).union(gone.select(key))
    part = F.pmod(F.xxhash64(key), F.lit(parts))
    which = [r[0] for r in touched.select(part.alias("part")).distinct().collect()]
    rows = old.where(F.col("part").isin(which)).drop("part").join(touched.distinct(), key, "left_anti").select(*new.columns).unionByName(new)
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    rows.withColumn("part", part).write.partitionBy("part").parquet(staged)
    spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    drop_path(spark, staged)


def in_batches(files: DataFrame, most_files: int, most_bytes: int) -> DataFrame:
    """files(rel, length) with `batch`: a batch ends when it has so many files or bytes, in the order of rel.

    The flush policy of a sync: each batch is loaded and written on its own, so memory follows the batch. Only the
    names and sizes of files to load meet in the one running sum.
    """
    run = Window.partitionBy().orderBy("rel").rowsBetween(Window.unboundedPreceding, -1)
    before = F.greatest(
        F.floor(F.coalesce(F.count(F.lit(1)).over(run), F.lit(0)) / most_files), F.floor(F.coalesce(F.sum("length").over(run), F.lit(0)) / most_bytes)
    )
    return files.withColumn("batch", before.cast("long"))


def sync(
    manifest: DataFrame, current: DataFrame, table: DataFrame, load, store_is_empty: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(changes, table, manifest) after load(rows of current to read) -> chunks like table, with rel; or a pair of such
    chunks and failed(rel). What failed keeps its old chunks and gets no entry, so the next sync takes it again."""
    changes = diff(manifest, current, store_is_empty)
    got = load(current.join(changes.where(F.col("action").isin("new", "changed")).select("rel"), "rel", "left_semi"))
    chunks, failed = got if isinstance(got, tuple) else (got, None)
    gone = changes if failed is None else changes.join(failed.select("rel"), "rel", "left_anti")
    if failed is not None:
        chunks = chunks.join(failed.select("rel"), "rel", "left_anti")
    kept = deleted(table, replaced_ids(gone))
    return changes, upserted(kept, chunks), advanced(manifest, changes, chunks, failed)


def saved(manifest: DataFrame, path: str) -> None:
    """Writes the manifest as a new version under path; the newest whole version is what loaded() reads."""
    spark = manifest.sparkSession
    last = max((int(v) for v in _versions(spark, path)), default=0)
    manifest.write.parquet(f"{path.rstrip('/')}/version={last + 1:010d}")


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Versions under path that were written to their end, oldest first."""
    if not exists(spark, path):
        return []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop)
    names = sorted(x.getPath().getName() for x in found)
    return [n.removeprefix("version=") for n in names if n.startswith("version=") and exists(spark, f"{path.rstrip('/')}/{n}/_SUCCESS")]


def loaded(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version that saved() wrote to its end; None if there is none."""
    versions = _versions(spark, path)
    return spark.read.parquet(f"{path.rstrip('/')}/version={versions[-1]}") if versions else None


def status(table: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: rows of the table and files of the manifest."""
    return table.agg(F.count(F.lit(1)).alias("chunks")).join(manifest.agg(F.count(F.lit(1)).alias("files")))


def unconverted(files: DataFrame, report: DataFrame) -> DataFrame:
    """Files(rel, sig) that no report(rel, sig, status) has as done."""
    return files.join(report.where("status = 'ok'").select("rel", "sig"), ["rel", "sig"], "left_anti")
