"""Files as rows: discovery, preference among formats, fingerprints, archives."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Which format of a document is read if several lie side by side.
PREFERENCE = {"json": 3, "md": 2}
EXTENSIONS = ("json", "md")


def discover(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, content: bool = True, exclude: str | None = None) -> DataFrame:
    """(rel, path, length, modified, content) of the files below root with these extensions."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
        .load(root)
    )
    rel = F.regexp_replace(F.replace("path", F.lit("%20"), F.lit(" ")), r"^.*?" + _literal(root.rstrip("/").split(":")[-1].lstrip("/")) + "/", "")
    out = files.select(rel.alias("rel"), "path", "length", F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    return out.where(~F.col("rel").contains(exclude)) if exclude else out


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def preferred(files: DataFrame) -> DataFrame:
    """Of files of one folder and stem, that of the richest format; the first by name if they tie."""
    stem = F.regexp_replace("rel", r"\.[^./]+$", "")
    worth = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in PREFERENCE.items() for x in kv)), extension(F.col("rel"))), F.lit(0))
    rank = F.row_number().over(Window.partitionBy(stem).orderBy(F.desc(worth), "rel"))
    return files.withColumn("_rn", rank).where("_rn = 1").drop("_rn")


def fingerprint(by_content: bool = False) -> Column:
    """stat:size:modified or sha256:digest, of a file row."""
    if by_content:
        return F.concat(F.lit("sha256:"), F.sha2("content", 256))
    return F.concat_ws(":", F.lit("stat"), F.col("length").cast("string"), F.unix_micros("modified").cast("string"))


def identity(mark: Column) -> Column:
    """The token of a fingerprint that goes into chunk ids."""
    return F.when(mark.startswith("sha256:"), F.substring_index(mark, ":", -1)).otherwise(F.sha1(F.encode(mark, "UTF-8")))


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 without a byte order mark, bad bytes replaced."""
    return F.regexp_replace(F.decode(content, "UTF-8"), "^﻿", "")


def unzipped(archives: DataFrame, extensions: tuple[str, ...] = ("pdf", "json", "md", "txt")) -> DataFrame:
    """(rel, content) of the members of zip archives; folders are dropped from names that try to leave."""

    def run(batches):
        for batch in batches:
            names, data = [], []
            for raw in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(raw.as_py())) as z:
                    for info in z.infolist():
                        name = "/".join(p for p in info.filename.split("/") if p not in ("", ".", ".."))
                        if not info.is_dir() and name.lower().rsplit(".", 1)[-1] in extensions:
                            names.append(name)
                            data.append(z.read(info))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(data, pa.binary())], ["rel", "content"])

    return archives.select("content").mapInArrow(run, "rel string, content binary")


def inventory(chunks: DataFrame) -> DataFrame:
    """(source, name, words): source names and their words, for matching questions."""
    name = F.btrim(F.regexp_replace(F.lower(F.regexp_replace("source", r"\.[^.]*$", "")), "[^a-z0-9]+", " "))
    return chunks.select("source").distinct().where("source <> ''").select(
        "source", name.alias("name"), F.array_distinct(F.filter(F.split(name, " "), lambda w: F.length(w) > 2)).alias("words")
    )
