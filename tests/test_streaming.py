import datetime

from pyspark.sql import functions as F

from quarry.plans import manifest
from quarry.streaming import live


def test_upsert_stream(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"file://{tmp_path}/out"
    schema = "doc_id string, text string"
    for k, rows in enumerate(([("a", "1"), ("b", "1")], [("b", "2"), ("c", "1")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{src}/{k}")
        live.upsert_stream(live.file_stream(spark, src, schema), out, f"{tmp_path}/cp", parts=4).awaitTermination()
    assert {r.doc_id: r.text for r in spark.read.parquet(out).collect()} == {"a": "1", "b": "2", "c": "1"}


def test_late_events_and_windows(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    schema = "ts timestamp, event_type string, value double"
    src = f"{tmp_path}/ev"
    for k, rows in enumerate(([(at(5), "a", 1.0), (at(50), "a", 2.0)], [(at(200), "a", 1.0)], [(at(220), "a", 1.0)], [(at(6), "a", 9.0), (at(300), "a", 1.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{src}/{k}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(src)
    q = live.activity(stream).writeStream.format("memory").queryName("activity").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.start.hour: (r.n, r.total) for r in spark.table("activity").collect()}
    assert got[0] == (2, 3.0)


def test_cache_stream(spark, tmp_path):
    day = lambda d: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d)
    schema = "query string, answer string, ts timestamp"
    src = f"{tmp_path}/q"
    for k, rows in enumerate(([("q", "old", day(0))], [("q", "x", day(7))], [("q", "new", day(9))])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/{k}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(src)
    q = live.cache_stream(stream).writeStream.format("memory").queryName("cached").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.answer, r.hit) for r in spark.table("cached").select("answer", F.col("hit")).collect())
    assert got == [("new", False), ("old", False), ("old", True)]
    assert manifest.SCHEMA_VERSION == 2


def test_upserts_keep_the_last_row_and_never_replace_what_cannot_be_read(spark, tmp_path):
    import pytest

    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "doc_id string, text string, seq long"
    spark.createDataFrame([("a", "z", 1), ("a", "b", 3), ("a", "c", 2)], schema).coalesce(1).write.json(f"{src}/0")
    live.upsert_stream(live.file_stream(spark, src, schema), f"file://{out}", f"{tmp_path}/cp", order="seq", parts=2).awaitTermination()
    assert [r.text for r in spark.read.parquet(f"file://{out}").collect()] == ["b"]
    broken = tmp_path / "out2"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        live.upsert_stream(live.file_stream(spark, src, schema), f"file://{broken}", f"{tmp_path}/cp2", order="seq", parts=2).awaitTermination()
    assert (broken / "part-0.parquet").read_bytes() == b"not parquet"
