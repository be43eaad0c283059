"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontam, langid, mixing, ngram_join, ppm, quality, recompress, secrets, token_counts, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + least(len(w), 5)], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w), 5) - 4)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS d, doc_id AS m FROM w UNION SELECT r.d, l.b FROM r JOIN l ON r.m = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.m AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT d AS doc_id, min(m) AS m FROM r GROUP BY d) m USING (doc_id)
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(table(spark, sf_dir, "documents"))))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s + 1 : s + n], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(0, greatest(len(w), 13) - 12)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, n, s, array_to_string(w[s + 1 : s + n], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.s, dw.n, iw.item_id FROM dw JOIN iw USING (n, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS v FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


#: Of about one response in so many, a torn attempt precedes the record: damage that the reader must salvage from.
TORN_ONE_IN = 50


def op4_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), torn_one_in=TORN_ONE_IN)


OP4_SQL = rf"""
WITH p AS (SELECT page_id, html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_page FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (1 + (((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::INT) >> (15 - 5 * (i % 4))::INT) & 31))::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_page THEN first_page END AS refers_to,
       (page_id = first_page AND NOT contains(coalesce(html, ''), 'WARC/1.')
        AND ('0x' || substr(md5(page_id::VARCHAR), 1, 7))::BIGINT % {TORN_ONE_IN} = 0)::BIGINT AS gaps
FROM f
"""


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.judged(docs.select("doc_id", "text"), rules).select("doc_id", *quality.BASE, "base_failed", "kept", "fired_rule")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.deduplicated(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS first_doc FROM s GROUP BY h),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM s JOIN f USING (h) WHERE doc_id > first_doc),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
k AS (
  SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.p) AS kept, count(*) AS n
  FROM t LEFT JOIN c ON t.doc_id = c.doc_id AND t.p = c.p WHERE c.p IS NULL GROUP BY t.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ppm.scored(table(spark, sf_dir, "documents"))
    held = ppm.remainder(F.col("doc_id"), ppm.HELD_OUT_OF) == ppm.HELD_OUT
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = ppm.remainder(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.where(~held))
    return langid.predicted(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "repeats", "excerpt_size"
    )


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, (r - 1) % 3 + 1 AS weight, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / ((r - 1) % 3 + 1) AS full_at FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER a, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER a, 0)) AS level
  FROM w WINDOW a AS (ORDER BY full_at, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT level FROM l WHERE level <= full_at ORDER BY full_at, r LIMIT 1),
t AS (SELECT source, source_size, least(cap, (SELECT level FROM lev) * weight) AS target FROM l),
x AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('20240:' || doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
y AS (SELECT *, floor(rate)::BIGINT AS repeats, size * (rate - floor(rate)) AS part FROM x),
z AS (SELECT *, least(floor(part)::BIGINT + (u < part - floor(part))::BIGINT, size * 3 - size * repeats, size) AS excerpt_size FROM y)
SELECT doc_id, size, source_size, round(target, 6) AS target, size * repeats + excerpt_size AS taken, repeats, excerpt_size FROM z
"""


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_token_counts": op2_token_counts,
        "op3_decontamination": op3_decontamination,
        "op4_warc_salvage": op4_warc_salvage,
        "op5_quality_rules": op5_quality_rules,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_lm_scoring": op7_lm_scoring,
        "op8_language_id": op8_language_id,
        "op9_source_mixing": op9_source_mixing,
        "op10_secret_scans": op10_secret_scans,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_join": OP1_SQL,
        "op3_decontamination": OP3_SQL,
        "op4_warc_salvage": OP4_SQL,
        "op6_substring_dedup": OP6_SQL,
        "op9_source_mixing": OP9_SQL,
    }
