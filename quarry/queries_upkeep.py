"""Registered queries of stores, manifests, metadata and look-ups, beside those of quarry.queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import extract, score, text
from quarry.operators import dedup, filters, graph, rerank, vector
from quarry.plans import answer, manifest
from quarry.queries import _ACT_SQL, _ANSWER, _BLANK, _ENRICHED, _KNN, STATUTES, query, statutes, table
from quarry.sources import documents, files


@query(
    f"""WITH {STATUTES}, {_ENRICHED} SELECT doc_id, act, coalesce(CASE WHEN id % 3 = 0 THEN '7C' END, nullif(section, ''), found) AS section,
      CASE WHEN id % 2 = 0 THEN 'given' ELSE nullif(doc_type, '') END AS doc_type FROM x"""
)
def stored_rows(spark, sf_dir):
    """Typed columns, overridden by keys of the JSON, blanks filled from the text."""
    keys = F.struct(F.when(F.col("id") % 3 == 0, "7C").alias("section"), F.when(F.col("id") % 2 == 0, "given").alias("doc_type"))
    rows = statutes(spark, sf_dir).withColumn("metadata_json", F.to_json(keys))
    return documents.stored_row(rows, ["source", "source_path", "act", "section", "doc_type"]).select("doc_id", "act", "section", "doc_type")


_PATH = (
    "concat('acts/', o_custkey % 7, CASE o_orderkey % 4 WHEN 0 THEN '/The_Limitation-Act_1963.md' WHEN 1 THEN '/indian_contract_act.v2.json'"
    " WHEN 2 THEN '/my__own-file.txt' ELSE concat('/notes_', o_orderkey % 9) END)"
)


@query(
    rf"""WITH p AS (SELECT o_orderkey AS id, {_PATH} AS path FROM orders),
    n AS (SELECT id, trim(regexp_replace(regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\.[^.]*$', '\1'), '[_-]', ' ', 'g')) AS text FROM p)
    SELECT id, coalesce({_ACT_SQL}, regexp_replace(text, '\s+', ' ', 'g')) AS act FROM n"""
)
def acts_of_paths(spark, sf_dir):
    """E6."""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", f"{_PATH} AS path").select("id", extract.act_of_path(F.col("path")).alias("act"))


@query("SELECT doc_id, true AS kb_injected FROM documents WHERE lang = 'fr'")
def injected_documents(spark, sf_dir):
    """P4."""
    return filters.injected(table(spark, sf_dir, "documents"), {"lang": "fr"}, limit=None).select("doc_id", "kb_injected")


_ASK = "CASE WHEN id % 50 < 20 THEN 'What of DAMAGES due' WHEN id % 50 < 35 THEN 'the zzzz of it' ELSE 'On appeal' END"


@query(
    f"""WITH {STATUTES}, c AS (SELECT doc_id, id % 50 AS query_id, text, list_filter(string_split(lower({_ASK}), ' '), lambda w: length(w) > 3) AS ws FROM st),
    h AS (SELECT *, len(list_filter(ws, lambda w: contains(lower(text), w))) > 0 AS hit FROM c)
    SELECT query_id, doc_id FROM (SELECT *, max(hit) OVER (PARTITION BY query_id) AS any_hit FROM h) WHERE hit OR NOT any_hit"""
)
def anchored_candidates(spark, sf_dir):
    """P7."""
    rows = statutes(spark, sf_dir).selectExpr("doc_id", "id % 50 AS query_id", "text", f"{_ASK} AS query")
    return filters.anchored_by_name(rows).select("query_id", "doc_id")


@query(
    rf"""WITH w AS (SELECT doc_id, trim(text, {_BLANK}) AS raw FROM documents), x AS (SELECT *, regexp_extract_all(raw, '\S+')[1:50000] AS ws FROM w)
    SELECT doc_id, length(raw) < 300 OR len(ws) = 0 OR (length(raw) - length(replace(raw, ' ', ''))) / greatest(length(raw), 1) < 0.02
      OR length(regexp_replace(array_to_string(ws, ''), '\P{{L}}', '', 'g')) / greatest(len(ws), 1) > 12 AS poor FROM x"""
)
def letters_quality(spark, sf_dir):
    """E8."""
    return table(spark, sf_dir, "documents").select("doc_id", text.is_poor_letters(F.col("text")).alias("poor"))


@query("SELECT p_partkey::VARCHAR AS rel, p_size AS sig FROM part WHERE NOT (p_partkey % 3 = 0 AND p_partkey % 2 = 0 AND p_size % 5 <> 0)")
def unconverted_files(spark, sf_dir):
    """What no report has as done, by the same signature."""
    rows = table(spark, sf_dir, "part").selectExpr("CAST(p_partkey AS STRING) AS rel", "p_size AS sig", "p_partkey AS k")
    report = rows.where("k % 3 = 0").selectExpr("rel", "CASE WHEN sig % 5 = 0 THEN sig + 1000 ELSE sig END AS sig", "CASE WHEN k % 2 = 0 THEN 'ok' ELSE 'failed' END AS status")
    return manifest.unconverted(rows, report).select("rel", "sig")


@query(f"WITH {STATUTES} SELECT count(*)::BIGINT AS chunks, count(DISTINCT source_path)::BIGINT AS files FROM st")
def store_status(spark, sf_dir):
    """K17, K14."""
    rows = statutes(spark, sf_dir)
    return manifest.status(rows, manifest.rebuilt(rows.withColumn("metadata_json", F.to_json(F.struct("source_path")))))


_OLD, _NOW = "source <> 'src3' AND doc_id % 7 <> 0", "source <> 'src4' AND (doc_id % 7 <> 0 OR source IN ('src1', 'src2', 'src5'))"


@query(
    f"""WITH o AS (SELECT source AS rel, md5(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS f, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) AS ids FROM documents WHERE {_OLD} GROUP BY source),
    c AS (SELECT source AS rel, md5(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS f, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) AS ids FROM documents WHERE {_NOW} GROUP BY source)
    SELECT c.rel, md5(CASE WHEN o.f = c.f THEN o.ids ELSE c.ids END) AS digest FROM c LEFT JOIN o USING (rel) WHERE o.f = c.f OR c.rel <> 'src5'"""
)
def manifest_after_failures(spark, sf_dir):
    """Entries after a sync in which one file failed; it has none, so the next sync takes it again."""
    docs = table(spark, sf_dir, "documents").where("source IS NOT NULL")
    ids = F.array_sort(F.collect_list("doc_id"))
    state = lambda d: d.groupBy(F.col("source").alias("rel")).agg(ids.alias("_i")).select("rel", F.md5(F.encode(F.array_join("_i", ","), "UTF-8")).alias("fingerprint"), F.array_sort(F.transform("_i", lambda x: x.cast("string"))).alias("doc_ids"))
    old = state(docs.where(_OLD)).withColumn("schema_version", F.lit(2))
    changes = manifest.diff(old, state(docs.where(_NOW)))
    chunks = docs.where(_NOW).select(F.col("source").alias("rel"), F.col("doc_id").cast("string").alias("doc_id"))
    failed = changes.where("rel = 'src5' AND action IN ('new', 'changed')").select("rel")
    return manifest.advanced(old, changes, chunks, failed).select("rel", F.md5(F.encode(F.array_join("doc_ids", ","), "UTF-8")).alias("digest"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'kept' ELSE concat('now', o_orderkey % 10) END AS fingerprint FROM orders")
def manifest_backfill(spark, sf_dir):
    """Fingerprints where the manifest had none."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("rel"))
    old = rows.withColumn("fingerprint", F.when(F.col("id") % 2 == 0, "kept"))
    now = rows.select("rel", F.concat(F.lit("now"), (F.col("id") % 10).cast("string")).alias("fingerprint"))
    return manifest.backfilled(old, now).select("id", "fingerprint")


@query(
    """SELECT o_orderkey AS id, concat('stat:', o_custkey, ':', epoch_us(o_orderdate::TIMESTAMP)) AS mark,
    sha1(concat('stat:', o_custkey, ':', epoch_us(o_orderdate::TIMESTAMP))) AS identity, concat('sha256:', sha256(o_orderpriority)) AS by_content FROM orders"""
)
def file_fingerprints(spark, sf_dir):
    """K9."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("length"), F.col("o_orderdate").cast("timestamp").alias("modified"), F.encode("o_orderpriority", "UTF-8").alias("content")
    )
    mark = files.fingerprint()
    return rows.select("id", mark.alias("mark"), files.identity(mark).alias("identity"), files.fingerprint(by_content=True).alias("by_content"))


@query(
    """WITH d AS (SELECT ('0x' || substr(sha256(concat(doc_id::VARCHAR, chr(1), coalesce(text, ''))), 1, 15))::BIGINT::HUGEINT AS part FROM documents)
    SELECT sha256(concat(count(*), ':', sum(part))) AS signature FROM d"""
)
def corpus_signature(spark, sf_dir):
    """What the stored lexical index is valid for."""
    return manifest.corpus_signature(table(spark, sf_dir, "documents"))


@query(
    f"""WITH {STATUTES}, rows AS (SELECT id, doc_id, concat(act, '|', section, '||') AS key FROM st WHERE section <> '')
    SELECT DISTINCT key, doc_id FROM rows WHERE (id % 2 = 0 OR id % 3 = 0) AND id % 5 <> 0"""
)
def graph_upkeep(spark, sf_dir):
    """K6, K7, K8: chunks put into the graph in place of older ones, others taken out."""
    none = F.lit(None).cast("string")
    rows = statutes(spark, sf_dir).withColumns({"subsection": none, "clause": none})
    both = graph.upserted(graph.build(rows.where("id % 2 = 0")), graph.build(rows.where("id % 3 = 0")))
    return graph.without_chunks(both, rows.where("id % 5 = 0").select("doc_id")).section_chunks.select("key", "doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('doc:', doc_id) ELSE md5(lower(substr(text, 1, 500))) END AS key FROM documents")
def document_keys(spark, sf_dir):
    """A2: by id where there is one, else by how the text begins."""
    docs = table(spark, sf_dir, "documents")
    given = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).when(F.col("doc_id") % 3 == 0, F.lit(""))
    return docs.select("doc_id", dedup.doc_key(given, F.col("text")).alias("key"))


@query(
    f"""WITH {STATUTES}, r AS (SELECT doc_id, section, row_number() OVER (ORDER BY doc_id) AS n FROM st WHERE act = 'Limitation Act'),
    a AS (SELECT doc_id FROM r WHERE try_cast(section AS BIGINT) BETWEEN 1 AND 40 ORDER BY doc_id LIMIT 80),
    b AS (SELECT doc_id FROM r WHERE section = '' ORDER BY doc_id LIMIT 80)
    SELECT doc_id FROM a UNION SELECT doc_id FROM b UNION SELECT doc_id FROM r WHERE n <= 80"""
)
def overview_documents(spark, sf_dir):
    """The scope of an overview."""
    return answer.overview_scope(statutes(spark, sf_dir), {"act": "Limitation Act"}).select("doc_id")


@query(
    rf"""WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'No source.' ELSE {_ANSWER} END AS answer, (o_orderkey % 10) / 10.0::DOUBLE AS trust FROM orders),
    p AS (SELECT *, list_filter(list_transform(string_split_regex(answer, '\n\s*\n'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM a),
    c AS (SELECT *, len(list_filter(ps, lambda x: regexp_matches(x, '\[Source\s+\d+\s*[:\]]'))) / len(ps) < 0.5 AS few,
      CASE WHEN regexp_matches(answer, '\[Source\s+\d+\s*[:\]]') THEN trust ELSE least(trust, 0.35) END AS t FROM p)
    SELECT id, concat(answer, chr(10), chr(10), 'Confidence: ', CASE WHEN t >= 0.8 THEN 'High' WHEN t >= 0.6 THEN 'Medium' WHEN t >= 0.4 THEN 'Limited' ELSE 'Low' END,
      CASE WHEN few THEN concat(chr(10), 'Note: some statements carry no source.') ELSE '' END) AS answer FROM c"""
)
def annotated_answers(spark, sf_dir):
    """Answers with their confidence and a note where few paragraphs cite."""
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", f"CASE WHEN o_orderkey % 11 = 0 THEN 'No source.' ELSE {_ANSWER} END AS answer", "CAST(o_orderkey % 10 AS DOUBLE) / 10.0D AS trust"
    )
    return rows.select("id", score.annotated(F.col("answer"), F.col("trust")).alias("answer"))


@query("WITH " + _KNN.replace("WHERE_", "v.doc_id IN (SELECT doc_id FROM labels)") + " SELECT query_id, doc_id, rank FROM kn WHERE rank <= 5")
def knn_within_ids(spark, sf_dir):
    """The search restricted to given ids."""
    from quarry.queries import asked

    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return vector.knn(filters.by_ids(rows, table(spark, sf_dir, "labels")), asked(spark, sf_dir), 5).select("query_id", "doc_id", "rank")


@query("SELECT vec_id, len(embedding) = 64 AND vec_id % 7 <> 0 AND vec_id % 11 <> 0 AS good FROM embeddings")
def vector_dimensions(spark, sf_dir):
    """Rows with a vector of the right size, and the others."""
    cut = F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 3)).when(F.col("vec_id") % 11 != 0, F.col("embedding"))
    good, bad = vector.checked(table(spark, sf_dir, "embeddings").select("vec_id", cut.alias("embedding")), 64)
    return good.select("vec_id", F.lit(True).alias("good")).unionByName(bad.select("vec_id", F.lit(False).alias("good")))


@query(
    f"""WITH {STATUTES}, r AS (SELECT doc_id, text, id % 50 AS query_id, row_number() OVER (PARTITION BY id % 50 ORDER BY id) AS prior FROM st)
    SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY length(text) * 7 % 31 DESC, prior) AS rank FROM r"""
)
def pair_scored(spark, sf_dir):
    """H6: reranked by a scorer of (question, text) pairs."""
    rows = statutes(spark, sf_dir).withColumns({"query_id": F.col("id") % 50, "question": F.lit("q")})
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("id")))
    return rerank.cross_encoded(rows, lambda pairs: [len(t) * 7 % 31 for _, t in pairs]).select("query_id", "doc_id", "rank")
