"""Benchmark decontamination over a distributed positional inverted index.

Only DataFrame functions run here. The index holds postings (term, doc_id, pos) of training texts.
For each window of test words, the lists of its rarest terms are shifted by the terms' offsets in
the item and intersected: what is left agrees on one alignment of item and document. An exact
comparison of the words follows.

Words are compared after lower-casing A-Z. Index keys are lower-cased by Unicode rules, which merges
at most more words, so no match is lost; the exact comparison undoes it.

Edge cases: a null or wordless text has no words and no hits; a null or wordless item has no
windows; an item shorter than a window is one window; repeated item_ids count once; repeated
document rows get a row each; postings meet by a hash of doc_id and text, so rows without doc_id, or
with the same one, are matched apart; ties in rarity go to the smaller term, then to the first place;
other columns are carried along. Texts may have any length: positions are ints, and arrays never
exceed a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.tables import written

WINDOW = 13
#: Lists intersected for a window, from the rarest term on.
RAREST = 2
#: Terms, and bytes, up to which a side is broadcast; beyond, the same join shuffles.
BROADCAST_TERMS = 500_000
BROADCAST_BYTES = 32 << 20

#: ASCII characters that separate words, before lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def raw_words(text: Column) -> Column:
    """array<string> of words in their own case; empty for null."""
    parts = F.split(F.coalesce(text, F.lit("")), SEPARATORS)
    first = F.when(F.element_at(parts, 1) == "", F.lit(2)).otherwise(F.lit(1))
    last = F.size(parts) - F.when(F.element_at(parts, -1) == "", F.lit(1)).otherwise(F.lit(0))
    return F.slice(parts, first, F.greatest(last - first + 1, F.lit(0)))


def ascii_lower(value: Column) -> Column:
    return F.translate(value, UPPER, LOWER)


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_words, item_ids, at, length): a row for each window of an item; items of the same words are one."""
    words = F.transform(raw_words(F.col("text")), ascii_lower)
    return (
        items.select(F.col("item_id").cast("string").alias("_item"), words.alias("item_words"))
        .where(F.size("item_words") > 0)
        .groupBy("item_words")
        .agg(F.array_sort(F.collect_set("_item")).alias("item_ids"))
        .withColumn("length", F.least(F.size("item_words"), F.lit(size)))
        .withColumn("at", F.explode(F.sequence(F.lit(0), F.size("item_words") - F.col("length"))))
    )


def row_key() -> Column:
    """What postings are grouped by: names a text and its id, so that rows without an id make no hot group."""
    return F.xxhash64("doc_id", "text")


def _small(side: DataFrame, weight: Column) -> DataFrame:
    """side, broadcast if it has at most BROADCAST_TERMS rows and, by the weight of each, BROADCAST_BYTES bytes;
    otherwise Spark shuffles the join."""
    n, size = side.agg(F.count(F.lit(1)), F.sum(weight.cast("long"))).first()
    return F.broadcast(side) if n <= BROADCAST_TERMS and (size or 0) <= BROADCAST_BYTES else side


def _term_bytes() -> Column:
    return F.octet_length("term") + 32


def postings(docs: DataFrame, terms: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """The index: (term, doc_id, pos), of all terms or of those in terms(term). key: the column that names a document."""
    every = docs.select(key, F.posexplode(raw_words(F.col("text"))).alias("pos", "_word")).select(
        F.lower("_word").alias("term"), key, "pos"
    )
    return every if terms is None else every.join(_small(terms, _term_bytes()), "term")


def document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences in docs of each of terms, 0 included."""
    words = docs.select(F.explode(raw_words(F.col("text"))).alias("_word")).select(F.lower("_word").alias("term"))
    seen = words.join(_small(terms, _term_bytes()), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(seen, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def anchors(tests: DataFrame, counts: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(item_words, item_ids, at, length, ipos, term): the places of each window's rarest terms."""
    spot = F.explode(F.sequence(F.col("at"), F.col("at") + F.col("length") - 1))
    each = tests.select("item_words", "item_ids", "length", "at", spot.alias("ipos")).withColumn(
        "term", F.lower(F.element_at("item_words", F.col("ipos") + 1))
    )
    rank = F.row_number().over(Window.partitionBy("item_words", "at").orderBy("n", "term", "ipos"))
    return each.join(_small(counts, _term_bytes()), "term").withColumn("_r", rank).where(F.col("_r") <= rarest)


def _words_bytes(words: str) -> Column:
    return F.aggregate(words, F.lit(0), lambda n, w: n + F.octet_length(w) + 16)


def alignments(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """(row_key, item_words, item_ids, shift, windows): windows whose offset-adjusted lists intersect.

    shift is the document position of the item's first word. Lists meet by (document, item, shift), so
    that a posting yields one row for each place of its term in an item, not one for each window.
    """
    spots = chosen.select("term", "item_words", "ipos").distinct()
    met = (
        index.join(_small(spots, _term_bytes() + _words_bytes("item_words")), "term")
        .groupBy("row_key", "item_words", (F.col("pos") - F.col("ipos")).alias("shift"))
        .agg(F.collect_set("ipos").alias("_met"))
    )
    needs = chosen.groupBy("item_words", "item_ids", "at", "length").agg(F.collect_set("ipos").alias("_need"))
    needs = needs.groupBy("item_words", "item_ids").agg(F.collect_list(F.struct("at", "length", "_need")).alias("_needs"))
    able = F.filter("_needs", lambda w: F.size(F.array_except(w["_need"], F.col("_met"))) == 0)
    return (
        met.join(_small(needs, _words_bytes("item_words") + _words_bytes("item_ids") + 64 * F.size("_needs")), "item_words")
        .withColumn("_able", able)
        .where(F.size("_able") > 0)
        .select("row_key", "item_words", "item_ids", "shift", F.transform("_able", lambda w: F.struct(w["at"], w["length"])).alias("windows"))
    )


def phrase_index(docs: DataFrame, items: DataFrame, size: int = WINDOW, rarest: int = RAREST) -> tuple[DataFrame, DataFrame]:
    """(index, chosen): the stored postings of the terms that windows of items ask for, and what they ask."""
    tests = written(windows(items, size), "test-windows")
    terms = tests.select(F.explode(F.transform("item_words", F.lower)).alias("term")).distinct()
    counts = written(document_counts(docs, terms), "term-counts")
    chosen = written(anchors(tests, counts, rarest), "anchors")
    return written(postings(docs.withColumn("row_key", row_key()), chosen.select("term").distinct(), "row_key"), "postings"), chosen


def phrase_matches(docs: DataFrame, items: DataFrame, size: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """Each row of docs(doc_id, text, ..) with n_words and matches: array<struct<item_ids, start, length>>.

    A match is an occurrence of a window of an item, at document word `start`.
    """
    index, chosen = phrase_index(docs, items, size, rarest)
    found = written(alignments(index, chosen), "alignments")
    per_doc = found.groupBy("row_key").agg(F.collect_list(F.struct("item_words", "item_ids", "shift", "windows")).alias("_found"))
    weight = found.agg(F.sum(_words_bytes("item_words") + _words_bytes("item_ids") + F.size("windows") * 16 + 64)).first()[0] or 0
    if weight <= BROADCAST_BYTES:
        per_doc = F.broadcast(per_doc)
    text_of = lambda start, n: ascii_lower(F.array_join(F.slice("_w", start, n), " "))
    real = F.flatten(
        F.transform(
            "_found",
            lambda f: F.transform(
                F.filter(
                    f["windows"],
                    lambda w: (f["shift"] + w["at"] >= 0)
                    & (
                        text_of(F.greatest(f["shift"] + w["at"] + 1, F.lit(1)), w["length"])
                        == F.array_join(F.slice(f["item_words"], w["at"] + 1, w["length"]), " ")
                    ),
                ),
                lambda w: F.struct(f["item_ids"].alias("item_ids"), (f["shift"] + w["at"]).alias("start"), w["length"].alias("length")),
            ),
        )
    )
    none = F.array().cast("array<struct<item_ids:array<string>,start:int,length:int>>")
    return (
        docs.drop("n_words", "matches", "row_key")
        .withColumn("row_key", row_key())
        .join(per_doc, "row_key", "left")
        .withColumn("_w", raw_words(F.col("text")))
        .withColumn("n_words", F.size("_w").cast("long"))
        .withColumn("matches", F.when(F.col("_found").isNull(), none).otherwise(real))
        .drop("_w", "_found", "row_key")
    )


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, percent: int = 5) -> DataFrame:
    """docs(doc_id, text, ..) with n_words, n_hit, item_ids (sorted strings), contaminated, and holds_window.

    holds_window: a window of full size occurs; an item of fewer words alone may be a common phrase.
    """
    found = phrase_matches(docs.drop("n_hit", "item_ids", "contaminated", "holds_window"), items, size)
    covered = F.array_distinct(F.flatten(F.transform("matches", lambda m: F.sequence(m["start"], m["start"] + m["length"] - 1))))
    named = F.array_sort(F.array_distinct(F.flatten(F.transform("matches", lambda m: m["item_ids"]))))
    return (
        found.withColumn("n_hit", F.size(covered).cast("long"))
        .withColumn("item_ids", named)
        .withColumn("holds_window", F.exists("matches", lambda m: m["length"] >= size))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))
        .drop("matches")
    )


def proximity_matches(docs: DataFrame, queries: DataFrame, slop: int = 4) -> DataFrame:
    """(query_id, doc_id, start): where each query(query_id, terms) has all its terms, in order or not,
    within size(terms) + slop document words. Answered from the index alone.

    start is the first position of such a stretch; stretches are reported by their rarest term's block
    of positions and never depend on how postings are dealt out.
    """
    asked = queries.select("query_id", F.array_distinct(F.transform("terms", F.lower)).alias("terms")).where(F.size("terms") > 0)
    one = asked.select("query_id", F.explode("terms").alias("term"), F.size("terms").alias("_n"))
    span = F.col("_n") + F.lit(slop)
    hits = postings(docs, one.select("term").distinct()).join(_small(one, _term_bytes()), "term")
    spots = hits.groupBy("query_id", "doc_id", span.alias("_span"), "_n").agg(
        F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("_at")
    )
    full = lambda a: F.size(
        F.array_distinct(
            F.transform(
                F.filter("_at", lambda b: (b["pos"] >= a["pos"]) & (b["pos"] < a["pos"] + F.col("_span"))), lambda b: b["term"]
            )
        )
    ) == F.col("_n")
    return spots.select("query_id", "doc_id", F.explode(F.transform(F.filter("_at", full), lambda a: a["pos"])).alias("start")).distinct()
