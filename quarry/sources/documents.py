"""Documents from JSON, Markdown, text and page tables: (rel, chunk, text, metadata ..)."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.extract import act_of_path, enriched, legal_structure
from quarry.functions.text import normalize_text
from quarry.operators import segment
from quarry.sources import files as file_rows

SHORTEST, EMBED_CHARS = 50, 4000
#: Fixed value: the header that marks a row of comma-separated values inside JSON.
CSV_HEADER = "chapter,section,section_title,section_desc"


def _balanced(text: str) -> str | None:
    """From the first bracket to the one that closes it, strings apart."""
    begin = re.search(r"[\[{]", text)
    if not begin:
        return None
    depth, quoted, at = 0, False, begin.start()
    while at < len(text):
        c = text[at]
        if quoted:
            at += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
            if not depth:
                return text[begin.start() : at + 1]
        at += 1
    return None


def parse_tolerantly(text: str | None):
    """(value, errors): JSON as it is, then without NUL and trailing commas, then its first balanced part,
    then as JSON lines, then as a Python literal; None if nothing reads."""
    errors, text = [], (text or "").lstrip("﻿")
    mend = lambda t: re.sub(r",(\s*[}\]])", r"\1", t.replace("\0", ""))
    part = _balanced(text)
    tries = [text, mend(text), part, mend(part) if part else None]
    if text.strip():
        lines = [x for x in text.splitlines() if x.strip()]
        several = len(lines) > 1 and all(x.lstrip()[:1] in "{[" and x.rstrip()[-1:] in "}]" for x in lines)
        if several:
            try:
                return [json.loads(mend(x)) for x in lines], errors
            except ValueError as e:
                errors.append(str(e))
    for t in tries:
        if t:
            try:
                return json.loads(t), errors
            except ValueError as e:
                errors.append(str(e))
    try:
        return ast.literal_eval(text.strip()), errors
    except (ValueError, SyntaxError, MemoryError, RecursionError) as e:
        errors.append(str(e))
    return None, errors


@F.pandas_udf(T.StringType())
def json_repaired(text: pd.Series) -> pd.Series:
    """Readable JSON of text that is almost JSON; null if nothing can be made of it."""
    return text.map(lambda t: json.dumps(v, ensure_ascii=False) if (v := parse_tolerantly(t)[0]) is not None else None)


def json_value(text: Column) -> Column:
    """Valid JSON as it is, mended inside the JVM if that is enough; the UDF sees only what is left."""
    mended = F.regexp_replace(F.regexp_replace(text, "\u0000", ""), r",(\s*[}\]])", "$1")
    valid = lambda t: F.when(F.try_parse_json(t).isNotNull(), t)
    return F.coalesce(valid(text), valid(mended))


_ITEM = pa.schema(
    [
        ("rel", pa.string()), ("item", pa.int64()), ("shape", pa.string()), ("case_id", pa.string()), ("paragraph_number", pa.int64()),
        ("paragraph_start", pa.int64()), ("paragraph_end", pa.int64()), ("page", pa.int64()), ("section", pa.string()), ("title", pa.string()),
        ("chapter", pa.string()), ("text", pa.string()),
    ]
)


def _whole(v) -> int | None:
    return int(v) if isinstance(v, int) and not isinstance(v, bool) else None


def items_of(rel: str, value) -> list[dict]:
    """The items of a JSON document, by the first shape that fits each."""
    import csv

    if isinstance(value, dict) and isinstance(value.get("paragraphs"), list):
        out, spans = [], []
        for k, p in enumerate(value["paragraphs"]):
            if not isinstance(p, dict) or not str(p.get("text") or "").strip():
                continue
            a, b = _whole(p.get("paragraph_start")), _whole(p.get("paragraph_end"))
            if a is not None and b is not None:
                if any(x <= a and b <= y for x, y in spans):
                    continue
                spans.append((a, b))
            number = _whole(p.get("paragraph_number"))
            out.append(
                {"rel": rel, "item": k, "shape": "paragraph", "case_id": str(p.get("case_id") or value.get("case_id") or rel), "page": _whole(p.get("page")),
                 "paragraph_number": number if number is not None else k + 1, "paragraph_start": a, "paragraph_end": b, "text": str(p["text"])}
            )
        return out
    out = []
    for k, item in enumerate(value if isinstance(value, list) else [value]):
        if not isinstance(item, dict):
            continue
        row = {"rel": rel, "item": k}
        question, answer = (str(item.get(x) or "").strip() for x in ("question", "answer"))
        fields = [item.get(x) for x in ("section", "title", "description", "section_title", "section_desc")]
        head = next(iter(item), "") if len(item) == 1 else ""
        if question and answer:
            row |= {"shape": "qa", "text": f"Question:\n{question}\n\nAnswer:\n{answer}"}
        elif CSV_HEADER in head.replace(" ", ""):
            cells = (next(csv.reader([str(item[head])]), []) + [""] * 4)[:4]
            row |= {"shape": "csv", "chapter": cells[0].strip(), "section": cells[1].strip(), "title": cells[2].strip(), "text": "\n".join(x.strip() for x in cells[1:] if x.strip())}
        elif any(f is not None for f in fields):
            title, body = item.get("title") or item.get("section_title") or "", item.get("description") or item.get("section_desc") or ""
            section = str(item.get("section") or "").strip()
            row |= {"shape": "section", "section": section, "title": str(title), "text": "\n".join(x for x in (f"Section {section}" if section else "", str(title).strip(), str(body).strip()) if x)}
        else:
            row |= {"shape": "other", "text": "\n".join(str(v) for v in item.values() if isinstance(v, (str, int, float)))}
        out.append(row)
    return out


def json_items(files: DataFrame) -> DataFrame:
    """Rows of _ITEM of JSON files(rel, content)."""

    def run(batches):
        for batch in batches:
            rows = []
            for rel, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                value, _ = parse_tolerantly(text)
                if value is not None:
                    rows += items_of(rel, value)
            yield pa.RecordBatch.from_pylist(rows, schema=_ITEM)

    ddl = "rel string, item long, shape string, case_id string, paragraph_number long, paragraph_start long, paragraph_end long, page long, section string, title string, chapter string, text string"
    return files.select("rel", file_rows.decoded(F.col("content")).alias("t")).mapInArrow(run, ddl)


META = ["doc_type", "doc_subtype", "act", "chapter", "section", "subsection", "section_title", "clause", "citation"]


def _finished(rows: DataFrame, given: dict[str, Column]) -> DataFrame:
    """(rel, source, chunk, text, META ..): metadata filled from text, chunks numbered by the caller."""
    source = F.element_at(F.split("rel", "/"), -1)
    meta = enriched(F.col("text"), {"source": source, "source_path": F.col("rel"), **given})
    none = F.lit(None).cast("string")
    return rows.select("rel", source.alias("source"), "chunk", "text", *(F.coalesce(meta.get(k, none), none).alias(k) for k in META))


def from_json(files: DataFrame) -> DataFrame:
    items = json_items(files)
    plain = items.where("shape <> 'paragraph'")
    name = F.when(F.col("shape") == "qa", "qa").otherwise("json")
    cut = F.when(F.col("shape") == "qa", segment.recursive_chunks(F.col("text"), "qa")).otherwise(segment.recursive_chunks(F.col("text"), "section"))
    found = legal_structure(F.col("whole"))
    own = plain.withColumn("whole", F.col("text")).withColumn("parts", cut).select("*", F.posexplode("parts").alias("at", "piece"))
    own = own.where(F.length("piece") >= SHORTEST)
    single = _finished(
        own.select("rel", (F.col("item") * 10_000 + F.col("at")).alias("chunk"), F.col("piece").alias("text"), name.alias("k"), found["act"].alias("a"),
                   F.coalesce(F.nullif(F.col("section"), F.lit("")), found["section"]).alias("s"), F.col("title").alias("t"), F.col("chapter").alias("c")),
        {"doc_type": F.col("k"), "act": F.col("a"), "section": F.col("s"), "section_title": F.col("t"), "chapter": F.col("c")},
    )
    cases = items.where("shape = 'paragraph'")
    windows = segment.paragraph_windows(cases.select(F.col("rel").alias("case_id"), "paragraph_number", "page", "text"))
    case = _finished(
        windows.select(F.col("case_id").alias("rel"), F.col("paragraph_start").alias("chunk"), "text", act_of_path(F.col("case_id")).alias("a")),
        {"doc_type": F.lit("json"), "doc_subtype": F.lit("statute"), "act": F.col("a")},
    )
    return single.unionByName(case)


def from_markdown(files: DataFrame) -> DataFrame:
    text = file_rows.decoded(F.col("content"))
    rows = files.select("rel", text.alias("md")).withColumn("hint", segment.act_hint_of_markdown(F.col("md"), F.col("rel")))
    cut = rows.select("rel", "hint", F.posexplode(segment.markdown_chunks(normalize_text(F.col("md")))).alias("chunk", "text"))
    return _finished(cut, {"doc_type": F.lit("md"), "doc_subtype": F.lit("statute"), "act": F.col("hint")})


def from_text(files: DataFrame) -> DataFrame:
    text = normalize_text(file_rows.decoded(F.col("content")))
    cut = files.select("rel", F.posexplode(F.filter(segment.recursive_chunks(text, "section"), lambda c: F.length(c) >= SHORTEST)).alias("chunk", "text"))
    return _finished(cut, {"doc_type": F.lit("txt")})


def from_pages(pages: DataFrame) -> DataFrame:
    """pages(doc, page, text): what any page extractor or OCR hook gives."""
    cut = segment.page_chunks(pages.withColumn("text", normalize_text(F.col("text")))).withColumnRenamed("doc", "rel")
    return _finished(cut, {"doc_type": F.lit("pdf"), "act": act_of_path(F.col("rel"))})


def page_table(files: DataFrame, extract, retry=None, poor_below: int = 100) -> DataFrame:
    """pages(doc, page, text) by extract(bytes) -> list of page texts; retry(bytes) where they hold too little."""

    def run(batches):
        for batch in batches:
            rows = []
            for rel, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts = extract(raw)
                if retry is not None and sum(len(t or "") for t in texts) < poor_below:
                    texts = retry(raw)
                rows += [{"doc": rel, "page": k, "text": t} for k, t in enumerate(texts, 1)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc", pa.string()), ("page", pa.int64()), ("text", pa.string())]))

    return files.select("rel", "content").mapInArrow(run, "doc string, page long, text string")


def loaded(files: DataFrame) -> DataFrame:
    """Chunks of files of every text format, with ids and cut for embedding: one plan, a branch for each format."""
    kind = file_rows.extension(F.col("rel"))
    rows = from_json(files.where(kind == "json")).unionByName(from_markdown(files.where(kind == "md"))).unionByName(from_text(files.where(kind == "txt")))
    return rows


def with_ids(chunks: DataFrame, tokens: DataFrame) -> DataFrame:
    """chunks with doc_id rel:chunk:hash, text cut to what is embedded, and char_count; tokens(rel, hash)."""
    named = chunks.join(tokens.select("rel", "hash"), "rel")
    return (
        named.withColumn("text", F.substring("text", 1, EMBED_CHARS))
        .withColumn("char_count", F.length("text").cast("long"))
        .withColumn("doc_id", F.concat_ws(":", "rel", F.col("chunk").cast("string"), F.substring("hash", 1, 8)))
        .drop("hash")
    )


def stored_row(row: DataFrame, typed: list[str], json_column: str = "metadata_json") -> DataFrame:
    """Rows of a store as documents: typed columns, overridden by keys of the JSON, then filled from text."""
    value = lambda k: F.coalesce(F.get_json_object(json_column, f"$.{k}"), F.nullif(F.col(k), F.lit("")))
    meta = enriched(F.col("text"), {k: value(k) for k in typed})
    return row.withColumns({k: meta[k] for k in typed})


def rendered(value, title: str, depth: int = 12, most_items: int = 2000, most_chars: int = 8000) -> str:
    """A JSON value as Markdown: lists of sections one by one, everything else by nesting."""
    scalar = lambda v: "(null)" if v is None else str(v).lower() if isinstance(v, bool) else str(v)[:most_chars]
    out = [f"# {title}", ""]

    def walk(v, level: int) -> None:
        if isinstance(v, dict):
            for k, x in list(v.items())[:most_items]:
                out.append(f"{'#' * min(level, 6)} {' '.join(str(k).split())}")
                walk(x, level + 1) if level <= depth else out.append("…")
        elif isinstance(v, list):
            for x in v[:most_items]:
                if isinstance(x, (dict, list)):
                    walk(x, level + 1) if level <= depth else out.append("…")
                else:
                    out.append(f"- {scalar(x)}")
        else:
            out.extend([scalar(v), ""])

    if isinstance(value, list) and value and all(isinstance(x, dict) and ("section" in x or "Section" in x) for x in value[:50]):
        for x in value:
            out.append(f"## {x.get('section', x.get('Section'))}")
            out.extend(scalar(y).strip() for y in (x.get("title") or x.get("section_title"), x.get("description") or x.get("section_desc")) if y)
            out += ["", "---", ""]
    else:
        walk(value, 2)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip() + "\n"


@F.pandas_udf(T.StringType())
def json_markdown(title: pd.Series, text: pd.Series) -> pd.Series:
    """rendered() of JSON text: nesting has no bound in the schema, so an Arrow UDF."""
    return pd.Series([rendered(v, t) if (v := parse_tolerantly(x)[0]) is not None else None for t, x in zip(title, text)])
