"""Cutting text into chunks, windows and paragraphs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry import dims
from quarry.functions.text import chain, strip


def fixed_chunks(text: Column, size: int, overlap: int) -> Column:
    """array<string> of `size` characters each, `overlap` of them shared with the next; the last ends the text."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - size) / F.lit(step)), F.lit(0)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, cut).otherwise(F.array().cast("array<string>"))


def split_recursively(text: str, size: int, overlap: int, separators: list[str]) -> list[str]:
    """Pieces of about `size` characters, cut at the first separator that occurs, finer ones only within
    pieces that are still too long.

    A separator stays at the end of its piece. Each piece after the first starts with the last `overlap`
    characters of the one before.
    """
    if len(text) <= size:
        return [text] if text.strip() else []
    for at, mark in enumerate(separators):
        if mark not in text:
            continue
        parts = text.split(mark)
        parts = [p + mark for p in parts[:-1]] + [parts[-1]]
        merged, now = [], ""
        for part in filter(None, parts):
            if now and len(now) + len(part) > size:
                merged.append(now)
                now = now[-overlap:] if overlap else ""
            now += part
        if now:
            merged.append(now)
        finer = separators[at + 1 :]
        out = []
        for piece in merged:
            if len(piece) > size and finer:
                out += split_recursively(piece, size, overlap, finer)
            elif piece.strip():
                out.append(piece)
        return out
    return [text[a : a + size] for a in range(0, max(len(text) - overlap, 1), size - overlap)]


def recursive_chunks(text: Column, splitter: str = "md") -> Column:
    """array<string> by one of dims.SPLITTERS. The greedy merge is sequential within a text: an Arrow UDF."""
    size, overlap, separators = dims.SPLITTERS[splitter]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [p.strip() for p in split_recursively(t or "", size, overlap, separators) if p.strip()])

    return run(text)


def line_chunks(text: Column, most: int) -> Column:
    """array<string> of whole lines, at most `most` characters together; a longer line stands alone."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"))
    grown = F.aggregate(
        lines,
        start,
        lambda a, x: F.when(a["now"].isNull(), F.struct(a["done"].alias("done"), x.alias("now")))
        .when(F.length(a["now"]) + F.length(x) + 1 <= most, F.struct(a["done"].alias("done"), F.concat(a["now"], F.lit("\n"), x).alias("now")))
        .otherwise(F.struct(F.array_append(a["done"], a["now"]).alias("done"), x.alias("now"))),
        lambda a: F.array_append(a["done"], a["now"]),
    )
    return F.filter(grown, lambda x: strip(x) != "")


def paragraph_blocks(md: Column, least: int = 0) -> Column:
    """array<string> between blank lines, without headings and blocks shorter than `least`."""
    blocks = F.transform(F.split(F.coalesce(md, F.lit("")), r"\n{2,}"), lambda b: F.trim(F.btrim(b, F.lit(" \n\t\r"))))
    return F.filter(blocks, lambda b: (b != "") & ~b.startswith("#") & (F.length(b) >= least))


def paragraph_windows(rows: DataFrame, least: int = 800, most: int = 2000, overlap: int = 2, shortest: int = 50) -> DataFrame:
    """(case_id, paragraph_start, paragraph_end, pages, text) of rows(case_id, paragraph_number, page, text).

    A window grows paragraph by paragraph to `least` characters and gives up its last ones beyond `most`;
    the next starts `overlap` paragraphs before its end. Where a window starts depends on the one before,
    so a case's paragraphs are walked together, in Arrow batches of whole cases.
    """
    kind = rows.schema["case_id"].dataType.simpleString()

    def walk(case: pd.DataFrame) -> pd.DataFrame:
        case = case.sort_values("paragraph_number")
        case = case[case["text"].fillna("").str.strip() != ""]
        texts, numbers, pages = case["text"].tolist(), case["paragraph_number"].tolist(), case["page"].tolist()
        size, out, at = [len(t) for t in texts], [], 0
        while at < len(texts):
            end, total = at, 0
            while end < len(texts) and total < least:
                total += size[end]
                end += 1
            while total > most and end - at > 1:
                end -= 1
                total -= size[end]
            text = "\n\n".join(t.strip() for t in texts[at:end])
            if len(text) < shortest:
                at = end
                continue
            seen = sorted({int(p) for p in pages[at:end] if p == p and p is not None})
            out.append((case["case_id"].iloc[0], numbers[at], numbers[end - 1], seen, text))
            at = max(at + 1, end - overlap)
        return pd.DataFrame(out, columns=["case_id", "paragraph_start", "paragraph_end", "pages", "text"])

    return rows.select("case_id", "paragraph_number", "page", "text").groupBy("case_id").applyInPandas(
        walk, f"case_id {kind}, paragraph_start long, paragraph_end long, pages array<int>, text string"
    )


def page_chunks(pages: DataFrame, splitter: str = "section", shortest: int = 50, least_total: int = 300) -> DataFrame:
    """(doc, chunk, text) of pages(doc, page, text): the last chunk of a page is carried to the next page.

    A document whose chunks have fewer than least_total characters together gives none.
    """
    size, overlap, separators = dims.SPLITTERS[splitter]
    kind = pages.schema["doc"].dataType.simpleString()

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        carried, out = "", []
        for text in rows.sort_values("page")["text"].fillna(""):
            parts = split_recursively(f"{carried}\n{text}".strip() if carried else text.strip(), size, overlap, separators)
            out += parts[:-1]
            carried = parts[-1] if parts else ""
        out = [p.strip() for p in [*out, carried] if len(p.strip()) >= shortest]
        if sum(map(len, out)) < least_total:
            out = []
        # Typed, as columns without rows would else be numbers, which do not become strings.
        return pd.DataFrame({"doc": [rows["doc"].iloc[0]] * len(out), "chunk": range(len(out)), "text": out}).astype({"doc": object, "text": object})

    return pages.select("doc", "page", "text").groupBy("doc").applyInPandas(walk, f"doc {kind}, chunk long, text string")


def markdown_chunks(md: Column, shortest: int = 50) -> Column:
    """array<string> of a Markdown text: fences dropped, bare numbered heads as sections, heading marks dropped."""
    plain = chain(md, (r"(?s)```.*?```", " "), ("`", ""), (r"(?m)^#{1,6}\s*([0-9]{1,4}[A-Z]?)\.?\s*$", "Section $1"), (r"(?m)^#{1,6}\s+", ""))
    return F.filter(recursive_chunks(plain, "md"), lambda c: F.length(c) >= shortest)


def act_hint_of_markdown(md: Column, path: Column) -> Column:
    """The first `# ` heading, else the file's name."""
    from quarry.functions.extract import act_of_path

    return F.coalesce(F.nullif(F.trim(F.regexp_extract(F.coalesce(md, F.lit("")), r"(?m)^# (.*)$", 1)), F.lit("")), act_of_path(path))
