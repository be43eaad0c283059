"""Clean-up of page text: running heads and feet, headings, lists and tables as Markdown."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import line_signature, strip

TOP, BOTTOM, LEAST_PAGES, LEAST_SHARE = 3, 3, 4, 0.6
PAGE_NUMBER = r"(?i)^\s*(?:page|pg)\s*[.:]?\s*\d+(?:\s*(?:of|/)\s*\d+)?\s*$"


def numbered_lines(pages: DataFrame) -> DataFrame:
    """(doc, page, at, line, from_top, from_bottom): lines; the last two count lines with text only, from 1."""
    lines = pages.select("doc", "page", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r\n|\n|\r")).alias("at", "line"))
    full = strip(F.col("line")) != ""
    one = Window.partitionBy("doc", "page", full)
    return lines.withColumn("from_top", F.when(full, F.row_number().over(one.orderBy("at")))).withColumn(
        "from_bottom", F.when(full, F.row_number().over(one.orderBy(F.desc("at"))))
    )


def running_lines(pages: DataFrame, top: int = TOP, bottom: int = BOTTOM, least_pages: int = LEAST_PAGES, share: float = LEAST_SHARE) -> DataFrame:
    """(doc, place, sig, n): signatures that head (place 'header') or foot enough pages of a document."""
    count = pages.groupBy("doc").agg(F.count(F.lit(1)).alias("_pages")).where(F.col("_pages") >= least_pages)
    edge = numbered_lines(pages).where((F.col("from_top") <= top) | (F.col("from_bottom") <= bottom))
    edge = edge.withColumn("sig", line_signature(F.col("line"))).where("sig <> ''")
    place = F.explode(
        F.filter(
            F.array(F.when(F.col("from_top") <= top, F.lit("header")), F.when(F.col("from_bottom") <= bottom, F.lit("footer"))),
            lambda p: p.isNotNull(),
        )
    )
    return (
        edge.select("doc", "sig", place.alias("place"))
        .groupBy("doc", "place", "sig")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(count, "doc")
        .where(F.col("n") >= F.greatest(F.lit(least_pages), F.floor(F.col("_pages") * share)))
        .select("doc", "place", "sig", "n")
    )


def without_running_lines(pages: DataFrame, top: int = TOP, bottom: int = BOTTOM, **options) -> DataFrame:
    """(doc, page, text) without running heads and feet and page numbers at the edges."""
    known = running_lines(pages, top, bottom, **options).groupBy("doc").agg(
        F.collect_set(F.when(F.col("place") == "header", F.col("sig"))).alias("_heads"),
        F.collect_set(F.when(F.col("place") == "footer", F.col("sig"))).alias("_feet"),
    )
    at_top, at_bottom = F.coalesce(F.col("from_top") <= top, F.lit(False)), F.coalesce(F.col("from_bottom") <= bottom, F.lit(False))
    sig = line_signature(F.col("line"))
    drop = (
        (at_top & F.coalesce(F.array_contains("_heads", sig), F.lit(False)))
        | (at_bottom & F.coalesce(F.array_contains("_feet", sig), F.lit(False)))
        | ((at_top | at_bottom) & F.trim("line").rlike(PAGE_NUMBER))
    )
    kept = F.when(~drop, F.struct("at", "line"))
    return (
        numbered_lines(pages)
        .join(known, "doc", "left")
        .groupBy("doc", "page")
        .agg(F.array_sort(F.collect_list(kept)).alias("_l"))
        .select("doc", "page", strip(F.array_join(F.transform("_l", lambda x: x["line"]), "\n")).alias("text"))
    )


def title_of(text: Column) -> Column:
    """The first line that can be a title: 5 to 140 characters, no page number, no copyright."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|\n|\r"), strip)
    able = F.filter(
        lines, lambda x: F.length(x).between(5, 140) & ~x.rlike(PAGE_NUMBER) & ~x.rlike(r"(?i)\b(?:copyright|all rights reserved)\b")
    )
    return F.regexp_replace(F.get(able, F.lit(0)), r"(?U)\s+", " ")


#: Line forms that become headings, with the longest line and how the heading reads.
HEADINGS = [
    (re.compile(r"(?i)(?:section|sec\.?)\s+([0-9A-Za-z().]+)\s*(.*)"), 10**9, "{0}", True),
    (re.compile(r"(?i)chapter\s+([IVXLC0-9]+)\s*(.*)"), 10**9, "Chapter {0}", True),
    (re.compile(r"धारा\s+([0-9A-Za-z().]+)\s*(.*)"), 10**9, "धारा {0}", True),
    (re.compile(r"अध्याय\s+([IVXLC0-9]+)\s*(.*)"), 10**9, "अध्याय {0}", True),
    (re.compile(r"(\d{1,4}[A-Z]?)\.\s+(.+)"), 160, "{0}.", False),
    (re.compile(r"(\d{1,4}[A-Z]?)\s+([A-Za-z][A-Za-z0-9 ,:;()\"'\\/-]{3,})"), 120, "{0}.", False),
]
ITEMS = [
    (re.compile(r"[•\-*]\s+(.*)"), "- {0}"),
    (re.compile(r"(\d{1,4})[.)]\s+(.*)"), "{0}. {1}"),
    (re.compile(r"\(?([a-zA-Z])\)\s+(.*)"), "- ({0}) {1}"),
    (re.compile(r"(?i)\(?([ivxlcdm]+)\)\s+(.*)"), "- ({0}) {1}"),
]


def heading_of(line: str) -> str | None:
    """A line as a second-level heading, or None."""
    s = line.strip()
    for form, longest, name, colon in HEADINGS:
        m = form.fullmatch(s)
        if m and len(s) <= longest:
            head, rest = name.format(m[1].rstrip(".") if colon else m[1]), m[2].strip(" -:\t") if colon else m[2].strip()
            return f"## {head}{': ' if colon and rest else ' ' if rest else ''}{rest}"
    letters = [c for c in s if c.isalpha()]
    if letters and len(s) <= 70 and not s.endswith(".") and sum(c.isupper() for c in letters) >= 0.75 * len(letters):
        return f"## {s.title()}"
    return None


def _cells(line: str) -> list[str]:
    parts = line.strip("|").split("|") if "|" in line else re.split(r"\s{2,}", line)
    return [c.strip() for c in parts if c.strip()]


def to_markdown(text: str) -> str:
    """Page text as Markdown: a walk over lines with one open paragraph or list item."""
    lines, out, open_, at = [x.strip() for x in (text or "").splitlines()], [], None, 0

    def close() -> None:
        nonlocal open_
        if open_:
            out.append(re.sub(r"\s+", " ", " ".join(open_)).strip())
        open_ = None

    def gap() -> None:
        close()
        if out and out[-1]:
            out.append("")

    while at < len(lines):
        line = lines[at]
        heading = heading_of(line) if line else None
        cells = _cells(line)
        rows = 1
        if len(cells) >= 3 and not heading:
            while at + rows < len(lines) and rows < 50 and lines[at + rows] and len(_cells(lines[at + rows])) == len(cells):
                rows += 1
        if not line:
            gap()
        elif heading:
            gap()
            out += [heading, ""]
        elif rows >= 2:
            close()
            table = [_cells(x) for x in lines[at : at + rows]]
            out += ["| " + " | ".join(r) + " |" for r in [table[0], ["---"] * len(cells), *table[1:]]] + [""]
        else:
            for form, name in ITEMS:
                m = form.fullmatch(line)
                if m:
                    close()
                    parts = [g.strip() for g in m.groups()]
                    open_ = [name.format(parts[0].lower() if form is ITEMS[3][0] else parts[0], *parts[1:])]
                    break
            else:
                if open_ is None:
                    open_ = []
                open_.append(line)
        at += rows if rows >= 2 and line and not heading else 1
    close()
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


@F.pandas_udf(T.StringType())
def markdown(text: pd.Series) -> pd.Series:
    """to_markdown() of normalised text: line states are sequential, so an Arrow UDF."""
    return text.map(to_markdown)


def converted(pages: DataFrame) -> DataFrame:
    """(doc, page, md) of pages(doc, page, text): normalised, without running lines, as Markdown."""
    from quarry.functions.text import normalize_extracted

    clean = without_running_lines(pages.withColumn("text", normalize_extracted(F.col("text"))))
    return clean.select("doc", "page", markdown("text").alias("md"))
