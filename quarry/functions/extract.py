"""Structure of statutes in text, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry import dims
from quarry.functions.text import chain, clean_title, tokens

#: How a numbered heading and a reference to a section look.
HEADING = r"(?im)(?:^|[\n\r]| {2,})([0-9]{1,4}[A-Z]?)(?:\s*\(([a-z0-9]+)\))?\.\s+([^\n]{3,180})"
REFERENCE = r"(?i)\b(?:section|sec|s)\.?\s*([0-9]{1,4}[A-Z]?)\b"
STATUTE_TYPES = ["json", "md", "pdf", "txt"]


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, group), F.lit(""))


def act_name(text: Column) -> Column:
    """The first statute of dims.ACT_PATTERNS that text names, else null."""
    text = F.coalesce(text, F.lit(""))
    pattern, name = dims.ACT_PATTERNS[0]
    out = F.when(text.rlike(f"(?i){pattern}"), F.lit(name))
    for pattern, name in dims.ACT_PATTERNS[1:]:
        out = out.when(text.rlike(f"(?i){pattern}"), F.lit(name))
    return out


def citation(act: Column, section: Column, subsection: Column) -> Column:
    """'13(a), Some Act', null without act or section."""
    sub = F.when(F.coalesce(subsection, F.lit("")) != "", F.concat(F.lit("("), subsection, F.lit(")"))).otherwise(F.lit(""))
    known = (F.coalesce(act, F.lit("")) != "") & (F.coalesce(section, F.lit("")) != "")
    return F.when(known, F.concat(section, sub, F.lit(", "), act))


def legal_structure(text: Column) -> Column:
    """struct<act, chapter, section, subsection, section_title, clause, citation> of a text, null where absent."""
    headed = F.coalesce(text, F.lit("")).rlike(HEADING)
    section = F.upper(F.when(headed, _first(text, HEADING, 1)).otherwise(_first(text, r"(?i)\bSection\s+([0-9]+(?:[A-Z])?)")))
    subsection = F.when(headed, _first(text, HEADING, 2)).otherwise(
        _first(text, r"(?i)\bSection\s+(?:[0-9]+(?:[A-Z])?)?\s*\(([a-z0-9]+)\)")
    )
    act = act_name(text)
    return F.struct(
        act.alias("act"),
        _first(text, r"(?i)Chapter\s+([IVXLC0-9]+)").alias("chapter"),
        section.alias("section"),
        subsection.alias("subsection"),
        F.when(headed, F.nullif(clean_title(_first(text, HEADING, 3)), F.lit(""))).alias("section_title"),
        _first(text, r"(?i)Clause\s+\(([a-z]+)\)").alias("clause"),
        citation(act, section, subsection).alias("citation"),
    )


def enriched(text: Column, meta: dict[str, Column]) -> dict[str, Column]:
    """meta with blanks filled from text; a statute named by the file overrides act, section and title."""
    found = legal_structure(text)
    get = lambda k: F.nullif(F.coalesce(meta.get(k, F.lit(None).cast("string")), F.lit("")), F.lit(""))
    hint = act_name(chain(F.coalesce(get("source"), get("source_path")), ("[_-]", " ")))
    over = hint.isNotNull() & F.lower(F.coalesce(get("doc_type"), F.lit(""))).isin(*STATUTE_TYPES)
    out = dict(meta)
    out["act"] = F.when(over, hint).otherwise(F.coalesce(get("act"), found["act"]))
    for k in ("section", "subsection", "section_title"):
        out[k] = F.when(over, F.coalesce(found[k], get(k))).otherwise(F.coalesce(get(k), found[k]))
    for k in ("chapter", "clause"):
        out[k] = F.coalesce(get(k), found[k])
    out["citation"] = F.coalesce(citation(out["act"], out["section"], out["subsection"]), get("citation"))
    return out


def section_refs(text: Column) -> Column:
    """array<string> of the sections that text refers to, '13B' and the like, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(REFERENCE), F.lit(1)), F.upper))


def statute_query(text: Column) -> Column:
    """struct<act, sections> that a question names; a heading's section comes first if it is not among them."""
    found, refs = legal_structure(text), section_refs(text)
    return F.struct(
        found["act"].alias("act"),
        F.when(found["section"].isNotNull() & ~F.array_contains(refs, F.coalesce(found["section"], F.lit(""))), F.array_prepend(refs, found["section"]))
        .otherwise(refs)
        .alias("sections"),
    )


def act_of_path(path: Column) -> Column:
    """The statute that a file name names, else the name with single spaces."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.btrim(chain(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), ("[_-]", " ")))
    return F.coalesce(act_name(stem), F.array_join(tokens(stem), " "))
