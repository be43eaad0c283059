"""Scores of documents and answers as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry import dims
from quarry.functions.text import tokens

#: Document types that are statutes, and what marks a source in an answer.
STATUTORY = ["pdf", "md", "json"]
SOURCE_MARK = r"\[Source\s+\d+\s*[:\]]"


def contains_any(text: Column, cues: list[str]) -> Column:
    out = F.lit(False)
    for cue in cues:
        out = out | text.contains(cue)
    return out


def count_in(text: Column, terms: Column) -> Column:
    """How many of terms (an array) are substrings of text."""
    return F.size(F.filter(terms, lambda t: text.contains(t)))


def _cues_in(text: Column, cues: list[str]) -> Column:
    return count_in(text, F.array(*map(F.lit, cues)))


def relevance(query: Column, text: Column) -> Column:
    """0 to 1: the whole question in the text, its terms, and signs of a citation."""
    q, t = F.lower(query), F.lower(text)
    terms = F.filter(tokens(q), lambda w: (F.length(w) > 2) & ~w.isin(*dims.STOPWORDS))
    cover = F.when(F.size(terms) > 0, count_in(t, terms) / F.size(terms) * F.lit(0.3)).otherwise(F.lit(0.0))
    return F.least(
        F.when(t.contains(q), F.lit(0.5)).otherwise(F.lit(0.0)) + cover + F.when(t.rlike(r"(?i)Section\s+\d+|Act:|IPC|BNS"), F.lit(0.2)).otherwise(F.lit(0.0)),
        F.lit(1.0),
    )


def issue_relevance(text: Column) -> Column:
    t = F.lower(text)
    return 2 * _cues_in(t, dims.SUBSTANCE_CUES) - 3 * _cues_in(t, dims.PROCEDURE_CUES)


def case_consistency(query: Column, text: Column) -> Column:
    t = F.lower(text)
    names = F.filter(tokens(F.lower(query)), lambda w: F.length(w) > 3)
    return 2 * count_in(t, names) - F.when(t.contains("non-examinable"), 5).otherwise(0)


def section_number(section: Column) -> Column:
    return F.coalesce(F.try_to_number(F.nullif(section, F.lit("")), F.lit("999999999")).cast("long"), F.lit(1_000_000_000).cast("long"))


def outline(text: Column, section: Column, terms: Column) -> Column:
    """How much a section outlines its statute: structural cues, question terms, a low number."""
    t, number = F.lower(text), section_number(section)
    return (
        3 * _cues_in(t, dims.OUTLINE_CUES)
        + 2 * count_in(t, terms)
        + F.when(number < 20, 4).otherwise(0)
        + F.when(number < 10, 3).otherwise(0)
    )


def statute_boost(act: Column, section: Column, doc_type: Column, act_hint: Column, sections: Column, doc_subtype: Column | None = None) -> Column:
    """What a hint of the question adds to a fused score."""
    with_act = F.coalesce(F.lower(act).contains(F.lower(act_hint)), F.lit(False)) & (F.coalesce(act_hint, F.lit("")) != "")
    asked = F.size(F.coalesce(sections, F.array().cast("array<string>"))) > 0
    hit = F.coalesce(F.array_contains(sections, F.upper(section)), F.lit(False))
    by_section = F.when(asked, F.when(hit, F.lit(0.25)).otherwise(F.lit(-0.15))).otherwise(F.lit(0.0))
    kind = F.when(F.coalesce(doc_type, F.lit("")) == "statute", F.lit(0.05)).otherwise(F.lit(0.0))
    return F.when(with_act, F.lit(0.2)).otherwise(F.lit(0.0)) + by_section + kind


def graph_candidate(text: Column, act: Column, section: Column, doc_type: Column, terms: Column, act_hint: Column, sections: Column) -> Column:
    """The score of a document that the citation graph brings in."""
    with_act = F.coalesce(F.lower(act).contains(F.lower(act_hint)), F.lit(False)) & (F.coalesce(act_hint, F.lit("")) != "")
    hit = F.coalesce(F.array_contains(F.transform(sections, F.upper), F.upper(section)), F.lit(False)) & (F.coalesce(section, F.lit("")) != "")
    cover = F.when(F.size(terms) > 0, count_in(F.lower(text), terms) / F.size(terms)).otherwise(F.lit(0.0))
    return (
        F.lit(0.35)
        + F.when(with_act, F.lit(0.2)).otherwise(F.lit(0.0))
        + F.when(hit, F.lit(0.15)).otherwise(F.lit(0.0))
        + F.when(F.coalesce(doc_type, F.lit("")).isin(*STATUTORY, "statute"), F.lit(0.05)).otherwise(F.lit(0.0))
        + F.least(cover, F.lit(1.0)) * F.lit(0.15)
    )


def authority(text: Column, act: Column, section: Column, doc_type: Column, terms: Column) -> Column:
    """Whole points by which authoritative documents come first."""
    kind = F.coalesce(doc_type, F.lit(""))
    cover = F.when(F.size(terms) > 0, F.floor(count_in(F.lower(text), terms) / F.size(terms) * 100)).otherwise(F.lit(0))
    return (
        F.when(kind == "qa", 80).otherwise(0)
        + F.when(F.coalesce(act, F.lit("")) != "", 100).otherwise(0)
        + F.when(F.coalesce(section, F.lit("")) != "", 50).otherwise(0)
        + F.when(kind.isin(*STATUTORY), 20).otherwise(0)
        + cover.cast("int")
    )


def context_confidence(doc_type: Column, section: Column) -> Column:
    """An aggregate: 0 to 1 for a group of context documents."""
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    return F.least(
        share(doc_type.isin(*STATUTORY)) * 0.4 + share(section != "") * 0.3 + F.least(F.count(F.lit(1)) / 5.0, F.lit(1.0)) * 0.3, F.lit(1.0)
    )


def paragraphs(answer: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")


def citation_coverage(answer: Column) -> Column:
    """The share of an answer's paragraphs that cite a source."""
    every = paragraphs(answer)
    return F.when(F.size(every) > 0, F.size(F.filter(every, lambda p: p.rlike(SOURCE_MARK))) / F.size(every)).otherwise(F.lit(0.0))


def is_grounded(answer: Column) -> Column:
    return F.coalesce(answer, F.lit("")).rlike(SOURCE_MARK)


def answer_confidence(confidence: Column, grounded: Column) -> Column:
    """An answer without sources is trusted little."""
    return F.when(grounded, confidence).otherwise(F.least(confidence, F.lit(0.35)))


def confidence_label(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "High").when(confidence >= 0.6, "Medium").when(confidence >= 0.4, "Limited").otherwise("Low")


def annotated(answer: Column, confidence: Column) -> Column:
    """answer with its confidence and, where few paragraphs cite, a note."""
    trust = answer_confidence(confidence, is_grounded(answer))
    note = F.when(citation_coverage(answer) < 0.5, F.lit("\nNote: some statements carry no source.")).otherwise(F.lit(""))
    return F.concat(answer, F.lit("\n\nConfidence: "), confidence_label(trust), note)
