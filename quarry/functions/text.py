"""Text normalisation and tokens as Column functions.

Patterns use (?U) where Unicode white space or letters are meant. Order matters in every chain.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry import dims


def chain(text: Column, *steps: tuple[str, str]) -> Column:
    """text after each (pattern, replacement) in turn; null as empty."""
    return reduce(lambda c, s: F.regexp_replace(c, F.lit(s[0]), F.lit(s[1])), steps, F.coalesce(text, F.lit("")))


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


NBSP = "\u00a0"
_LINES = [(r"\r\n?", "\n")]
_CAMEL = [(r"([a-z])([A-Z])", "$1 $2"), (r"([a-zA-Z])([0-9])", "$1 $2"), (r"([0-9])([a-zA-Z])", "$1 $2")]


def normalize_text(text: Column, strict: bool = False) -> Column:
    """Page text made uniform: line ends, spaces, split words and numbers, section and chapter heads.

    strict: only whole words Section and Sec are heads, and numbers keep their letter (13B).
    """
    section = r"\b(?:SECTION|Section|Sec\.?)\s+([0-9][0-9A-Za-z().]*)" if strict else r"(?U)(?:SECTION|Section|Sec\.?)[\s]*([0-9A-Za-z().]+)"
    split = _CAMEL[:1] if strict else _CAMEL
    return strip(
        chain(
            text, *_LINES, (NBSP, " "), ("\u00c2", ""), *split, (section, "\n\nSection $1\n"),
            (r"(?U)(?:CHAPTER|Chapter)[\s]*([IVXLC0-9]+)", "\n\nChapter $1\n"), (r"\n{3,}", "\n\n"), (r"[ \t]+", " "),
        )
    )


def strip_markdown(text: Column) -> Column:
    """Without fenced blocks and backticks."""
    return chain(text, (r"(?s)```.*?```", " "), ("`", ""))


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def normalize_unicode(text: Column) -> Column:
    """NFKC, without direction marks and control characters other than line feed and tab."""
    return chain(_nfkc(chain(text, *_LINES, (NBSP, " "))), (r"[\p{C}&&[^\n\t]]", ""))


def fix_ocr_spacing(text: Column) -> Column:
    """A space where scanned words, numbers and Devanagari run together."""
    deva = "\u0900-\u097F"
    return chain(text, *_CAMEL, (f"([{deva}])([A-Za-z0-9])", "$1 $2"), (f"([A-Za-z0-9])([{deva}])", "$1 $2"))


def join_hyphens(text: Column) -> Column:
    return chain(text, (r"([A-Za-z])-\n([A-Za-z])", "$1$2"))


def tidy_lines(text: Column) -> Column:
    """Each line without outer and repeated spaces; at most one blank line in a row."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: strip(F.regexp_replace(x, r"[ \t]+", " ")))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def break_at_heads(text: Column) -> Column:
    """Section and chapter heads, English and Hindi, on lines of their own."""
    number, roman = r"\s*([0-9A-Za-z().]+)\s*", r"\s*([IVXLC0-9]+)\s*"
    heads = [("SECTION|Section|Sec\\.?", number, "Section"), ("CHAPTER|Chapter", roman, "Chapter"), ("धारा", number, "धारा"), ("अध्याय", roman, "अध्याय")]
    return chain(text, *((rf"(?m)^\s*(?:{word}){tail}", f"\n\n{name} $1\n") for word, tail, name in heads))


def normalize_extracted(text: Column) -> Column:
    """All of the above, in the order that page conversion needs."""
    return tidy_lines(break_at_heads(fix_ocr_spacing(join_hyphens(chain(normalize_unicode(text), ("[\u00c2\ufffd]", ""))))))


def markdown_to_plain(md: Column) -> Column:
    return strip(
        chain(
            md, (r"(?m)^#{1,6}\s+", ""), (r"\*{1,3}([^*]+)\*{1,3}", "$1"), (r"(?m)^---+\s*$", ""), (r"```[a-z]*\n?", ""), (r"\n{3,}", "\n\n"),
        )
    )


def preprocess_query(query: Column) -> Column:
    """A question with single spaces, in lower case, of ASCII letters, digits and a little punctuation."""
    return chain(F.lower(strip(chain(query, (r"(?U)\s+", " ")))), (r"[^a-z0-9\s,\-./()]", ""))


def clean_title(title: Column) -> Column:
    """A section title without outer dots, colons and dashes, at most 180 characters long."""
    return strip(F.substring(chain(F.btrim(F.coalesce(title, F.lit("")), F.lit(" .:-")), (r"(?U)\s+", " ")), 1, 180))


def tokens(text: Column) -> Column:
    """array<string> between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def alnum_tokens(text: Column, stopwords: bool = False) -> Column:
    """Lower-case runs of a-z and 0-9 of three or more characters; stopwords: without those."""
    out = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda x: F.length(x) > 2)
    return F.array_except(out, F.array(*map(F.lit, dims.STOPWORDS))) if stopwords else out


def is_poor_text(text: Column, least: int = 300, least_spaces: float = 0.02, most_word: float = 12.0) -> Column:
    """Whether extracted text is too short, or its words too long, to be real text."""
    raw = strip(F.coalesce(text, F.lit("")))
    words = tokens(raw)
    spaces = (F.length(raw) - F.length(F.replace(raw, F.lit(" "), F.lit("")))) / F.greatest(F.length(raw), F.lit(1))
    mean = F.length(F.array_join(words, "")) / F.greatest(F.size(words), F.lit(1))
    return (F.length(raw) < least) | (F.size(words) == 0) | (spaces < least_spaces) | (mean > most_word)


def is_poor_letters(text: Column, least: int = 300, least_spaces: float = 0.02, most_word: float = 12.0, words_read: int = 50_000) -> Column:
    """is_poor_text() with only letters counted as word characters, over the first words."""
    raw = strip(F.coalesce(text, F.lit("")))
    words = F.slice(tokens(raw), 1, words_read)
    spaces = (F.length(raw) - F.length(F.replace(raw, F.lit(" "), F.lit("")))) / F.greatest(F.length(raw), F.lit(1))
    mean = F.length(F.regexp_replace(F.array_join(words, ""), r"\P{L}", "")) / F.greatest(F.size(words), F.lit(1))
    return (F.length(raw) < least) | (spaces < least_spaces) | (F.size(words) == 0) | (mean > most_word)


def line_signature(line: Column) -> Column:
    """What a running head has in common over pages: no case, no numbers, no punctuation; '' if short."""
    sig = strip(
        chain(F.lower(normalize_unicode_plain(line)), (r"[0-9]+", "#"), (r"\b(page|pg)\b", "page"), (r"(?U)[^\w\s#]", " "), (r"(?U)\s+", " "))
    )
    return F.when(F.length(sig) < 4, F.lit("")).otherwise(sig)


def normalize_unicode_plain(text: Column) -> Column:
    """normalize_unicode() but for NFKC, inside the JVM."""
    return chain(text, *_LINES, (NBSP, " "), (r"[\p{C}&&[^\n\t]]", ""))


LANGUAGE_CODES = {
    "english": "en", "hindi": "hi", "bengali": "bn", "marathi": "mr", "tamil": "ta", "telugu": "te", "kannada": "kn",
    "malayalam": "ml", "gujarati": "gu", "punjabi": "pa", "urdu": "ur",
}


def language_code(name: Column) -> Column:
    """The code of a language by name; a code stays; an unknown name of several words goes by its first."""
    known = F.create_map(*(F.lit(x) for kv in LANGUAGE_CODES.items() for x in kv))
    low = F.lower(F.array_join(tokens(name), " "))
    first = F.element_at(F.split(low, " "), 1)
    return (
        F.when(low == "", F.lit("en"))
        .when(low.rlike("^[a-z]{2,3}(-[a-z]{2,4})?$"), F.coalesce(F.try_element_at(known, low), low))
        .otherwise(F.coalesce(F.try_element_at(known, low), F.try_element_at(known, first), low))
    )
