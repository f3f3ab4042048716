"""Text expressions on columns: cleaning, tokens, headings, slugs and document ids."""

from __future__ import annotations

import os
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as in Unicode, with the separators U+001C to U+001F.
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: Patterns of page markers, labels that open no section, numbered headings, trailing page references, approval dates,
#: tokens, dashes that count as one, extensions that are no part of a document's name.
PAGE_MARKER = r"(?iu)^(page|sidan) [0-9]+( (of|av) [0-9]+)?$"
LABELLED = r"(?iu)^(docplus-id|version|handlingstyp|godkänt den|ansvarig|gäller för)\s*:"
NUMBERED = r"(?iu)^([0-9]+(\.[0-9]+)*|[IVXLCM]+)[).:\-]?\s+\S"
PAGE_REFERENCE = r"\s*[._·\-…]{2,}\s*([0-9]+)$"
APPROVED = r"Godkänt den:\s*([0-9]{4}-[0-9]{2}-[0-9]{2})"
TOKEN = "[0-9A-Za-zÅÄÖåäö]+"
UNICODE_TOKEN = r"[\p{L}\p{N}\p{Co}]+"
DASHES = "‐‑‒–—―−"
EXTENSIONS = (".pdf", ".doc", ".docx", ".rtf", ".txt")


def squeeze(c: Column) -> Column:
    """White space collapsed to single spaces and trimmed; null stays null."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def unix_lines(c: Column) -> Column:
    """CRLF, CR and form feed become LF."""
    return F.regexp_replace(c, r"\r\n|\r|\f", "\n")


def tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits and ÅÄÖ, in small letters; other letters divide. Null gives null."""
    return F.transform(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), F.lower)


def unicode_tokens(c: Column) -> Column:
    """Runs of letters and digits of any script, in small letters."""
    return F.transform(F.regexp_extract_all(c, F.lit(UNICODE_TOKEN), F.lit(0)), F.lower)


def slug(c: Column, sign: str = "-", empty: str = "run") -> Column:
    s = F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", sign)
    s = F.regexp_replace(s, f"^{sign}+|{sign}+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", empty).otherwise(s)


def word_count(c: Column) -> Column:
    return F.when(squeeze(c) == "", 0).otherwise(F.size(F.split(squeeze(c), " ")))


def is_page_marker(line: Column) -> Column:
    return squeeze(line).rlike(PAGE_MARKER)


def is_labelled(line: Column) -> Column:
    return squeeze(line).rlike(LABELLED)


def _letters(c: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{pattern}]", ""))


def is_heading(line: Column) -> Column:
    """Whether a line can be a heading: 3 to 140 characters, at most 18 words, no closing mark; numbered,
    mostly in capitals, or with a capital as the first character of nearly all of its 2 to 10 words."""
    x = squeeze(line)
    letters, upper = _letters(x, r"\p{L}"), _letters(x, r"\p{Lu}")
    words = F.split(x, " ")
    titled = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}.*\p{Ll}")))
    n = F.size(words)
    plausible = F.length(x).between(3, 140) & ~x.rlike(PAGE_MARKER) & ~x.rlike(LABELLED) & ~x.rlike(r"[.;?!]$") & (letters > 0) & (n <= 18)
    shaped = x.rlike(NUMBERED) | (upper / letters >= 0.72) | (n.between(2, 10) & (titled >= F.greatest(F.lit(2), n - 1)))
    return F.coalesce(plausible & shaped, F.lit(False))


def heading_level(heading: Column) -> Column:
    """Depth of the dotted number that opens a heading, else 1."""
    number = F.regexp_extract(heading, r"^([0-9]+(\.[0-9]+)*)", 1)
    return F.when(number == "", 1).otherwise(F.size(F.split(number, r"\.")))


def toc_title(line: Column) -> Column:
    """The title of a line of a list of contents, without leaders and page; null if there is no page reference."""
    x = squeeze(line)
    title = F.trim(F.regexp_replace(x, PAGE_REFERENCE, ""))
    return F.when(x.rlike(PAGE_REFERENCE), F.regexp_replace(title, r"[.\-·_… ]+$", ""))


def toc_page(line: Column) -> Column:
    return F.regexp_extract(squeeze(line), PAGE_REFERENCE, 1).try_cast("int")


def approved_date(text: Column) -> Column:
    """The approval date within the first 500 characters as text, null if there is none."""
    found = F.regexp_extract(F.substring(text, 1, 500), APPROVED, 1)
    return F.when(found != "", found)


def first_value(*options: Column) -> Column:
    """The first option that is neither null nor blank."""
    return F.coalesce(*(F.nullif(F.trim(o), F.lit("")) for o in options))


def doc_id(value: object) -> str:
    """A document's name in its normal form: NFKC, one dash, no known extension, single spaces, folded case."""
    if value is None or value != value:
        return ""
    s = unicodedata.normalize("NFKC", str(value)).translate(dict.fromkeys(map(ord, DASHES), "-")).strip()
    stem, ext = os.path.splitext(s)
    if ext.lower() in EXTENSIONS:
        s = stem
    return re.sub(r"\s+", " ", s).strip().casefold()


def normal_doc_id(c: Column) -> Column:
    """``doc_id`` on a column, exactly, by way of Arrow; null gives ''."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(doc_id)

    return run(c)


def plain_doc_id(c: Column) -> Column:
    """``doc_id`` within the engine for texts that need neither NFKC nor special case folding."""
    s = F.trim(F.translate(F.coalesce(c, F.lit("")), DASHES, "-" * len(DASHES)))
    return squeeze(F.lower(F.regexp_replace(s, r"(?i)(?<=.)\.(pdf|docx?|rtf|txt)$", "")))
