"""Lines of texts and what they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions import text as t


def text_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_index (int, from 0), raw, normalized, leading_spaces (int): blank lines are kept.

    Null texts have no line; an empty text has one empty line. Tabs are no leading spaces.
    """
    lines = F.split(t.unix_lines(F.col(text)), "\n", -1)
    out = df.select(F.col(key), F.posexplode(lines).alias("line_index", "raw"))
    return out.select(key, "line_index", "raw", t.squeeze(F.col("raw")).alias("normalized"), (F.length("raw") - F.length(F.ltrim("raw"))).alias("leading_spaces"))


def line_kinds(lines: DataFrame, key: str) -> DataFrame:
    """The lines with is_page_marker, is_heading and level (1 for lines that are no numbered heading)."""
    x = F.col("normalized")
    return lines.select(key, "line_index", "normalized", t.is_page_marker(x).alias("is_page_marker"), t.is_heading(x).alias("is_heading"), t.heading_level(x).alias("level"))


def toc_references(lines: DataFrame, key: str) -> DataFrame:
    """key, line_index, title, page: lines that end in leaders and a page number."""
    x = F.col("normalized")
    return lines.where(x.rlike(t.PAGE_REFERENCE)).select(key, "line_index", t.toc_title(x).alias("title"), t.toc_page(x).alias("page"))
