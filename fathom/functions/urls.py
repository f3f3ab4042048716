"""Addresses of documents: names, ids, links and pages."""

from __future__ import annotations

from urllib.parse import parse_qsl, unquote, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a link to a document ends in, and the query keys that hold its name, in order.
DOCUMENT_TYPES = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx")
NAME_KEYS = ("filename", "file", "name")


def document_name(url: str | None) -> str:
    """The name in an address: of a query key, else the last part of the path unless it asks for a document by id."""
    if not url:
        return ""
    parts = urlsplit(url)
    query = dict(reversed(parse_qsl(parts.query)))
    for k in NAME_KEYS:
        if query.get(k, "").strip():
            return unquote(query[k]).strip()
    last = unquote(parts.path.rsplit("/", 1)[-1]).strip()
    return "" if "getdocument" in last.lower() else last


def leads_to_document(url: str, types: tuple[str, ...] = DOCUMENT_TYPES) -> bool:
    """``is_document_link`` on one address."""
    ends = tuple(f".{x}" for x in types)
    try:
        parts = urlsplit(url.lower())
    except ValueError:
        return False
    return parts.path.endswith(ends) or "getdocument" in parts.path or any(v.endswith(ends) for _, v in parse_qsl(parts.query))


def url_filename(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: document_name(v) if isinstance(v, str) else "")

    return run(c)


def name_in_address(url: Column) -> Column:
    """``document_name`` within the engine: the query's first name of a file, else the last part of the path that is no "getdocument"; '' if there is none."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    named = [F.try_url_decode(F.regexp_extract(query, f"(?:^|&){k}=([^&]+)", 1)) for k in NAME_KEYS]
    parts = F.filter(F.split(F.regexp_replace(url, r"^[^/:]*://[^/?#]*|[?#].*$", ""), "/"), lambda x: x != "")
    last = F.try_url_decode(F.replace(F.try_element_at(parts, F.lit(-1)), F.lit("+"), F.lit("%2B")))
    return F.coalesce(*(F.nullif(n, F.lit("")) for n in named), F.when(F.lower(last) != "getdocument", last), F.lit(""))


def is_document_link(url: Column, types: tuple[str, ...] = DOCUMENT_TYPES) -> Column:
    """A path that ends in a document's extension or asks for a document, or a query value that ends in one."""
    ends = f"(?i)\\.({'|'.join(types)})$"
    path = F.regexp_extract(url, r"^[^?#]*", 0)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.coalesce(path.rlike(ends) | F.lower(path).contains("getdocument") | F.exists(F.split(query, "&"), lambda x: x.rlike(ends)), F.lit(False))


def digest_id(url: Column) -> Column:
    """A stable file name: the beginning of the address's hash and its extension, .bin without one."""
    ext = F.regexp_extract(url, r"[^/.](\.[^./]*)$", 1)
    return F.concat(F.lit("doc_"), F.substring(F.sha2(url, 256), 1, 12), F.when(ext == "", ".bin").otherwise(F.lower(ext)))


def set_page(base: str, page: int) -> str:
    """An address with its page parameter set and its fragment dropped."""
    p = urlsplit(base)
    query = [(k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if k != "page"] + [("page", str(page))]
    return urlunsplit((p.scheme, p.netloc, p.path, urlencode(query), ""))


def with_page(base: Column, page: Column) -> Column:
    """``set_page`` within the engine."""
    plain = F.regexp_replace(base, "#.*$", "")
    rest = F.regexp_replace(F.regexp_replace(plain, r"([?&])page=[^&]*&?", "$1"), r"[?&]$", "")
    return F.concat(rest, F.when(F.contains(rest, F.lit("?")), "&").otherwise("?"), F.lit("page="), page.cast("string"))


def sanitized_query(c: Column) -> Column:
    """Letters, digits, underscore, hyphen and single spaces; the rest becomes space."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w\s\-]", " "), r"(?U)\s+", " "))


def query_variants(c: Column) -> Column:
    """The forms in which a query is tried on a remote search, in order, each once: as it is, sanitised, and both with "=" behind."""
    plain = sanitized_query(c)
    return F.array_distinct(F.concat(F.array(c, F.concat(c, F.lit("="))), F.when(plain != "", F.array(plain, F.concat(plain, F.lit("=")))).otherwise(F.array().cast("array<string>"))))
