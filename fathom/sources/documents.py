"""Sources and sinks of documents: parsed JSON, binaries, folders, result pages, logs."""

from __future__ import annotations

import html.parser
import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions import text as t
from fathom.functions import urls
from fathom.operators.fusion import TITLE_KEYS

SECTION = "struct<index:int, heading:string, title:string, level:int, page:int, source:string, raw_text:string, text:string, path:array<string>, path_text:string>"
PARSED = f"path string, binary_path string, raw_text string, text string, sections array<{SECTION}>, metadata map<string,string>, _corrupt_record string"
#: Attributes of a result button and the fields they become.
BUTTON_FIELDS = {
    "data-documentcollection": "document_collection", "data-process": "process", "data-publishdate": "publish_date", "data-subjectarea": "subject_area", "data-title": "title", "data-typeofaction": "type_of_action",
    "data-validforarea": "valid_for_area", "data-version": "version", "data-comment": "comment", "data-type": "document_type", "data-url": "metadata_url", "data-taxkeyword": "tax_keyword",
}


def scan_parsed(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """Parsed documents of a folder with ``path`` (its own, else the file's), one JSON object a file, or with ``lines`` one a line, as ``write_parsed`` writes them. Malformed ones are left out."""
    raw = spark.read.schema(PARSED).option("multiLine", not lines).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(folder)
    named = raw.withColumn("path", F.coalesce("path", F.col("_metadata.file_path")))
    return named.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def write_parsed(docs: DataFrame, folder: str) -> None:
    """The documents as JSON lines."""
    docs.write.mode("overwrite").json(folder)


def write_metadata(records: DataFrame, folder: str, source_url: str = "source_url", metadata: str = "metadata") -> None:
    """Documents that were not fetched: their address and metadata as JSON lines."""
    records.select(F.col(source_url).alias("source_url"), F.col(metadata).alias("metadata")).write.mode("overwrite").json(folder)


def crawl_summary(results: DataFrame, path: str = "path") -> DataFrame:
    """attempted, downloaded: one row; a result without a path was not fetched."""
    return results.agg(F.count(F.lit(1)).alias("attempted"), F.count(t.first_value(F.col(path))).alias("downloaded"))


def folder_signature(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """n_files, last_modified, n_bytes: one row that changes when the files do."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.max("modificationTime").alias("last_modified"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))


def index_signature(folder: DataFrame, **settings) -> DataFrame:
    """signature: a hash of the folder's signature and the settings, equal if the index may be used again."""
    named = [F.lit(settings[k]).alias(k) for k in sorted(settings)]
    return folder.select(F.sha2(F.to_json(F.struct("*", *named)), 256).alias("signature"))


def _docx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = z.read("word/document.xml").decode("utf-8", "replace")
    return re.sub(r"<[^>]+>", "", re.sub(r"</w:p>", "\n", body))


_STREAM = re.compile(rb"<<(?P<dict>(?:[^<>]|<<[^<>]*>>|<[^<>]*>)*)>>\s*stream\r?\n(?P<data>.*?)\r?\n?endstream", re.S)
_SHOWN = re.compile(rb"\((?P<text>(?:[^()\\]|\\.)*)\)|<(?P<hex>[0-9A-Fa-f\s]+)>|(?P<line>\bT\*|\bT[dDm]\b|\bET\b|['\"](?=\s))", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\n", b"t": b"\t", b"b": b"", b"f": b"\n", b"\n": b"", b"\r": b""}


def _pdf_streams(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The dictionary and the content of a PDF's streams; those that can't be inflated are left out."""
    for m in _STREAM.finditer(data):
        raw = m["data"]
        if b"FlateDecode" in m["dict"]:
            try:
                raw = zlib.decompressobj().decompress(raw)
            except zlib.error:
                continue
        yield m["dict"], raw


def _pdf_pages(data: bytes) -> int | None:
    """The page objects of a PDF, also those within object streams; None if there is none."""
    inside = b"".join(x for d, x in _pdf_streams(data) if b"/ObjStm" in d)
    n = sum(len(re.findall(rb"/Type\s*/Page(?![a-zA-Z])", x)) for x in (_STREAM.sub(b"", data), inside))
    return n or None


def _pdf_text(data: bytes) -> str:
    """The strings that a PDF's pages show, in the order of its content streams.

    Fonts of one byte a character (WinAnsi) are read; others need a library's reader in ``READERS``.
    """
    lines = [b""]
    for _, x in _pdf_streams(data):
        for block in re.findall(rb"\bBT\b(.*?\bET\b)", x, re.S):
            for m in _SHOWN.finditer(block):
                if m["line"]:
                    lines += [b""] * bool(lines[-1])
                elif m["hex"]:
                    digits = re.sub(rb"\s", b"", m["hex"])
                    lines[-1] += bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
                else:
                    lines[-1] += re.sub(rb"\\([0-7]{1,3}|.)", lambda e: bytes([int(e[1], 8) % 256]) if e[1].isdigit() else _ESCAPES.get(e[1], e[1]), m["text"], flags=re.S)
    return "\n".join(x.decode("cp1252", "replace") for x in lines if x.strip())


#: Readers of binary documents by extension; better ones can be registered.
READERS: dict[str, Callable[[bytes], str]] = {".docx": _docx_text, ".pdf": _pdf_text, ".txt": lambda b: b.decode("utf-8", "replace")}


def extract(binaries: DataFrame) -> DataFrame:
    """path, text, page_count of binary documents (path, content). Unknown types and unreadable files give '' and null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b.path, b.content):
                ext = re.search(r"\.[^./]*$", path.lower())
                text = ""
                try:
                    if ext and ext.group() in READERS and data is not None:
                        text = READERS[ext.group()](bytes(data))
                except (KeyError, ValueError, zipfile.BadZipFile):
                    pass
                rows.append((path, text, _pdf_pages(bytes(data)) if ext and ext.group() == ".pdf" and data is not None else None))
            yield pd.DataFrame(rows, columns=["path", "text", "page_count"]).astype({"page_count": "Int32"})

    return binaries.select("path", "content").mapInPandas(run, "path string, text string, page_count int")


class _Rows(html.parser.HTMLParser):
    """Result rows of a page: the first link of each, and its button's attributes; and all links of the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.links: list[list] = []  # address, text
        self.tag, self.depth, self.open = "", 0, False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        if self.depth:
            self.depth += tag == self.tag
        elif "file-row" in classes:
            self.tag, self.depth = tag, 1
            self.rows.append({"link": None, "fields": {}})
        if tag == "a" and "href" in a:
            self.links.append([(a["href"] or "").strip(), ""])
            self.open = True
            if self.depth and self.rows[-1]["link"] is None:
                self.rows[-1]["link"] = len(self.links) - 1
        if tag == "button" and self.depth and "file-metadata" in classes and not self.rows[-1]["fields"]:
            self.rows[-1]["fields"] = {BUTTON_FIELDS[k]: v.strip() for k, v in a.items() if k in BUTTON_FIELDS and v is not None}

    def handle_endtag(self, tag):
        self.depth -= self.depth > 0 and tag == self.tag
        self.open = self.open and tag != "a"

    def handle_data(self, data):
        if self.open:
            self.links[-1][1] += data


def _absolute(base: str, href: str) -> str:
    """An address as seen from a page, without its fragment; one that can't be read stays as it is."""
    try:
        return urldefrag(urljoin(base, href)).url
    except ValueError:
        return href


def page_links(pages: DataFrame, key: str, page: str, url: str | None = None, rows: bool = True) -> DataFrame:
    """key, position (int, from 1), url, title, fields: the documents of result pages.

    Addresses are resolved against that of their page (``url``) and lose their
    fragment; only those of documents count, each once a page. A row's first link
    counts, with the attributes of its button that are there; all links do where no
    row leads to a document, or without ``rows``. A blank title becomes the name in
    the address. Null and empty pages have none.
    """
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, base, s in zip(b[key], b["_base"], b[page]):
                p = _Rows()
                if isinstance(s, str):
                    p.feed(s)
                    p.close()
                every = [(*x, {}) for x in p.links]
                first = [(*p.links[r["link"]], r["fields"]) for r in p.rows if r["link"] is not None] if rows else []
                found = {}
                for some in (first, every):
                    for href, title, fields in some if not found else ():
                        to = _absolute(base or "", href)
                        if urls.leads_to_document(to) and to not in found:
                            found[to] = (" ".join(title.split()) or urls.document_name(to), fields)
                out += [(k, n, to, *x) for n, (to, x) in enumerate(found.items(), 1)]
            yield pd.DataFrame(out, columns=[key, "position", "url", "title", "fields"])

    base = F.col(url) if url else F.lit("")
    return pages.select(key, base.alias("_base"), page).mapInPandas(run, f"{key} {kind}, position int, url string, title string, fields map<string,string>")


def page_urls(spark: SparkSession, base: str, first: int, last: int) -> DataFrame:
    """page (long), url of the pages first to last."""
    return spark.range(first, last + 1).select(F.col("id").alias("page"), urls.with_page(F.lit(base), F.col("id")).alias("url"))


def live_scores(links: DataFrame, pages: DataFrame, query_id: str, page: str, doc: str, position: str, k: int) -> DataFrame:
    """query_id, doc, score, rank: a document counts at its first place; the score is k less the places before it, at least 1.

    Pages are read in their order until one holds no document that is new
    (``pages`` has query_id and page of all that were fetched, also of empty ones).
    """
    place = F.struct(F.col(page).alias("page"), F.col(position).alias("at"))
    first = links.where(F.coalesce(F.col(doc), F.lit("")) != "").groupBy(query_id, doc).agg(F.min(place).alias("_p"))
    new = first.groupBy(query_id, F.col("_p.page").alias(page)).agg(F.count(F.lit(1)).alias("_new"))
    stop = pages.select(query_id, page).distinct().join(new, [query_id, page], "left").where("_new is null").groupBy(query_id).agg(F.min(page).alias("_stop"))
    read = first.join(stop, query_id, "left").where(F.col("_stop").isNull() | (F.col("_p.page") < F.col("_stop")))
    n = F.row_number().over(Window.partitionBy(query_id).orderBy("_p", doc))
    return read.withColumn("rank", n).where(F.col("rank") <= k).select(query_id, doc, F.greatest(F.lit(1), k - (F.col("rank") - 1)).cast("double").alias("score"), "rank")


def append_log(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Rows appended to a log of fixed columns, all text; unknown columns are dropped, missing ones ''."""
    have = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns}
    rows.select(*(have.get(c, F.lit("")).alias(c) for c in columns)).write.mode("append").parquet(path)


def title_of(metadata: Column, url: Column) -> Column:
    """The first title that is not blank in the metadata, else the name in the address without its extension, else ''."""
    return F.coalesce(t.first_value(*(metadata[k] for k in TITLE_KEYS), F.regexp_replace(urls.name_in_address(url), r"(?<=.)\.[^.]*$", "")), F.lit(""))
