"""Queries of the source and statistics operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import text as t
from fathom.functions import urls
from fathom.operators import analytics, sections, stored
from fathom.plans.text_queries import WS, doc_id_sql, sq
from fathom.session import shared_folder
from fathom.sources import documents
from fathom.streaming import events as streaming
from fathom.tables import load

FIELDS = ["document_collection", "process", "publish_date", "subject_area", "type_of_action", "valid_for_area", "version", "comment", "document_type", "tax_keyword", "title"]
VALUE_FIELDS = ["document_type", "process", "type_of_action", "document_collection", "subject_area", "valid_for_area"]
AS_OF = "2026-01-01"
BASE = "https://dokument.lovtuna.example/search?q=rutin&page=1#top"


def _meta(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "metadata")


def scan_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the chunks, written as parsed JSON once and scanned."""
    folder = f"{shared_folder(spark)}/fathom-parsed/{stored.signature(spark, f'{d}/chunk_metadata.parquet', kind='parsed')}"
    if not stored.exists(spark, f"{folder}/_SUCCESS"):
        m = F.from_json("metadata_json", "map<string,string>")
        c = load(spark, d, "chunk_metadata").groupBy(F.col("source_path").alias("path")).agg(F.min_by("metadata_json", "chunk_id").alias("metadata_json"), F.min("chunk_id").cast("string").alias("binary_path"))
        documents.write_parsed(c.select("path", "binary_path", m.alias("metadata")), folder)
    docs = documents.scan_parsed(spark, folder, lines=True)
    return docs.select(F.col("path").alias("source_path"), F.col("metadata.title").alias("title"), F.col("metadata.page_count").try_cast("int").alias("page_count"), F.col("binary_path").cast("long").alias("first_chunk"))


def dir_signature(spark: SparkSession, d: str) -> DataFrame:
    return documents.folder_signature(spark, d, "*.parquet")


def index_signature(spark: SparkSession, d: str) -> DataFrame:
    return documents.index_signature(documents.folder_signature(spark, d, "chunk_metadata*"), size=500, overlap=50, version=1)


def backfill_missing(spark: SparkSession, d: str) -> DataFrame:
    m = _meta(spark, d)
    return analytics.backfill(m.select("record_id", "stem", "page_count"), m.select("stem", "page_count").where("page_count is not null"), "stem", "page_count").select("record_id", "page_count")


def page_urls(spark: SparkSession, d: str) -> DataFrame:
    return documents.page_urls(spark, BASE, 1, 50)


def url_set_param(spark: SparkSession, d: str) -> DataFrame:
    return _meta(spark, d).select("record_id", urls.with_page(F.col("metadata_url"), F.col("record_id")).alias("url"))


#: Records on a result page, and pages of a search.
A_PAGE, PAGES = 25, 4
BUTTON = {f: a for a, f in documents.BUTTON_FIELDS.items()}


def _escaped(c: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Result pages made of the records, some to a page, with a row that leads to no document before each page's records."""
    m = _meta(spark, d)
    attributes = F.concat(*(F.coalesce(F.concat(F.lit(f' {a}="'), _escaped(F.col(f)), F.lit('"')), F.lit("")) for f, a in BUTTON.items()))
    link = F.concat(F.regexp_replace("source_url", "^https://[^/]*", ""), F.lit("#sida-2"))
    one = F.concat(F.lit('<div class="file-row"><div><a href="'), link, F.lit('">'), _escaped(F.coalesce("title", F.lit(""))), F.lit('</a></div><a href="/other">x</a><button class="file-metadata"'), attributes, F.lit("></button></div>"))
    rows = m.select(F.floor(F.col("record_id") / A_PAGE).alias("page_id"), "record_id", one.alias("h"))
    made = rows.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("record_id", "h"))), lambda x: x.h), "\n").alias("h"))
    return made.select("page_id", urls.with_page(F.lit(BASE), F.col("page_id")).alias("page_url"), F.concat(F.lit('<div class="file-row"><a href="/hjalp">Hj&auml;lp</a></div>'), "h").alias("html"))


def extract_links(spark: SparkSession, d: str) -> DataFrame:
    links = documents.page_links(_pages(spark, d), "page_id", "html", "page_url")
    told = F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat_ws("=", e["key"], e["value"])), "|")
    return links.select("page_id", "position", "url", "title", told.alias("fields"))


def live_rank_score(spark: SparkSession, d: str) -> DataFrame:
    """A search of some pages each; documents by their title."""
    pages = _pages(spark, d).withColumn("search_id", F.floor(F.col("page_id") / PAGES))
    links = documents.page_links(pages, "page_id", "html", "page_url", rows=False)
    found = links.select(F.floor(F.col("page_id") / PAGES).alias("search_id"), "page_id", "position", t.plain_doc_id(F.col("title")).alias("doc_id"))
    return documents.live_scores(found, pages.select("search_id", "page_id"), "search_id", "page_id", "doc_id", "position", 20)


def is_document_link(spark: SparkSession, d: str) -> DataFrame:
    m = _meta(spark, d)
    u = F.when(F.col("record_id") % 4 == 0, F.concat("source_url", F.lit("&f=a.PDF"))).when(F.col("record_id") % 4 == 1, F.concat(F.lit("https://x.example/d/"), F.col("stem"), F.lit(".docx#p"))).when(F.col("record_id") % 4 == 2, F.lit("https://x.example/d/index.html")).otherwise(F.col("source_url"))
    return m.select("record_id", u.alias("url")).select("record_id", urls.is_document_link(F.col("url")).alias("is_link"))


def url_filename(spark: SparkSession, d: str) -> DataFrame:
    return _meta(spark, d).select("record_id", urls.url_filename(F.concat(F.lit("https://x.example/a%20b/"), F.col("stem"), F.lit(".pdf?x=1"))).alias("by_path"), urls.url_filename(F.concat("source_url", F.lit("&file=Rutin%20"), F.col("record_id"), F.lit(".doc"))).alias("by_query"))


def url_digest_id(spark: SparkSession, d: str) -> DataFrame:
    return _meta(spark, d).select("record_id", urls.digest_id(F.concat("source_url", F.lit("&f=a.pdf"))).alias("file_id"))


def doc_title(spark: SparkSession, d: str) -> DataFrame:
    """Titles of the records, of the name in the address where every other record has none."""
    m = _meta(spark, d)
    known = F.create_map(F.lit("title"), F.when(F.col("record_id") % 2 == 1, F.col("title")), F.lit("name"), F.lit(" "))
    return m.select("record_id", documents.title_of(known, F.concat("source_url", F.lit("&file=Rutin%20"), F.col("record_id"), F.lit(".v2.doc"))).alias("title"))


def sanitize_query(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "submissions").select("id", urls.sanitized_query(F.col("information_need")).alias("query"))


def query_variants(spark: SparkSession, d: str) -> DataFrame:
    q = F.concat("query_text", F.when(F.col("id") % 2 == 0, "?").otherwise(""))
    return load(spark, d, "submissions").where(F.trim("query_text") != "").select("id", F.array_join(urls.query_variants(q), "|").alias("variants"))


def length_stats(spark: SparkSession, d: str) -> DataFrame:
    return analytics.length_stats(_meta(spark, d), "page_count")


def percentiles(spark: SparkSession, d: str) -> DataFrame:
    return analytics.percentiles(_meta(spark, d), "page_count")


def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return analytics.value_counts(_meta(spark, d), "document_type")


def field_coverage(spark: SparkSession, d: str) -> DataFrame:
    return analytics.field_coverage(_meta(spark, d), FIELDS)


def multivalue_counts(spark: SparkSession, d: str) -> DataFrame:
    return analytics.multivalue_counts(_meta(spark, d), VALUE_FIELDS)


def unique_values(spark: SparkSession, d: str) -> DataFrame:
    return analytics.unique_values(_meta(spark, d), VALUE_FIELDS)


def age_stats(spark: SparkSession, d: str) -> DataFrame:
    return analytics.age_stats(_meta(spark, d), "publish_date", AS_OF)


def approved_stats(spark: SparkSession, d: str) -> DataFrame:
    return analytics.approved_stats(load(spark, d, "documents"), "doc_id", "text")


def approved_counts(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "documents").select(t.approved_date(F.col("text")).alias("approved")).where("approved is not null")
    return a.groupBy("approved").agg(F.count(F.lit(1)).alias("n"))


def _titles(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_extract("source_path", r"([^/]*)\.json$", 1)
    return load(spark, d, "chunk_metadata").groupBy(path.alias("stem")).agg(F.min(F.get_json_object("metadata_json", "$.title")).alias("parsed_title"), F.count(F.lit(1)).alias("n_chunks"))


def metadata_export(spark: SparkSession, d: str) -> DataFrame:
    cell = lambda c: t.squeeze(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c)
    m = _meta(spark, d).select("record_id", "stem", *map(cell, FIELDS), "page_count")
    return m.join(_titles(spark, d), "stem", "left")


def latest_metadata(spark: SparkSession, d: str) -> DataFrame:
    return analytics.latest_records(_meta(spark, d), "stem", ["downloaded_at", "record_id"]).select("stem", "record_id")


def age_histogram(spark: SparkSession, d: str) -> DataFrame:
    years = analytics.age_days(analytics.lenient_date(F.col("publish_date")), AS_OF) / analytics.DAYS_A_YEAR
    return analytics.step_histogram(_meta(spark, d).select(years.alias("years")), "years", 0.5)


def equal_width_hist(spark: SparkSession, d: str) -> DataFrame:
    return analytics.equal_width(load(spark, d, "documents"), "n_chars", 20)


def zero_filled_counts(spark: SparkSession, d: str) -> DataFrame:
    return analytics.zero_filled(_meta(spark, d), "page_count", 0, 30)


def toc_coverage(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    toc = sections.toc_entries(docs, "doc_id", "text").select("doc_id").distinct().withColumn("has_toc", F.lit(1))
    return docs.join(toc, "doc_id", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("has_toc").alias("n_toc"))


def docs_without_toc(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    toc = sections.toc_entries(docs, "doc_id", "text").select("doc_id").distinct()
    return docs.join(toc, "doc_id", "left_anti").select("doc_id", t.first_value(F.col("title"), F.col("source")).alias("title"), "n_chars")


def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    """The streaming aggregate over the events at rest: the same plan as over a stream."""
    e = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streaming.windowed_counts(e, "1 day").select("event_type", F.date_format("start", "yyyy-MM-dd").alias("day"), "n", "total")


QUERIES = {
    f.__name__: f
    for f in (scan_documents, dir_signature, index_signature, backfill_missing, page_urls, url_set_param, extract_links, live_rank_score, is_document_link, url_filename, url_digest_id, doc_title, sanitize_query, query_variants, length_stats, percentiles, value_counts, field_coverage, multivalue_counts, unique_values, age_stats, approved_stats, approved_counts, metadata_export, latest_metadata, age_histogram, equal_width_hist, zero_filled_counts, toc_coverage, docs_without_toc, windowed_events)
}

_SANITIZED = "trim(regexp_replace(regexp_replace({}, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}\\s\\x{{a0}}\\-]', ' ', 'g'), '[\\s\\x{{a0}}]+', ' ', 'g'))"
_DATE = "case when regexp_matches(publish_date, '^\\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\\s*$') then try_cast(regexp_replace(regexp_replace(trim(publish_date), '-([0-9])-', '-0\\1-'), '-([0-9])$', '-0\\1') as date) end"
_VALUES = ", ".join(f"'{f}'" for f in VALUE_FIELDS)
_ALL = ", ".join(f"'{f}'" for f in FIELDS)
_PLAIN_URL = "regexp_replace(regexp_replace(regexp_replace({}, '#.*$', ''), '([?&])page=[^&]*&?', '\\1', 'g'), '[?&]$', '')"
_FIELDS = ", ".join(f"'{f}=' || regexp_replace({f}, '^{WS}|{WS}$', '', 'g')" for f in sorted(documents.BUTTON_FIELDS.values()))
_LINKS = f"""a as (select record_id // 25 as page_id, record_id, source_url url, {sq("coalesce(title, '')")} title, '' as name, array_to_string(list_filter([{_FIELDS}], lambda v: v is not null), '|') fields from metadata),
b as (select * from a qualify row_number() over (partition by page_id, url order by record_id) = 1)"""
ORACLE = {
    "scan_documents": "select source_path, json_extract_string(arg_min(metadata_json, chunk_id), '$.title') as title, try_cast(json_extract_string(arg_min(metadata_json, chunk_id), '$.page_count') as int) as page_count, min(chunk_id) as first_chunk from chunk_metadata group by 1",
    "backfill_missing": "select record_id, coalesce(page_count, max(page_count) over (partition by stem)) as page_count from metadata",
    "page_urls": "select n as page, 'https://dokument.lovtuna.example/search?q=rutin&page=' || n as url from range(1, 51) t(n)",
    "url_set_param": f"with a as (select record_id, {_PLAIN_URL.format('metadata_url')} u from metadata) select record_id, u || (case when contains(u, '?') then '&' else '?' end) || 'page=' || record_id as url from a",
    "extract_links": f"with {_LINKS} select page_id, row_number() over (partition by page_id order by record_id) as position, url, coalesce(nullif(title, ''), name) as title, fields from b",
    "live_rank_score": f"""with {_LINKS}, c as (select page_id, page_id // {4} search_id, {doc_id_sql("coalesce(nullif(title, ''), name)")} doc_id, record_id from b),
f as (select search_id, doc_id, min(record_id) p, min(page_id) page_id from c where doc_id <> '' group by 1, 2),
x as (select search_id, min(page_id) stop from (select distinct search_id, page_id from c) where (search_id, page_id) not in (select (search_id, page_id) from f) group by 1)
select search_id, doc_id, greatest(1, 20 - (row_number() over (partition by search_id order by p) - 1))::double as score, row_number() over (partition by search_id order by p) as rank from f left join x using (search_id) where stop is null or page_id < stop qualify rank <= 20""",
    "is_document_link": "with a as (select record_id, case record_id % 4 when 0 then source_url || '&f=a.PDF' when 1 then 'https://x.example/d/' || stem || '.docx#p' when 2 then 'https://x.example/d/index.html' else source_url end u from metadata) select record_id, coalesce(regexp_matches(regexp_extract(u, '^[^?#]*'), '(?i)\\.(pdf|docx?|xlsx?|pptx?)$') or contains(lower(regexp_extract(u, '^[^?#]*')), 'getdocument') or len(list_filter(string_split(regexp_extract(u, '\\?([^#]*)', 1), '&'), lambda x: regexp_matches(x, '(?i)\\.(pdf|docx?|xlsx?|pptx?)$'))) > 0, false) as is_link from a",
    "url_filename": "select record_id, stem || '.pdf' as by_path, 'Rutin ' || record_id || '.doc' as by_query from metadata",
    "url_digest_id": "select record_id, 'doc_' || substr(sha256(source_url || '&f=a.pdf'), 1, 12) || '.pdf' as file_id from metadata",
    "doc_title": "select record_id, coalesce(case when record_id % 2 = 1 then nullif(trim(title, ' '), '') end, 'Rutin ' || record_id || '.v2') as title from metadata",
    "sanitize_query": f"select id, {_SANITIZED.format('information_need')} as query from submissions",
    "query_variants": f"with a as (select id, query_text || case when id % 2 = 0 then '?' else '' end q from submissions where trim(query_text, ' ') <> ''), b as (select id, q, {_SANITIZED.format('q')} s from a) select id, q || '|' || q || '=' || case when s = '' or s = q then '' else '|' || s || '|' || s || '=' end as variants from b",
    "length_stats": "select count(*) as n, count(page_count) as n_known, round(avg(page_count), 6) as mean, round(quantile_cont(page_count, 0.5), 6) as median, max(page_count) as max, count(*) filter (page_count > 20) as over_20, count(*) filter (page_count > 50) as over_50, count(*) filter (page_count > 100) as over_100 from metadata",
    "percentiles": "select " + ", ".join(f"round(quantile_cont(page_count, {p}), 6) as p{round(p * 100)}" for p in analytics.PERCENTILES) + " from metadata",
    "value_counts": "select coalesce(nullif(trim(document_type, ' '), ''), '(missing)') as value, count(*) as n from metadata group by 1",
    "field_coverage": f"with a as (select unnest([{_ALL}]) field, unnest([{', '.join(FIELDS)}]) v from metadata) select field, count(*) filter (trim(v, ' ') <> '') as n_docs, round(100 * avg(coalesce(trim(v, ' ') <> '', false)::int), 6) as percent, count(distinct nullif(trim(v, ' '), '')) as n_values from a group by 1",
    "multivalue_counts": f"with a as (select unnest([{_VALUES}]) field, unnest([{', '.join(VALUE_FIELDS)}]) v from metadata), b as (select field, trim(unnest(string_split(v, ',')), ' ') as value from a where v is not null) select field, value, count(*) as n from b where value <> '' group by 1, 2",
    "unique_values": f"with a as (select unnest([{_VALUES}]) field, unnest([{', '.join(VALUE_FIELDS)}]) v from metadata) select field, trim(v, ' ') as value, count(*) as n from a where trim(v, ' ') <> '' group by 1, 2",
    "age_stats": f"with a as (select {_DATE} d from metadata), b as (select d, date '{AS_OF}' - d as days from a) select count(*) as n, count(d) as n_dated, count(*) filter (days > 730) as n_outdated, round(avg(days / 365.25::double), 6) as mean_years, round(quantile_cont(days / 365.25::double, 0.5), 6) as median_years, min(d) as first_date, max(d) as last_date from b",
    "approved_stats": "with a as (select substr(text, 1, 500) h from documents), b as (select coalesce(contains(h, 'Godkänt den:'), false) l, coalesce(regexp_extract(h, 'Godkänt den:\\s*([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '') d from a) select count(*) as n, count(*) filter (l) as n_label, count(*) filter (d <> '') as n_date, count(*) filter (l and d = '') as n_label_without_date from b",
    "approved_counts": "select regexp_extract(substr(text, 1, 500), 'Godkänt den:\\s*([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) as approved, count(*) as n from documents where regexp_matches(substr(text, 1, 500), 'Godkänt den:\\s*[0-9]{4}-[0-9]{2}-[0-9]{2}') group by 1",
    "metadata_export": "with c as (select regexp_extract(source_path, '([^/]*)\\.json$', 1) stem, min(json_extract_string(metadata_json, '$.title')) parsed_title, count(*) n_chunks from chunk_metadata group by 1) select stem, record_id, " + ", ".join(f"{sq(f"coalesce({f}, '')")} as {f}" for f in FIELDS) + ", page_count, parsed_title, n_chunks from metadata left join c using (stem)",
    "latest_metadata": "select stem, record_id from metadata qualify row_number() over (partition by stem order by downloaded_at desc nulls last, record_id desc) = 1",
    "age_histogram": f"with a as (select (date '{AS_OF}' - {_DATE}) / 365.25::double y from metadata), b as (select * from a where y >= 0), m as (select greatest(0, ceil(max(y) / 0.5)::int - 1) l from b), p as (select least(floor(y / 0.5)::int, l) k, count(*) n from b, m group by 1) select round(g.k * 0.5::double, 6) as low, coalesce(n, 0) as n from (select unnest(range(l + 1)) k from m) g left join p on p.k = g.k",
    "equal_width_hist": "with e as (select min(n_chars)::double lo, max(n_chars)::double hi from documents) select least(floor((n_chars - lo) / (hi - lo) * 20)::int + 1, 20) as bin, count(*) as n from documents, e where n_chars is not null group by 1",
    "zero_filled_counts": "select g.v as value, count(page_count) as n from (select unnest(range(31)) v) g left join metadata on page_count = g.v group by 1 union all select null, count(*) from metadata where page_count > 30",
    "windowed_events": "select event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') as day, count(*) as n, round(sum(value), 6) as total from events group by 1, 2",
}
