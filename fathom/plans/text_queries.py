"""Queries of the text, line, section and chunk operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import text as t
from fathom.operators import chunking, index, lines, sections
from fathom.tables import load, spread

WS = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{1c}-\x{1f}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def sq(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'))"


MARKER = r"(?i)^(page|sidan) [0-9]+( (of|av) [0-9]+)?$"
LABELLED = t.LABELLED.replace("(?iu)", "(?i)")
NUMBERED = r"(?i)^([0-9]+(\.[0-9]+)*|[IVXLCM]+)[).:\-]?\s+\S"
REFERENCE = r"\s*[._·\-…]{2,}\s*([0-9]+)$"


def heading_sql(x: str) -> str:
    letters, upper = f"length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g'))", f"length(regexp_replace({x}, '[^\\p{{Lu}}]', '', 'g'))"
    n = f"len(string_split({x}, ' '))"
    titled = f"len(list_filter(string_split({x}, ' '), lambda w: regexp_matches(w, '^\\p{{Lu}}.*\\p{{Ll}}')))"
    return (
        f"(length({x}) between 3 and 140 and not regexp_matches({x}, '{MARKER}') and not regexp_matches({x}, '{LABELLED}') and not regexp_matches({x}, '[.;?!]$') and {letters} > 0 and {n} <= 18 and "
        f"(regexp_matches({x}, '{NUMBERED}') or {upper}::double / {letters} >= 0.72 or ({n} between 2 and 10 and {titled} >= greatest(2, {n} - 1))))"
    )


def level_sql(x: str) -> str:
    return f"(case when regexp_extract({x}, '^([0-9]+(\\.[0-9]+)*)', 1) = '' then 1 else len(string_split(regexp_extract({x}, '^([0-9]+(\\.[0-9]+)*)', 1), '.')) end)"


LINES = f"""l0 as (select doc_id, string_split(regexp_replace(text, '\\r\\n|\\r|\\f', chr(10), 'g'), chr(10)) x from documents where text is not null),
l1 as (select doc_id, unnest(x) raw, unnest(range(len(x)))::int line_index from l0),
lines as (select doc_id, line_index, raw, {sq("raw")} normalized, length(raw) - length(ltrim(raw, ' ')) leading_spaces from l1)"""
TOKEN = "list_transform(regexp_extract_all({}, '[0-9A-Za-zÅÄÖåäö]+'), lambda w: lower(w))"


def doc_id_sql(x: str) -> str:
    dashes = f"trim(translate(coalesce({x}, ''), '{t.DASHES}', '{'-' * len(t.DASHES)}'))"
    return sq(f"lower(regexp_replace({dashes}, '(?i)(.)\\.(pdf|docx?|rtf|txt)$', '\\1'))")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(load(spark, d, "documents"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.text_lines(_docs(spark, d), "doc_id", "text")


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", t.squeeze(F.col("text")).alias("clean"))


def text_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("doc_id", "line_index", "normalized", "leading_spaces")


def page_markers(spark: SparkSession, d: str) -> DataFrame:
    marks = load(spark, d, "chunk_metadata").select("chunk_id", F.explode(F.split(t.unix_lines(F.col("text")), "\n", -1)).alias("line"))
    return marks.groupBy("chunk_id").agg(F.count_if(t.is_page_marker(F.col("line"))).alias("n"), F.count(F.lit(1)).alias("n_lines"))


def heading_candidates(spark: SparkSession, d: str) -> DataFrame:
    k = lines.line_kinds(_lines(spark, d), "doc_id")
    return k.where("is_heading").select("doc_id", "line_index", "normalized")


def heading_level(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("section_heading")
    return load(spark, d, "chunk_metadata").where(x.isNotNull()).groupBy(x.alias("heading")).agg(F.max(t.heading_level(x)).cast("long").alias("level"), F.count(F.lit(1)).alias("n"))


def toc_page_refs(spark: SparkSession, d: str) -> DataFrame:
    return lines.toc_references(_lines(spark, d), "doc_id")


def approved_date(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", t.approved_date(F.col("text")).alias("approved"))


def tokenize(spark: SparkSession, d: str) -> DataFrame:
    x = t.tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(x).cast("long").alias("n_tokens"), F.array_join(x, " ").alias("tokens")).where("n_tokens >= 0")


def tokenize_unicode(spark: SparkSession, d: str) -> DataFrame:
    x = t.unicode_tokens(F.col("text"))
    return _docs(spark, d).where("text is not null").select("doc_id", F.size(x).cast("long").alias("n_tokens"), F.array_join(x, " ").alias("tokens"))


def slugify(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("title")
    return load(spark, d, "metadata").select("record_id", t.slug(x).alias("slug"), t.slug(x, "_", "unnamed").alias("file_slug"))


def normalize_doc_id(spark: SparkSession, d: str) -> DataFrame:
    m = load(spark, d, "metadata")
    return m.select("record_id", t.normal_doc_id(F.concat(F.col("title"), F.lit(".pdf"))).alias("by_title"), t.plain_doc_id(F.concat("stem", F.lit(".DOCX"))).alias("by_stem"))


def metadata_text(spark: SparkSession, d: str) -> DataFrame:
    m = F.from_json("metadata_json", "map<string,string>")
    return load(spark, d, "chunk_metadata").select("chunk_id", index.metadata_text(m).alias("metadata_text"))


def sections_heuristic(spark: SparkSession, d: str) -> DataFrame:
    s = sections.heuristic_sections(_docs(spark, d), "doc_id", "text", "title")
    return s.select("doc_id", "section_index", "heading", F.col("level").cast("long").alias("level"), F.col("text").alias("body"))


def section_paths(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "chunk_metadata").where("chunk_type = 'section_title'")
    one = c.groupBy("source_path", "section_index").agg(F.min("section_level").alias("level"), F.min("section_heading").alias("heading"))
    return sections.section_paths(one, "source_path")


def sections_stored(spark: SparkSession, d: str) -> DataFrame:
    """Each heading's chunk as a document of one stored section."""
    c = load(spark, d, "chunk_metadata").where("chunk_type = 'section_title'").withColumn("title", F.get_json_object("metadata_json", "$.title"))
    s = F.struct(
        F.col("section_index").alias("index"), F.col("section_heading").alias("heading"), F.lit(None).cast("string").alias("title"), F.col("section_level").alias("level"), F.lit(0).alias("page"), F.lit(" ").alias("source"),
        F.lit(None).cast("string").alias("raw_text"), F.col("section_text").alias("text"), F.from_json("section_path_json", "array<string>").alias("path"), F.col("section_path_text").alias("path_text"),
    )
    got = sections.parsed_sections(c.withColumn("sections", F.array(s)), "chunk_id", "sections", "text", "title")
    return got.select("chunk_id", "heading", F.col("level").cast("long").alias("level"), "page", "source", F.length("text").cast("long").alias("n_chars"), F.array_join("path", "|").alias("path"), "path_text")


def sections_whole(spark: SparkSession, d: str) -> DataFrame:
    return sections.whole_sections(_docs(spark, d), "doc_id", "text", "title").select("doc_id", "heading", F.length("text").cast("long").alias("n_chars"))


def toc_entries(spark: SparkSession, d: str) -> DataFrame:
    return sections.toc_entries(_docs(spark, d), "doc_id", "text")


def toc_presence(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    n = sections.toc_entries(docs, "doc_id", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_entries"))
    return docs.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("n_entries", F.lit(0)).alias("n_entries"))


def sections_toc(spark: SparkSession, d: str) -> DataFrame:
    s = sections.document_sections(_docs(spark, d), "doc_id", "text", "title", "toc_or_whole")
    return s.where("source like 'toc%'").drop("path")


def sections_cascade(spark: SparkSession, d: str) -> DataFrame:
    return sections.document_sections(_docs(spark, d), "doc_id", "text", "title").drop("path")


def doc_headings(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "chunk_metadata").where("section_index is not null")
    return sections.document_headings(c, "source_path", "section_index", "section_heading")


def enrich_headings(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "chunk_metadata")
    heads = sections.document_headings(c.where("section_index is not null"), "source_path", "section_index", "section_heading")
    return c.where("chunk_type = 'title'").select("chunk_id", "source_path").join(heads, "source_path", "left")


def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_text(_docs(spark, d), "doc_id", "text", 250, 50)


def _stored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = load(spark, d, "chunk_metadata")
    title = F.get_json_object("metadata_json", "$.title")
    docs = c.groupBy("source_path").agg(F.min(title).alias("title"))
    s = c.where("chunk_type = 'section_title'").groupBy("source_path", "section_index").agg(F.min("section_heading").alias("heading"), F.min("section_text").alias("text"))
    return docs, s


def corpus_sections(spark: SparkSession, d: str) -> DataFrame:
    docs, s = _stored(spark, d)
    return chunking.corpus(docs, s, "source_path", size=None).select("source_path", "section_index", "chunk_type", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


def corpus_bm25(spark: SparkSession, d: str) -> DataFrame:
    docs, s = _stored(spark, d)
    return chunking.corpus(docs, s, "source_path", 500, 50)


def corpus_fts(spark: SparkSession, d: str, *others: str) -> DataFrame:
    """chunk_id and the fields of the weighted index; ``others`` are columns of the chunks that come along."""
    c = load(spark, d, "chunk_metadata")
    m = F.from_json("metadata_json", "map<string,string>")
    return c.select("chunk_id", F.when(F.col("chunk_type") == "section", F.lit("")).otherwise(F.col("text")).alias("title_text"), F.coalesce(F.when(F.col("chunk_type") != "title", F.col("text")), F.lit("")).alias("body_text"), index.metadata_text(m).alias("metadata_text"), *others)


def corpus_vector(spark: SparkSession, d: str) -> DataFrame:
    docs, s = _stored(spark, d)
    c = chunking.corpus(docs, s, "source_path", 500, 25)
    return c.select("source_path", "section_index", "unit", "chunk_index", F.concat(F.lit("passage: "), F.trim("text")).alias("text"))


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "chunk_metadata").select("source_path", "chunk_id", "text").withColumnRenamed("chunk_id", "stored_id")
    return chunking.with_chunk_ids(c, ["source_path", "stored_id"]).select("source_path", "stored_id", "chunk_id")


QUERIES = {
    f.__name__: f
    for f in (clean_text, text_lines, page_markers, heading_candidates, heading_level, toc_page_refs, approved_date, tokenize, tokenize_unicode, slugify, normalize_doc_id, metadata_text, sections_heuristic, section_paths, sections_stored, sections_whole, toc_entries, toc_presence, sections_toc, sections_cascade, doc_headings, enrich_headings, chunk_text, corpus_sections, corpus_bm25, corpus_fts, corpus_vector, chunk_ids)
}

HEADS = "heads as (select source_path, string_agg(h, ' | ' order by i, h) headings from (select source_path, section_heading h, min(section_index) i from chunk_metadata where section_index is not null and trim(coalesce(section_heading, '')) <> '' group by all) group by 1)"
ORACLE = {
    "clean_text": f"select doc_id, {sq('text')} as clean from documents",
    "text_lines": f"with {LINES} select doc_id, line_index, normalized, leading_spaces from lines",
    "page_markers": f"with a as (select chunk_id, unnest(string_split(regexp_replace(text, '\\r\\n|\\r|\\f', chr(10), 'g'), chr(10))) as line from chunk_metadata where text is not null) select chunk_id, count(*) filter (regexp_matches({sq('line')}, '{MARKER}')) as n, count(*) as n_lines from a group by 1",
    "heading_candidates": f"with {LINES} select doc_id, line_index, normalized from lines where {heading_sql('normalized')}",
    "heading_level": f"select section_heading as heading, max({level_sql('section_heading')})::bigint as level, count(*) as n from chunk_metadata where section_heading is not null group by 1",
    "toc_page_refs": f"with {LINES} select doc_id, line_index, regexp_replace(trim(regexp_replace(normalized, '{REFERENCE}', '')), '[.\\-·_… ]+$', '') as title, try_cast(regexp_extract(normalized, '{REFERENCE}', 1) as int) as page from lines where regexp_matches(normalized, '{REFERENCE}')",
    "approved_date": "select doc_id, nullif(regexp_extract(substr(text, 1, 500), 'Godkänt den:\\s*([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '') as approved from documents",
    "tokenize": f"select doc_id, len({TOKEN.format('text')})::bigint as n_tokens, array_to_string({TOKEN.format('text')}, ' ') as tokens from documents where text is not null",
    "tokenize_unicode": "with a as (select doc_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}\\p{Co}]+'), lambda w: lower(w)) x from documents where text is not null) select doc_id, len(x)::bigint as n_tokens, array_to_string(x, ' ') as tokens from a",
    "slugify": "with a as (select record_id, trim(regexp_replace(lower(trim(title)), '[^a-z0-9]+', '-', 'g'), '-') s, trim(regexp_replace(lower(trim(title)), '[^a-z0-9]+', '_', 'g'), '_') f from metadata) select record_id, case when coalesce(s, '') = '' then 'run' else s end as slug, case when coalesce(f, '') = '' then 'unnamed' else f end as file_slug from a",
    "normalize_doc_id": "select record_id, " + doc_id_sql("title || '.pdf'") + " as by_title, " + doc_id_sql("stem || '.DOCX'") + " as by_stem from metadata",
    "metadata_text": "with a as (select chunk_id, metadata_json j, list_sort(list_filter(json_keys(metadata_json), lambda k: k not in ('section_path', 'section_text', 'source_url', 'downloaded_at'))) ks from chunk_metadata) select chunk_id, array_to_string(list_filter(list_transform(ks, lambda k: trim(json_extract_string(j, '$.' || k))), lambda v: v is not null and v <> ''), ' ') as metadata_text from a",
    "sections_heuristic": f"""with {LINES},
h as (select *, {heading_sql("normalized")} as head from lines where normalized <> ''),
r as (select *, sum(head::int) over (partition by doc_id order by line_index) as run from h),
g as (select doc_id, run, max(normalized) filter (head) as found, string_agg(raw, chr(10) order by line_index) filter (not head) as body from r group by 1, 2 having count(*) filter (not head) > 0),
n as (select g.doc_id, row_number() over (partition by g.doc_id order by run) - 1 as section_index, coalesce(found, nullif({sq("d.title")}, ''), 'Document') as heading, {sq("body")} as body from g left join documents d on d.doc_id = g.doc_id)
select doc_id, section_index::int as section_index, heading, {level_sql("heading")}::bigint as level, body from n""",
    "sections_stored": f"with a as (select chunk_id, coalesce(nullif({sq('section_heading')}, ''), nullif({sq("json_extract_string(metadata_json, '$.title')")}, ''), 'Document') as heading, section_level l, coalesce(trim(section_text, ' '), '') x, list_filter(list_transform(coalesce(from_json(section_path_json, '[\"VARCHAR\"]'), []), lambda v: {sq('v')}), lambda v: v <> '') p, coalesce(trim(section_path_text, ' '), '') pt from chunk_metadata where chunk_type = 'section_title') select chunk_id, heading, (case when l > 0 then l else {level_sql('heading')} end)::bigint as level, null::int as page, 'stored' as source, length(x) as n_chars, case when len(p) = 0 then heading else array_to_string(p, '|') end as path, case when len(p) = 0 then heading else pt end as path_text from a",
    "section_paths": """with recursive s as (select source_path, section_index, coalesce(min(section_level), 1) l, coalesce(min(section_heading), '') h, row_number() over (partition by source_path order by section_index) n from chunk_metadata where chunk_type = 'section_title' group by 1, 2),
r as (select source_path, section_index, n, [h] p from s where n = 1 union all select s.source_path, s.section_index, s.n, list_append(r.p[1:greatest(1, s.l) - 1], s.h) from r join s on s.source_path = r.source_path and s.n = r.n + 1)
select source_path, section_index, len(p)::int as depth, array_to_string(p, ' > ') as path_text from r""",
    "sections_whole": f"select doc_id, coalesce(nullif({sq('title')}, ''), 'Document') as heading, length({sq('text')}) as n_chars from documents where {sq('text')} <> ''",
    "doc_headings": f"with {HEADS} select * from heads",
    "enrich_headings": f"with {HEADS} select c.chunk_id, c.source_path, headings from chunk_metadata c left join heads using (source_path) where chunk_type = 'title'",
    "corpus_sections": """with d as (select source_path, min(json_extract_string(metadata_json, '$.title')) title from chunk_metadata group by 1),
s as (select source_path, section_index, min(section_heading) h, min(section_text) b from chunk_metadata where chunk_type = 'section_title' group by 1, 2),
f as (select s.*, title, coalesce(nullif(trim(h), ''), title, '') head from s left join d using (source_path)),
u as (select source_path, -1 section_index, 'title' chunk_type, title x from d where coalesce(title, '') <> ''
union all select source_path, section_index, 'section_title', case when coalesce(title, '') <> '' and title <> head then title || chr(10) || chr(10) || head else head end from f where head <> ''
union all select source_path, section_index, 'section', case when head <> '' then head || chr(10) || chr(10) || b else b end from f where trim(b, ' ') <> '')
select source_path, section_index, chunk_type, length(x) as n_chars, md5(x) as digest from u""",
    "corpus_fts": "with a as (select chunk_id, chunk_type, text, metadata_json j, list_sort(list_filter(json_keys(metadata_json), lambda k: k not in ('section_path', 'section_text', 'source_url', 'downloaded_at'))) ks from chunk_metadata) select chunk_id, case when chunk_type = 'section' then '' else text end as title_text, coalesce(case when chunk_type <> 'title' then text end, '') as body_text, array_to_string(list_filter(list_transform(ks, lambda k: trim(json_extract_string(j, '$.' || k))), lambda v: v is not null and v <> ''), ' ') as metadata_text from a",
    "chunk_ids": "select source_path, chunk_id as stored_id, row_number() over (order by source_path, chunk_id) - 1 as chunk_id from chunk_metadata where regexp_matches(text, '[0-9A-Za-zÅÄÖåäö]')",
}
