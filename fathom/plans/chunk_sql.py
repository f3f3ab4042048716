"""The SQL of chunks, and of searches over chunks cut by several settings."""

from __future__ import annotations

from fathom.plans.text_queries import TOKEN, WS, doc_id_sql, sq

_WORDS = f"string_split(trim(regexp_replace(x, '{WS}', ' ', 'g'), ' '), ' ')"


def chunks_sql(source: str, settings: str) -> str:
    """CTEs that end in ``chunks`` (part, id, k, chunk): the texts of ``source`` (id, x) cut by every one of ``settings`` (part, size, overlap), greedily by words.

    A chunk is the words s to e. It begins with the last words of the one before that
    make up the overlap, and the word that was too much for that one (e0).
    """
    ends = """select r.part, r.id, r.k, r.s, max(a.i) e, max(a.p) pe from {} r join words a on a.id = r.id and a.i >= r.s and (a.i <= r.e0 or a.p - r.before <= r.size) group by all"""
    return f"""words as materialized (select id, i, word, sum(length(word) + 1) over (partition by id order by i)::bigint p from (select id, unnest({_WORDS}) word, unnest(range(len({_WORDS}))) i from ({source}) where regexp_replace(x, '{WS}', '', 'g') <> '')),
lasts as (select id, max(i) n from words group by 1),
cut as (select part, size, overlap, id, 0::bigint k, 0::bigint s, 0::bigint e0, 0::bigint before from lasts, ({settings})
union all select z.part, g.size, g.overlap, z.id, z.k + 1, b.i, z.e + 1, b.p - length(b.word) - 1 from ({ends.format("cut")}) z join ({settings}) g using (part) join lasts using (id)
join words b on b.id = z.id and b.i = case when g.overlap <= 0 then z.e + 1 else coalesce((select max(c.i) from words c where c.id = z.id and c.i between z.s and z.e and z.pe - c.p + length(c.word) + 1 >= g.overlap), z.s) end where z.e < lasts.n),
chunks as (select part, id, k, string_agg(word, ' ' order by i) chunk from ({ends.format("cut")}) z join words using (id) where i between s and e group by 1, 2, 3)"""


#: The stored sections and the titles of their documents.
SECTIONS = f"""titles as (select source_path, {sq("min(json_extract_string(metadata_json, '$.title'))")} title from chunk_metadata group by 1),
sections as (select row_number() over () id, s.source_path, section_index, coalesce(nullif(trim(h, ' '), ''), title, '') head, title, b from (select source_path, section_index, min(section_heading) h, min(section_text) b from chunk_metadata where chunk_type = 'section_title' group by 1, 2) s left join titles using (source_path))"""


UNITS = """units as (select part, source_path, -1 section_index, 0 unit, 0 chunk_index, 'title' chunk_type, title as text, title preview_text from titles, ({parts}) where coalesce(title, '') <> ''
union all select part, source_path, section_index, 1, 0, 'section_title', case when coalesce(title, '') <> '' and title <> head then title || chr(10) || chr(10) || head else head end, head from {heads} where head <> ''
union all select part, source_path, section_index, 2, k::int, 'section', case when k = 0 and head <> '' then head || chr(10) || chr(10) || chunk else chunk end, chunk from ({bodies}))"""


def units_sql(settings: str, whole: str = "") -> str:
    """CTEs that end in ``units`` (part, source_path, section_index, unit, chunk_index, chunk_type, text, preview_text): titles, headings and chunks; of the parts ``whole`` (part) each section is one chunk."""
    parts = f"select part from ({settings})" + (f" union all {whole}" if whole else "")
    one = f" union all select part, s.id, 0, b from sections s, ({whole}) where trim(b, ' ') <> ''" if whole else ""
    return f"""{SECTIONS}, {chunks_sql("select id, b x from sections where trim(b, ' ') <> ''", settings)},
bodies as (select part, id, k, chunk from chunks{one}),
{UNITS.format(parts=parts, heads=f"(select * from sections, ({parts}))", bodies="select part, s.*, k, chunk from bodies join sections s using (id)")}"""


def corpus_sql(size: int, overlap: int, columns: str) -> str:
    return f"with recursive {units_sql(f'select 0 part, {size} size, {overlap} overlap')} select {columns} from units"


def runs_sql(views: str, asked: str, k: int, docs: str = "") -> str:
    """CTEs that end in ``run`` (view, query_id, doc_id, score) and ``sizes`` (view, n_chunks): bm25 over the units of each of ``views`` (view, part, titles), the best ``k`` of them, by document."""
    docs = docs or doc_id_sql("coalesce(nullif(trim(title, ' '), ''), list_filter(string_split(source_path, '/'), lambda x: x <> '')[-1])")
    key = "concat_ws('#', source_path, section_index, unit, chunk_index)"
    return f"""viewed as materialized (select view, {key} key, source_path, text from units join ({views}) using (part) where titles or unit > 0),
sizes as (select view, count(*) n_chunks from viewed group by 1),
ut as (select view, key, unnest({TOKEN.format("text")}) term from viewed),
up as materialized (select view, key, term, count(*) tf from ut group by all),
ul as (select view, key, sum(tf) dl from up group by 1, 2),
us as (select view, count(*) n, avg(dl) avgdl from ul group by 1),
uf as (select view, term, count(*) df from up group by 1, 2),
asks as (select query_id, unnest({TOKEN.format("q")}) term, unnest(range(len({TOKEN.format("q")}))) pos from ({asked})),
qt as (select query_id, term, count(*) qtf, min(pos) qpos from asks group by all),
hs as (select view, query_id, key, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) score, min(qpos) qpos from qt join up using (term) join uf using (view, term) join ul using (view, key) join us using (view) group by all),
top as (select view, query_id, key, score from hs qualify row_number() over (partition by view, query_id order by score desc, qpos, key) <= {k}),
named as (select source_path, {docs} doc_id from titles),
run as (select view, query_id, doc_id, max(score) score from top join viewed using (view, key) join named using (source_path) where doc_id <> '' group by 1, 2, 3)"""
