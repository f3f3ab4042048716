"""The SQL of lists of contents and of the sections cut by them, by windows over the lines and a recursion over the entries."""

from __future__ import annotations

from fathom.plans.chunk_sql import UNITS, chunks_sql
from fathom.plans.text_queries import LINES, MARKER, REFERENCE, heading_sql, level_sql, sq

_CONTENTS = "regexp_matches({}, '(?i)^(innehåll|innehållsförteckning|contents?|table of contents)$')"
_FEW = "len(string_split({}, ' ')) <= 24"
_BEFORE = "(partition by doc_id order by line_index rows between unbounded preceding and 1 preceding)"

#: entries (doc_id, n, heading, level, page, line_index, list_end): the lists of contents; of ``lines``.
ENTRIES = f"""lists as (select doc_id, min(line_index) list_start from lines where line_index < 160 and {_CONTENTS.format("normalized")} group by 1),
items as (select doc_id, line_index, normalized x, leading_spaces, regexp_matches(normalized, '{REFERENCE}') paged, try_cast(regexp_extract(normalized, '{REFERENCE}', 1) as int) page,
 case when regexp_matches(normalized, '{REFERENCE}') then regexp_replace(trim(regexp_replace(normalized, '{REFERENCE}', '')), '[.\\-·_… ]+$', '') else normalized end title
 from lines join lists using (doc_id) where line_index > list_start and not {_CONTENTS.format("normalized")} and not regexp_matches(normalized, '{MARKER}')),
kinds as (select *, paged and title <> '' as is_ref, not paged and x <> '' as is_part from items),
numbered as (select *, coalesce(sum(is_ref::int) over {_BEFORE}, 0) run, last_value(case when is_part then leading_spaces end ignore nulls) over {_BEFORE} inset from kinds),
blanks as (select *, sum((x = '')::int) over (partition by doc_id, run) - sum((x = '')::int) over (partition by doc_id, run order by line_index) later from numbered),
runs as (select doc_id, run, max(line_index) filter (is_ref) line_index, max(page) filter (is_ref) page, max(leading_spaces) filter (is_ref) spaces, max(inset) filter (is_ref) inset,
 {sq("string_agg(title, ' ' order by line_index) filter (is_ref or is_part)")} everything, {sq("string_agg(title, ' ' order by line_index) filter ((is_ref or is_part) and later = 0)")} near from blanks group by 1, 2 having count(*) filter (is_ref) > 0),
opens as (select doc_id, min(run) first_run, arg_min(line_index, run) first_line, arg_min(everything, run) first_heading from runs where {_FEW.format("everything")} group by 1),
stops as (select k.doc_id, min(line_index) stop from kinds k join opens using (doc_id) where line_index > first_line and (x = first_heading or (is_part and {heading_sql("x")})) group by 1),
kept as (select r.doc_id, r.line_index, r.page, case when run = first_run then everything else near end heading, coalesce(nullif(inset, 0), spaces) // 2 step, stop from runs r join opens using (doc_id) left join stops using (doc_id)
 where run >= first_run and {_FEW.format("case when run = first_run then everything else near end")} and (stop is null or line_index < stop)),
deep as (select *, {level_sql("heading")} depth, count(*) over (partition by doc_id) n_kept from kept),
steps as (select doc_id, step, row_number() over (partition by doc_id order by min(line_index)) step_level from deep where depth <= 1 group by 1, 2),
entries as (select d.doc_id, row_number() over (partition by d.doc_id order by d.line_index) n, heading, (case when depth > 1 then depth else step_level end)::int as level, page, d.line_index, coalesce(stop - 1, max(d.line_index) over (partition by d.doc_id)) list_end from deep d left join steps s on s.doc_id = d.doc_id and s.step = d.step where n_kept > 1)"""

_HERE = "(l.normalized = e.heading or (starts_with(l.normalized, e.heading || ' ') and regexp_matches(ltrim(substr(l.normalized, length(e.heading) + 1), ' '), '^\\p{Ll}')))"
_NAME = f"coalesce(nullif({sq('d.title')}, ''), 'Document')"
#: listed (doc_id, pos, heading, level, page, source, raw_text): the sections cut where the entries come again.
LISTED = f"""walk as (select doc_id, 0::bigint n, (list_end + 1)::bigint place, false hit from entries where n = 1
union all select w.doc_id, e.n, coalesce((select min(l.line_index) from lines l where l.doc_id = w.doc_id and l.line_index >= w.place and {_HERE}) + 1, w.place)::bigint, exists (select 1 from lines l where l.doc_id = w.doc_id and l.line_index >= w.place and {_HERE}) from walk w join entries e on e.doc_id = w.doc_id and e.n = w.n + 1),
found as (select w.doc_id, w.n, w.place - 1 place, e.heading, e.level, e.page, list_end, count(*) over (partition by w.doc_id) n_found, lead(w.place - 1) over (partition by w.doc_id order by w.n) upto, row_number() over (partition by w.doc_id order by w.n) nth from walk w join entries e on e.doc_id = w.doc_id and e.n = w.n where hit),
spans as (select doc_id, nth as pos, heading, level, page, 'toc' source, place + 1 low, coalesce(upto, 1000000000000) high from found where n_found > 1 union all select f.doc_id, 0, {_NAME}, 1, null, 'toc_preface', list_end + 1, place from found f join documents d on d.doc_id = f.doc_id where nth = 1 and n_found > 1),
listed as (select * from (select s.doc_id, pos, heading, level, page, source, coalesce(trim(string_agg(raw, chr(10) order by line_index) filter (normalized <> ''), ' '), '') raw_text from spans s left join lines l on l.doc_id = s.doc_id and l.line_index >= low and l.line_index < high group by all) where source = 'toc' or raw_text <> '')"""

#: headed: the sections from each heading to the next.
HEADED = f"""hd as (select *, {heading_sql("normalized")} as head from lines where normalized <> ''),
hr as (select *, sum(head::int) over (partition by doc_id order by line_index) as run from hd),
hg as (select doc_id, run, max(normalized) filter (head) as h, string_agg(normalized, chr(10) order by line_index) filter (not head) as raw_text from hr group by 1, 2 having count(*) filter (not head) > 0),
headed as (select g.doc_id, g.run as pos, coalesce(h, {_NAME}) heading, {level_sql(f"coalesce(h, {_NAME})")} as level, null::int page, 'heuristic' source, raw_text from hg g join documents d on d.doc_id = g.doc_id)"""


BASE = f"{LINES}, {ENTRIES}, {LISTED}, {HEADED}"


def chosen_sql(strategy: str, name: str = "chosen") -> str:
    """A CTE (doc_id, pos, heading, level, page, source, raw_text): the sections by a strategy of ``document_sections``."""
    last = f"select d.doc_id, 0 pos, {_NAME} heading, 1 as level, null::int page, '{'fallback' if strategy == 'cascade' else 'whole_document'}' source, trim(text, ' ') raw_text from documents d where {sq('text')} <> ''"
    parts = {"cascade": ["listed", "headed"], "toc_or_whole": ["listed"], "whole": []}[strategy]
    rungs = " union all ".join([f"select {n} rung, * from {p}" for n, p in enumerate(parts)] + [f"select 9 rung, * from ({last})"])
    return f"{name} as (select * from (select *, min(rung) over (partition by doc_id) least from ({rungs})) where rung = least)"


def sections_sql(strategy: str) -> str:
    """CTEs that end in ``cut`` (doc_id, index, heading, level, page, source, raw_text, text, path_text)."""
    return f"""{BASE}, {chosen_sql(strategy)},
rows as (select doc_id, row_number() over (partition by doc_id order by pos) n, heading, level::int as level, page, source, raw_text, {sq("raw_text")} as text from chosen),
paths as (select doc_id, n, [heading] p from rows where n = 1 union all select r.doc_id, r.n, list_append(q.p[1:greatest(1, r.level) - 1], r.heading) from paths q join rows r on r.doc_id = q.doc_id and r.n = q.n + 1),
cut as (select doc_id, (n - 1)::int as index, heading, level, page, source, raw_text, text, array_to_string(p, ' > ') as path_text from rows join paths using (doc_id, n))"""


def strategy_units_sql(strategies: list[str], size: int, overlap: int) -> str:
    """CTEs that end in ``units``, as in ``chunk_sql``: the sections of every strategy (part), chunked alike."""
    each = " union all ".join(f"select {n} part, doc_id, row_number() over (partition by doc_id order by pos) - 1 section_index, heading, {sq('raw_text')} b from chosen_{n}" for n in range(len(strategies)))
    return f"""{BASE}, {", ".join(chosen_sql(x, f"chosen_{n}") for n, x in enumerate(strategies))},
titles as (select doc_id source_path, {sq("title")} title from documents),
sections as materialized (select row_number() over () id, part, doc_id source_path, section_index, coalesce(nullif(trim(heading, ' '), ''), title, '') head, title, b from ({each}) e join titles on e.doc_id = titles.source_path),
{chunks_sql("select id, b x from sections where trim(b, ' ') <> ''", f"select 0 part, {size} size, {overlap} overlap")},
{UNITS.format(parts=f"select unnest(range({len(strategies)})) part", heads="sections", bodies="select s.*, k, chunk from chunks c join sections s on s.id = c.id")}"""


TOC = f"with recursive {LINES}, {ENTRIES}"
ORACLE = {
    "toc_entries": f"{TOC} select doc_id, heading, level, page, line_index as source_index from entries",
    "toc_presence": f"{TOC} select doc_id, count(heading) as n_entries from documents left join entries using (doc_id) group by 1",
    "toc_coverage": f"{TOC} select lang, count(*) as n, count(distinct e.doc_id) as n_toc from documents d left join (select distinct doc_id from entries) e on e.doc_id = d.doc_id group by 1",
    "docs_without_toc": f"{TOC} select doc_id, coalesce(nullif(trim(title, ' '), ''), nullif(trim(source, ' '), '')) as title, n_chars from documents where doc_id not in (select doc_id from entries)",
    "sections_toc": f"with recursive {sections_sql('toc_or_whole')} select * from cut where source like 'toc%'",
    "sections_cascade": f"with recursive {sections_sql('cascade')} select * from cut",
}
