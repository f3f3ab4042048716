"""Queries of the evaluation and judgement operators, and their SQL.

The runs measured here are the result lists shown in the forms, in their order;
the qrels are the ratings given to them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import text as t
from fathom.operators import batch, chunking, evaluation, fusion, judgements, schema_drift, sections
from fathom.plans.chunk_sql import chunks_sql, corpus_sql, runs_sql, units_sql
from fathom.plans.section_sql import strategy_units_sql
from fathom.plans.text_queries import doc_id_sql, sq
from fathom.session import checkpointed
from fathom.tables import load, spread

SHEET_TYPES = ["tax_keyword", "comment", "process"]
PREFERRED = ["view", "click", "purchase"]


def _forms(spark: SparkSession, d: str) -> DataFrame:
    return judgements.parsed(load(spark, d, "submissions"))


def _qrels(spark: SparkSession, d: str) -> DataFrame:
    """query_id (the form), doc_id, relevance, query_type (four of them, by the form's id)."""
    q = judgements.to_qrels(_forms(spark, d), include_non_relevant=True)
    return q.groupBy(F.col("id").alias("query_id"), "doc_id").agg(F.max("relevance").alias("relevance")).withColumn("query_type", F.concat(F.lit("type_"), F.col("query_id") % 4))


def _run(spark: SparkSession, d: str) -> DataFrame:
    """query_id, doc_id, score of the lists shown, and a method for each place in the list."""
    r = judgements.results(_forms(spark, d)).select(F.col("id").alias("query_id"), judgements.result_doc(F.col("r")).alias("doc_id"), (1.0 / F.col("result_index")).alias("score"))
    return evaluation.run_table(r)


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.per_query(_run(spark, d), _qrels(spark, d))


def submissions_scan(spark: SparkSession, d: str) -> DataFrame:
    return _forms(spark, d).select("id", F.coalesce(F.size("p.results"), F.lit(0)).cast("long").alias("n_results"))


def submissions_to_qrels(spark: SparkSession, d: str) -> DataFrame:
    return judgements.to_qrels(_forms(spark, d), include_non_relevant=True)


def submission_audit(spark: SparkSession, d: str) -> DataFrame:
    return judgements.audit(_forms(spark, d))


def exclude_submissions(spark: SparkSession, d: str) -> DataFrame:
    forms = load(spark, d, "submissions")
    tests = forms.where(F.lower(F.trim("information_need")) == "test")
    return judgements.excluding(forms, tests).select("id", "query_text")


def relevant_chunks(spark: SparkSession, d: str) -> DataFrame:
    return judgements.relevant_chunks(_forms(spark, d))


def sheet_unpivot(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.unpivot_sheet(load(spark, d, "metadata"), "title", SHEET_TYPES)


def load_qrels(spark: SparkSession, d: str) -> DataFrame:
    q = _qrels(spark, d)
    return q.groupBy("query_type").agg(F.count_distinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("n_rows"), F.min("query_id").alias("first_seen"))


def _clean(spark: SparkSession, d: str) -> DataFrame:
    r = judgements.results(_forms(spark, d))
    rows = r.select("id", F.col("query_id").alias("query"), "information_need", judgements.result_doc(F.col("r")).alias("doc_id"), F.lit(1).alias("relevance"))
    return evaluation.clean_qrels(rows)


def clean_qrels(spark: SparkSession, d: str) -> DataFrame:
    return _clean(spark, d)


def qrels_variants(spark: SparkSession, d: str) -> DataFrame:
    """The texts of both variants with ids by first appearance."""
    f = _forms(spark, d)
    a = evaluation.numbered_queries(f.where("trim(query_text) <> ''"), "query_text", "id", "query_").select(F.col("query_text").alias("text"), "query_id")
    b = evaluation.numbered_queries(f.where("trim(information_need) <> ''"), "information_need", "id", "info_need_").select(F.col("information_need").alias("text"), "query_id")
    return a.unionByName(b)


def run_table(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def rr_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("query_id", F.round("rr", 6).alias("rr"))


def ndcg_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("query_id", F.round("ndcg", 6).alias("ndcg"))


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("query_id", F.round("recall", 6).alias("recall"))


def average_rank(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.summary(_scores(spark, d), []).select("n_queries", "average_rank")


def _by_type(spark: SparkSession, d: str) -> DataFrame:
    types = _qrels(spark, d).select("query_id", "query_type").distinct()
    return evaluation.summary(_scores(spark, d).join(types, "query_id"), ["query_type"])


def macro_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.macro(_by_type(spark, d))


def ndcg_per_query(spark: SparkSession, d: str) -> DataFrame:
    q = load(spark, d, "submissions").select(F.col("id").alias("query_id"), "information_need")
    s = _scores(spark, d).join(q, "query_id")
    need = F.coalesce("information_need", F.lit(""))
    return s.select("query_id", F.round("ndcg", 6).alias("ndcg"), t.word_count(need).cast("long").alias("words"), F.length(need).cast("long").alias("chars"))


def quantile_bins(spark: SparkSession, d: str) -> DataFrame:
    s = ndcg_per_query(spark, d)
    return evaluation.quantile_bins(s, "words", "ndcg")


SIZES, OVERLAPS, SWEPT_K = [250, 500, 800], [0, 25, 50], 20


def _units(docs: DataFrame, s: DataFrame, key: str, doc: DataFrame, size: int | None, overlap: int, part: int) -> DataFrame:
    """The chunks of a setting as texts of ``batch.lists``; ``doc`` has key and doc."""
    c = chunking.corpus(docs, s, key, size, overlap)
    unit = F.concat_ws("#", key, "section_index", "unit", "chunk_index")
    return c.join(doc, key, "left").select(F.lit(part).alias("part"), unit.alias("key"), "doc", (F.col("unit") == 0).alias("title"), "text")


def _stored_units(spark: SparkSession, d: str, settings: list[tuple[int | None, int]]) -> DataFrame:
    from fathom.plans.text_queries import _stored

    docs, s = _stored(spark, d)
    doc = docs.select("source_path", t.plain_doc_id(fusion.result_title(F.create_map(F.lit("title"), F.col("title")), F.col("source_path"))).alias("doc"))
    return reduce(DataFrame.unionByName, [_units(docs, s, "source_path", doc, size, overlap, n) for n, (size, overlap) in enumerate(settings)])


TEXTS = {"query": "query_text", "information_need": "information_need"}


def _evaluated(spark: SparkSession, d: str, units: DataFrame, views: list[tuple[int, int, bool]], asked: list[str], k: int, k_rr: int, k_recall: int) -> tuple[DataFrame, dict[int, int]]:
    """view, query_input and the metrics of its run, over the forms that are asked by each of their texts; and the number of chunks of each view."""
    key = lambda n: F.col("id") * len(asked) + n
    texts = F.explode(F.array(*[F.struct(key(n).alias("query_id"), F.col(TEXTS[x]).alias("query")) for n, x in enumerate(asked)]))
    queries = load(spark, d, "submissions").where("id % 20 = 0").select(texts.alias("x")).select("x.*")
    hits, size = batch.lists(units, queries, k, views)
    run = evaluation.run_table(hits.withColumn("query_id", F.struct("view", "query_id")), doc="doc").select(F.col("query_id.view").alias("view"), F.col("query_id.query_id").alias("query_id"), "doc_id", "score")
    gold = _qrels(spark, d).where("query_id % 20 = 0").withColumnRenamed("query_id", "id")
    gold = gold.withColumn("query_id", F.explode(F.array(*map(key, range(len(asked))))))
    every = spark.createDataFrame([(v,) for v, _, _ in views], "view int")
    scores = evaluation.per_query(run, gold, k=k_rr, k_recall=k_recall, by=["view"], settings=every)
    told = F.element_at(F.array(*map(F.lit, asked)), (F.col("query_id") % len(asked) + 1).cast("int"))
    return evaluation.summary(scores.withColumn("query_input", told), ["view", "query_input"]), size


def sweep_grid(spark: SparkSession, d: str) -> DataFrame:
    """The metrics of bm25 over the stored sections chunked by each setting of size, overlap and titles, and how many chunks it has."""
    points = [(n, s, o, titles) for n, (s, o) in enumerate((s, o) for s in SIZES for o in OVERLAPS) for titles in (True, False)]
    views = [(v, n, titles) for v, (n, _, _, titles) in enumerate(points)]
    got, size = _evaluated(spark, d, _stored_units(spark, d, [(s, o) for s in SIZES for o in OVERLAPS]), views, ["query"], SWEPT_K, 20, 10)
    grid = spark.createDataFrame([(v, s, o, titles, size[v]) for v, (_, s, o, titles) in enumerate(points)], "view int, size long, overlap long, titles boolean, n_chunks long")
    return F.broadcast(grid).join(got, "view", "left").drop("view", "query_input")


def _compare(spark: SparkSession, d: str, units: DataFrame, labels: list[str]) -> DataFrame:
    """setting, query_input and the metrics of bm25 (RR@100, nDCG@10, Recall@20) for both texts of the forms; ``units`` has a part for each label."""
    got, size = _evaluated(spark, d, units, [(n, n, True) for n in range(len(labels))], list(TEXTS), 100, 100, 20)
    named = spark.createDataFrame([(n, x, size[n]) for n, x in enumerate(labels)], "view int, setting string, n_chunks long")
    return F.broadcast(named).join(got, "view", "left").drop("view")


def chunking_compare(spark: SparkSession, d: str) -> DataFrame:
    return _compare(spark, d, _stored_units(spark, d, [(500, 50), (None, 50)]), ["chunked", "per_section"])


STRATEGIES = ["whole", "cascade", "toc_or_whole"]


def segmentation_compare(spark: SparkSession, d: str) -> DataFrame:
    """The sections of each strategy, chunked alike."""
    docs = spread(load(spark, d, "documents").select("doc_id", "text", "title"))
    doc = docs.select("doc_id", t.plain_doc_id(F.col("title")).alias("doc"))
    parts = []
    for n, strategy in enumerate(STRATEGIES):
        made = sections.document_sections(docs, "doc_id", "text", "title", strategy).select("doc_id", F.col("index").alias("section_index"), "heading", "text")
        s = checkpointed(made)  # headings and bodies read it, in both passes
        parts.append(_units(docs, s, "doc_id", doc, 500, 50, n))
    return _compare(spark, d, reduce(DataFrame.unionByName, parts), STRATEGIES)


def relevant_sets(spark: SparkSession, d: str) -> DataFrame:
    r = evaluation.relevant_sets(_qrels(spark, d))
    return r.select("query_type", "query_id", "docs", F.col("n").cast("long").alias("n"))


def latest_run(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.latest(load(spark, d, "events"), "event_type", "ts").select("event_type", "event_id", "value")


def run_labels(spark: SparkSession, d: str) -> DataFrame:
    m = load(spark, d, "metadata")
    return m.select("record_id", evaluation.run_label([F.col("document_type"), F.col("process"), F.col("version"), F.col("page_count")]).alias("label"), evaluation.short_model(F.col("source_url")).alias("model"))


def ordered_methods(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.method_order(load(spark, d, "events"), "event_type", PREFERRED)


def coerce_types(spark: SparkSession, d: str) -> DataFrame:
    m = load(spark, d, "metadata")
    day = F.when(F.col("publish_date").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.to_date(F.try_to_timestamp("publish_date", F.lit("yyyy-MM-dd"))))
    return m.select("record_id", F.regexp_replace("version", "^[vV]", "").try_cast("double").alias("version"), day.alias("published"))


def dedupe_runs(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").withColumn("whole", F.floor("value"))
    return evaluation.first_of_equal(e, ["user_id", "event_type", "whole"], ["event_id"]).select("event_id", "user_id", "event_type")


def top_runs(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").orderBy(F.desc("value"), "event_id").limit(20).select("event_id", "event_type", "value")


def rr_pivot(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").groupBy((F.col("user_id") % 7).alias("query_type")).pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.round(F.avg("value"), 6))
    return e


def appended_csv(spark: SparkSession, d: str) -> DataFrame:
    from fathom.plans.registry import target_fields

    return schema_drift.ingest(load(spark, d, "evaluation_summary"), target_fields(spark, d))


def collect_runs(spark: SparkSession, d: str) -> DataFrame:
    """All result rows with the file, its kind (runs or aggregate) and the experiment, of the column, else of the path."""
    files = load(spark, d, "evaluation_summary").groupBy("file_id").agg(F.min("source_file").alias("source_file"))
    rows = appended_csv(spark, d).join(files, "file_id")
    path = F.regexp_extract("source_file", r"experiments/([^/]+)/", 1)
    return rows.select("file_id", "line_no", F.regexp_extract("source_file", r"results/([^/]+)/", 1).alias("source_kind"), F.coalesce("experiment", F.nullif(path, F.lit(""))).alias("experiment"), "method", "average_score")


QUERIES = {
    f.__name__: f
    for f in (submissions_scan, submissions_to_qrels, submission_audit, exclude_submissions, relevant_chunks, sheet_unpivot, load_qrels, clean_qrels, qrels_variants, run_table, rr_at_k, ndcg_at_k, recall_at_k, average_rank, macro_summary, ndcg_per_query, quantile_bins, sweep_grid, chunking_compare, segmentation_compare, relevant_sets, latest_run, run_labels, ordered_methods, coerce_types, dedupe_runs, top_runs, rr_pivot, appended_csv, collect_runs)
}

_TEXTS = ", ".join(f'"{c}": "VARCHAR"' for c in judgements._TEXTS)
_KEYS = ", ".join(f'"{c}": "VARCHAR"' for c in dict.fromkeys([*judgements.DOCUMENT_KEYS, *fusion.URL_KEYS, "section_heading", "section_text", "demo_method", "pooled_from"]))
_J = f'{{"query": "VARCHAR", "information_need": "VARCHAR", "participant_name": "VARCHAR", "general_comment": "VARCHAR", "results": [{{{_TEXTS}, "metadata": {{{_KEYS}}}, "assessment": {{"rating": "VARCHAR", "relevant_scope": "VARCHAR", "relevant_section": "VARCHAR", "comment": "VARCHAR"}}}}]}}'


def _one(*options: str) -> str:
    return f"coalesce({', '.join(f"nullif(trim({o}, ' '), '')" for o in options)}, '')"


_DOC = doc_id_sql(_one("r.document", "r.title", *(f"r.metadata.{k}" for k in judgements.DOCUMENT_KEYS), "r.source_path", "r.source_url", "r.url"))
FORMS = f"""forms as (select *, json_transform(payload_json, '{_J}') p from submissions where json_valid(payload_json)),
res0 as (select id, created_at, coalesce(nullif(trim(p.query), ''), trim(query_text), '') query_id, trim(coalesce(information_need, '')) information_need, unnest(p.results) r, unnest(range(1, len(p.results) + 1)) result_index from forms),
res as (select *, {_DOC} doc from res0)"""
JUDGED = f"""{FORMS},
q0 as (select id, query_id, doc doc_id, coalesce(r.assessment.rating = 'relevant', false)::int relevance from res where query_id <> '' and doc <> ''),
qrels as (select id query_id, doc_id, max(relevance) relevance, 'type_' || (id % 4) query_type from q0 group by 1, 2, 4),
run as (select id query_id, doc doc_id, max(1.0::double / result_index) score from res where doc <> '' group by 1, 2)"""


def metrics_sql(run: str, by: str = "", k: int = 20, recall: int = 10, qrels: str = "qrels", settings: str = "") -> str:
    b = f"{by}, " if by else ""
    methods = f", ({settings or f'select distinct {by} from {run}'})" if by else ""
    on = f" and x.{by} = z.{by}" if by else ""
    return f"""rk as (select *, row_number() over (partition by {b}query_id order by score desc, doc_id) rnk from {run}),
gold as (select query_id, doc_id, relevance from {qrels} where relevance > 0),
idl as (select query_id, sum(relevance / log2(n + 1)) filter (n <= 10) ideal, count(*) alln from (select *, row_number() over (partition by query_id order by relevance desc, doc_id) n from gold) group by 1),
z as (select {b}query_id, min(rnk) filter (rnk <= {k}) first_rank, sum(relevance / log2(rnk + 1)) filter (rnk <= 10) dcg, count(*) filter (rnk <= {recall}) hits from rk join gold using (query_id, doc_id) group by all),
x as (select * from (select distinct query_id from {qrels}){methods}),
sc as (select x.*, first_rank, coalesce(1.0 / first_rank, 0) rr, coalesce(dcg / ideal, 0) ndcg, coalesce(hits / alln, 0) recall from x left join z on x.query_id = z.query_id{on} left join idl on idl.query_id = x.query_id)"""


SUMMARY = "count(*) as n_queries, round(avg(rr), 6) as rr, round(avg(ndcg), 6) as ndcg, round(avg(recall), 6) as recall, round(coalesce(avg(first_rank), 0), 6) as average_rank"
_NPQ = f"with {JUDGED}, {metrics_sql('run')}, npq as (select query_id, round(ndcg, 6) ndcg, case when trim(coalesce(information_need, '')) = '' then 0 else len(string_split(trim(regexp_replace(information_need, '[\\s\\x{{a0}}]+', ' ', 'g')), ' ')) end as words, length(coalesce(information_need, '')) as chars from sc join submissions on id = query_id)"
ORACLE = {
    "submissions_scan": f"with {FORMS} select id, coalesce(len(p.results), 0) as n_results from forms",
    "submissions_to_qrels": f"with {JUDGED} select id, query_id, doc_id, relevance from q0",
    "submission_audit": f"with {FORMS}, a as (select *, list_transform(coalesce(p.results, []), lambda r: coalesce(r.assessment.rating, '')) x from forms), b as (select id, coalesce(nullif(trim(p.query), ''), trim(query_text), '') as query_id, len(x) as num_results, len(list_filter(x, lambda v: v = 'relevant')) as num_relevant, len(list_filter(x, lambda v: v = 'not_relevant')) as num_non_relevant, lower(trim(coalesce(p.query, ''))) = 'test' or lower(trim(coalesce(information_need, ''))) = 'test' as looks_like_test from a) select *, num_results - num_relevant - num_non_relevant as num_unrated from b",
    "exclude_submissions": "select id, query_text from submissions where coalesce(lower(trim(information_need)), '') <> 'test'",
    "relevant_chunks": f"with {FORMS} select id, created_at, {', '.join(f'{_one(f"p.{c}")} as {c}' for c in ('participant_name', 'information_need', 'query', 'general_comment'))}, result_index, {_one('r.chunk_id')} as chunk_id, {_one('r.chunk_type')} as chunk_type, {_one('r.source_path')} as source_path, {_one('r.title', *(f'r.metadata.{k}' for k in fusion.TITLE_KEYS))} as document_title, {_one(*(f'r.{k}' for k in fusion.URL_KEYS), *(f'r.metadata.{k}' for k in fusion.URL_KEYS))} as document_url, {_one("array_to_string(from_json(r.metadata.pooled_from, '[\"VARCHAR\"]'), '|')", 'r.result_method', 'r.demo_method', 'r.metadata.demo_method')} as pooled_from_methods, {_one('r.section_heading', 'r.metadata.section_heading')} as section_heading, {_one('r.section_text', 'r.chunk_text', 'r.preview_text', 'r.text', 'r.metadata.section_text')} as chunk_text, {_one('r.assessment.relevant_scope')} as relevant_scope, {_one('r.assessment.relevant_section')} as relevant_section, {_one('r.assessment.comment')} as assessment_comment from (select f.*, res.r, res.result_index from res join forms f using (id)) where trim(r.assessment.rating) = 'relevant'",
    "sheet_unpivot": f"with a as (select title, unnest(['tax_keyword', 'comment', 'process']) query_type, unnest([tax_keyword, comment, process]) q from metadata) select distinct query_type, {sq('q')} as query_id, {doc_id_sql('title')} as doc_id, 1 as relevance from a where {sq("coalesce(q, '')")} <> '' and {doc_id_sql('title')} <> ''",
    "load_qrels": f"with {JUDGED} select query_type, count(distinct query_id) as n_queries, count(*) as n_rows, min(query_id) as first_seen from qrels group by 1",
    "clean_qrels": f"with {FORMS} select distinct query_id as query, information_need, doc as doc_id, 1 as relevance from res where query_id <> '' and information_need <> '' and doc <> ''",
    "qrels_variants": f"with {FORMS}, a as (select query_text t, min(id) f from forms where trim(query_text) <> '' group by 1), b as (select information_need t, min(id) f from forms where trim(information_need) <> '' group by 1) select t as text, 'query_' || (case when row_number() over (order by f, t) < 10 then '0' else '' end) || row_number() over (order by f, t) as query_id from a union all select t, 'info_need_' || (case when row_number() over (order by f, t) < 10 then '0' else '' end) || row_number() over (order by f, t) from b",
    "run_table": f"with {JUDGED} select query_id, doc_id, round(score, 6) as score from run",
    "rr_at_k": f"with {JUDGED}, {metrics_sql('run')} select query_id, round(rr, 6) as rr from sc",
    "ndcg_at_k": f"with {JUDGED}, {metrics_sql('run')} select query_id, round(ndcg, 6) as ndcg from sc",
    "recall_at_k": f"with {JUDGED}, {metrics_sql('run')} select query_id, round(recall, 6) as recall from sc",
    "average_rank": f"with {JUDGED}, {metrics_sql('run')} select count(*) as n_queries, round(coalesce(avg(first_rank), 0), 6) as average_rank from sc",
    "macro_summary": f"with {JUDGED}, {metrics_sql('run')}, t as (select query_type, {SUMMARY} from sc join (select distinct query_id, query_type from qrels) using (query_id) group by 1) select round(avg(rr), 6) as rr, round(avg(ndcg), 6) as ndcg, round(avg(recall), 6) as recall, round(avg(average_rank), 6) as average_rank, sum(n_queries)::bigint as num_queries_total, count(*) as num_query_types from t",
    "ndcg_per_query": f"{_NPQ} select query_id, ndcg, words, chars from npq",
    "quantile_bins": f"{_NPQ}, e as (select list_distinct(quantile_cont(words, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) e from npq), b as (select greatest(1, len(list_filter(e, lambda v: v < words)))::int bin, * from npq, e) select bin, count(*) as n, round(avg(words), 6) as mean_x, round(avg(ndcg), 6) as mean_y from b group by 1",
    "relevant_sets": f"with {JUDGED}, a as (select query_type, query_id, list_sort(list(distinct doc_id) filter (relevance > 0)) x from qrels group by all) select query_type, query_id, coalesce(array_to_string(x, '|'), '') as docs, coalesce(len(x), 0) as n from a",
    "latest_run": "select event_type, event_id, value from events where (event_type, ts) in (select (event_type, max(ts)) from events group by event_type)",
    "run_labels": "select record_id, concat_ws(' | ', nullif(trim(document_type), ''), nullif(trim(process), ''), nullif(trim(version), ''), page_count) as label, regexp_extract(source_url, '([^/]*)$', 1) as model from metadata",
    "ordered_methods": "select event_type, row_number() over (order by coalesce(list_position(['view', 'click', 'purchase'], event_type), 4), event_type) as position from (select distinct event_type from events where event_type is not null)",
    "coerce_types": "select record_id, try_cast(regexp_replace(version, '^[vV]', '') as double) as version, case when regexp_matches(publish_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') then try_cast(publish_date as date) end as published from metadata",
    "dedupe_runs": "select event_id, user_id, event_type from events qualify row_number() over (partition by user_id, event_type, floor(value) order by event_id) = 1",
    "top_runs": "select event_id, event_type, value from events order by value desc, event_id limit 20",
    "rr_pivot": "select user_id % 7 as query_type, " + ", ".join(f"round(avg(value) filter (event_type = '{e}'), 6) as {e}" for e in ("click", "error", "purchase", "signup", "view")) + " from events group by 1",
}

_SETTINGS = "select part, size, overlap from (values " + ", ".join(f"({n}, {s}, {o})" for n, (s, o) in enumerate((s, o) for s in SIZES for o in OVERLAPS)) + ") g(part, size, overlap)"
_POINTS = f"select 2 * part + (1 - titles::int) view, part, size, overlap, titles from ({_SETTINGS}), (values (true), (false)) t(titles)"


def asked_sql(texts: list[str]) -> tuple[str, str]:
    """The texts of the forms that are asked, and their qrels, with a number for each form and text."""
    n = len(texts)
    q = " union all ".join(f"select id * {n} + {k} query_id, {TEXTS[x]} q from submissions where id % 20 = 0" for k, x in enumerate(texts))
    return q, f"judged as (select unnest([{', '.join(f'query_id * {n} + {k}' for k in range(n))}]) query_id, doc_id, relevance from qrels where query_id % 20 = 0)"


def _compared_sql(units: str, views: str, texts: list[str], k: int, recall: int, labels: str, keep: str, docs: str = "") -> str:
    asked, judged = asked_sql(texts)
    told = f"case query_id % {len(texts)} {' '.join(f"when {n} then '{x}'" for n, x in enumerate(texts))} end"
    scores = metrics_sql("run", "view", k, recall, "judged", f"select view from ({views})")
    return f"with recursive {JUDGED.replace('run as (', 'shown as (')}, {judged}, {units}, {runs_sql(views, asked, k, docs)}, {scores}, told as (select view, {told} query_input, {SUMMARY} from sc group by 1, 2) select {keep} from told join ({labels}) using (view) join sizes using (view)"


_COMPARED = "setting, n_chunks, query_input, n_queries, rr, ndcg, recall, average_rank"


def _alike(n: int) -> str:
    return f"select view, view part, true titles from (select unnest(range({n})) view)"


def _labels(names: list[str]) -> str:
    return f"select unnest(range({len(names)})) view, unnest({names}) setting"


ORACLE |= {
    "chunk_text": f"with recursive {chunks_sql('select doc_id id, text x from documents', 'select 0 part, 250 size, 50 overlap')} select id as doc_id, k::int as chunk_index, chunk from chunks",
    "corpus_bm25": corpus_sql(500, 50, "source_path, section_index, unit, chunk_index, chunk_type, text, preview_text"),
    "corpus_vector": corpus_sql(500, 25, "source_path, section_index, unit, chunk_index, 'passage: ' || trim(text, ' ') as text"),
    "sweep_grid": _compared_sql(units_sql(_SETTINGS), _POINTS, ["query"], SWEPT_K, 10, _POINTS, "size::bigint as size, overlap::bigint as overlap, titles, n_chunks, n_queries, rr, ndcg, recall, average_rank"),
    "chunking_compare": _compared_sql(units_sql("select 0 part, 500 size, 50 overlap", "select 1 part"), _alike(2), list(TEXTS), 100, 20, _labels(["chunked", "per_section"]), _COMPARED),
    "segmentation_compare": _compared_sql(strategy_units_sql(STRATEGIES, 500, 50), _alike(3), list(TEXTS), 100, 20, _labels(STRATEGIES), _COMPARED, doc_id_sql("title")),
}
