"""Queries of the index, ranking and vector operators, and their SQL.

Queries are the search texts of every form whose id is divisible by 20, against
all chunks; query vectors are every vector whose id is, against all vectors.
Searches read the stored indexes of ``operators.stored``, never the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import text as t
from fathom.functions import urls
from fathom.operators import fusion, index, judgements, stored, vectors
from fathom.plans.text_queries import TOKEN, corpus_fts
from fathom.tables import load, spread

K = 10
ONE_QUERY = "rutin för läkemedel och provtagning rutin"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return spread(load(spark, d, "chunk_metadata").select("chunk_id", "source_path", "chunk_type", "text"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "submissions").where("id % 20 = 0").select(F.col("id").alias("query_id"), "query_text")


def _bm25_of(spark: SparkSession, d: str, terms: DataFrame, k: int) -> DataFrame:
    ix = stored.bm25_index(spark, chunk_table(d), "chunk_id", "text")
    terms, small = index.held(terms)
    post, frequency = ix.asked(terms, small)
    return index.bm25(terms, post.withColumnRenamed("f", "tf"), ix.stats, "chunk_id", "query_id", k, frequency=frequency, small=small)


def chunk_table(d: str) -> str:
    return f"{d}/chunk_metadata.parquet"


def postings(spark: SparkSession, d: str) -> DataFrame:
    return index.postings(_chunks(spark, d), "chunk_id", "text")


def term_stats(spark: SparkSession, d: str) -> DataFrame:
    return index.term_stats(index.postings(_chunks(spark, d), "chunk_id", "text"))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    s = index.corpus_stats(index.lengths(_chunks(spark, d), "chunk_id", "text"))
    return s.select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    q = spark.createDataFrame([(1, ONE_QUERY)], "query_id long, query_text string")
    return _bm25_of(spark, d, index.query_terms(q, "query_id", "query_text"), K).select("chunk_id", "score", "rank")


def _bm25(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    return _bm25_of(spark, d, index.query_terms(_queries(spark, d), "query_id", "query_text"), k)


def bm25_batch(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d)


def _weighted_of(spark: SparkSession, d: str, terms: DataFrame, k: int) -> DataFrame:
    ix = stored.fields_index(spark, chunk_table(d), "chunk_id", lambda: corpus_fts(spark, d))
    terms, small = index.held(terms)
    post, frequency = ix.asked(terms, small)
    return index.weighted_fields(terms, post, ix.stats, "chunk_id", "query_id", k, frequency=frequency, small=small)


def _weighted(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    return _weighted_of(spark, d, index.query_terms(_queries(spark, d), "query_id", "query_text"), k)


def fts_weighted_topk(spark: SparkSession, d: str) -> DataFrame:
    return _weighted(spark, d)


def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings").select("vec_id", F.posexplode(vectors.unit(F.col("embedding"))).alias("dim", "x"))
    return e.select("vec_id", "dim", F.round("x", 6).alias("value"))


def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    """The mean over all vectors of a label; nothing is masked."""
    e = load(spark, d, "embeddings").withColumn("mask", F.lit(1))
    return vectors.mean_pool(e, "label", "embedding", "mask").select("label", "dim", F.round("value", 6).alias("value"))


def e5_prefix(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "submissions").select("id", vectors.with_prefix(F.col("query_text"), "query: ").alias("query"))


def embed_text(spark: SparkSession, d: str) -> DataFrame:
    e = vectors.embed(load(spark, d, "documents"), "doc_id", "text")
    return e.select("doc_id", F.size("embedding").alias("dims"), F.round(vectors.norm(F.col("embedding")), 4).alias("norm"))


def _vectors_told(v: DataFrame) -> DataFrame:
    """The numbers of the vectors that are not 0."""
    rows = v.select("chunk_id", F.posexplode("embedding").alias("dim", "x")).where("x <> 0")
    return rows.select("chunk_id", "dim", F.round(F.col("x").cast("double"), 5).alias("value"))


def vector_index_build(spark: SparkSession, d: str) -> DataFrame:
    """The stored vectors of all chunks, with the passage prefix."""
    return _vectors_told(stored.vector_index(spark, chunk_table(d), "chunk_id", "text", "e5_large_instruct"))


def title_index(spark: SparkSession, d: str) -> DataFrame:
    """The stored vectors of the titles alone, without a prefix."""
    return _vectors_told(stored.vector_index(spark, chunk_table(d), "chunk_id", "text", "swedish_bert", "chunk_type = 'title'"))


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings")
    query = e.orderBy("vec_id").select("embedding").first()
    return vectors.top_k(e, list(query[0]) if query else [0.0], K)


def _near(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    e = load(spark, d, "embeddings")
    return vectors.search(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e, k)


def vector_batch(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d)


def _titled(spark: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    c = load(spark, d, "chunk_metadata").select("chunk_id", "source_path", "chunk_type", F.from_json("metadata_json", "map<string,string>").alias("m"))
    return hits.join(c, "chunk_id").select("query_id", "chunk_id", "source_path", "chunk_type", t.plain_doc_id(fusion.result_title(F.col("m"), F.col("source_path"))).alias("doc"), "score", "rank")


def result_title(spark: SparkSession, d: str) -> DataFrame:
    """Title, address, score as text and user of the chunks as hits; every other one has no title."""
    c = load(spark, d, "chunk_metadata").withColumn("m", F.from_json("metadata_json", "map<string,string>"))
    bare = F.when(F.col("chunk_id") % 2 == 0, F.map_filter("m", lambda k, v: k != "title")).otherwise(F.col("m"))
    score = fusion.score_text(F.col("section_level") / (F.col("section_index") + 3))
    return c.select("chunk_id", fusion.result_title(F.col("m"), F.col("source_path")).alias("title"), fusion.result_title(bare, F.col("source_path")).alias("other_title"), fusion.result_url(F.col("m")).alias("url"), score.alias("score"))


def best_chunk_per_doc(spark: SparkSession, d: str) -> DataFrame:
    hits = _titled(spark, d, _bm25(spark, d, 30))
    return fusion.best_per_document(hits, "doc", group=["query_id"], k=K).select("query_id", "doc", "chunk_id", "score", F.col("new_rank").alias("rank"))


def dedupe_docs(spark: SparkSession, d: str) -> DataFrame:
    return fusion.dedupe_documents(_titled(spark, d, _bm25(spark, d, 30)), "query_id", "doc", K)


def seeded_shuffle(spark: SparkSession, d: str) -> DataFrame:
    hits = _bm25(spark, d).select(F.col("query_id").cast("string").alias("query_id"), "chunk_id", "rank")
    return fusion.seeded_shuffle(hits, "query_id", "chunk_id", "rank", "run-1")


def search_log_rows(spark: SparkSession, d: str) -> DataFrame:
    hits = F.from_json("payload_json", "struct<results:array<struct<title:string, source_path:string>>>").getField("results")
    s = load(spark, d, "submissions").where("try_parse_json(payload_json) is not null").select("id", "query_text", F.coalesce(hits, F.array().cast("array<struct<title:string,source_path:string>>")).alias("hits"))
    return fusion.log_rows(s, ["id", "query_text"], "hits").select("id", "query_text", F.col("result_count").cast("long").alias("result_count"), F.col("rank").cast("long").alias("rank"), F.col("hit.title").alias("title"))


def validate_ratings(spark: SparkSession, d: str) -> DataFrame:
    """Ratings made of the events: what is wrong with them, and the documents of those that are accepted."""
    blank = F.when(F.col("event_id") % 11 == 0, " ")
    request = F.struct(F.coalesce(blank, F.col("user_id").cast("string")).alias("search_id"), F.get_json_object("props", "$.k").alias("user_score"), F.lit("").alias("document"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("title"), F.col("event_type").alias("source_path"), F.lit("u").alias("url"))
    e = load(spark, d, "events").select(request.alias("q")).select(fusion.rating_errors(F.col("q")).alias("error"), fusion.rated_document(F.col("q")).alias("document"))
    return e.groupBy("error", "document").agg(F.count(F.lit(1)).alias("n"))


def validate_submissions(spark: SparkSession, d: str) -> DataFrame:
    fine, wrong = judgements.accepted(load(spark, d, "submissions"))
    user = fusion.user_name(F.create_map(F.lit("user_name"), F.lit(" "), F.lit("participant_name"), F.col("participant_name")))
    return fine.withColumn("errors", F.lit("")).unionByName(wrong).select("id", "errors", user.alias("user_name"))


def safe_parse(spark: SparkSession, d: str) -> DataFrame:
    m = load(spark, d, "metadata")
    return m.select("record_id", fusion.safe_int(F.regexp_replace("version", "^[vV]", ""), -1).alias("version"), fusion.safe_bool(F.col("comment"), False).alias("flag"))


QUERIES = {
    f.__name__: f
    for f in (postings, term_stats, corpus_stats, bm25_topk, bm25_batch, fts_weighted_topk, l2_normalize, mean_pool, e5_prefix, embed_text, vector_index_build, title_index, vector_topk, vector_batch, result_title, best_chunk_per_doc, dedupe_docs, seeded_shuffle, search_log_rows, validate_ratings, validate_submissions, safe_parse)
}

POST = f"""w as (select chunk_id, unnest({TOKEN.format("text")}) term from chunk_metadata),
post as (select term, chunk_id, count(*) tf from w group by all),
dl as (select chunk_id, sum(tf) dl from post group by 1),
st as (select count(*) n, avg(dl) avgdl from dl)"""


def bm25_sql(queries: str, k: int, name: str = "bm") -> str:
    return f"""{name}_t0 as (select query_id, unnest({TOKEN.format("q")}) term, unnest(range(len({TOKEN.format("q")}))) pos from ({queries})),
{name}_t as (select query_id, term, count(*) qtf, min(pos) qpos from {name}_t0 group by all),
{name}_s as (select query_id, p.chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) score, min(qpos) qpos
 from {name}_t join post p using (term) join (select term, count(*) df from post group by 1) f using (term) join dl using (chunk_id), st group by all),
{name} as (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, qpos, chunk_id) rank from {name}_s qualify rank <= {k})"""


FORM_QUERIES = "select id query_id, query_text q from submissions where id % 20 = 0"
_FTS = """f0 as (select chunk_id, case when chunk_type = 'section' then '' else coalesce(text, '') end title_text, case when chunk_type <> 'title' then coalesce(text, '') else '' end body_text, metadata_json j, list_sort(list_filter(json_keys(metadata_json), lambda k: k not in ('section_path', 'section_text', 'source_url', 'downloaded_at'))) ks from chunk_metadata),
f1 as (select chunk_id, title_text, body_text, array_to_string(list_filter(list_transform(ks, lambda k: trim(json_extract_string(j, '$.' || k))), lambda v: v is not null and v <> ''), ' ') metadata_text from f0),
f2 as (select chunk_id, unnest([5.0, 1.0, 0.5]) wt, unnest([list_transform(regexp_extract_all(title_text, '[\\p{L}\\p{N}\\p{Co}]+'), lambda w: lower(w)), list_transform(regexp_extract_all(body_text, '[\\p{L}\\p{N}\\p{Co}]+'), lambda w: lower(w)), list_transform(regexp_extract_all(metadata_text, '[\\p{L}\\p{N}\\p{Co}]+'), lambda w: lower(w))]) words from f1),
fw as (select chunk_id, wt, unnest(words) term from f2),
fdl as (select chunk_id, sum(len(words)) dl from f2 group by 1),
fst as (select count(*) n, avg(dl) avgdl from fdl),
fp as (select term, chunk_id, sum(wt) f from fw group by all),"""


def fts_sql(queries: str, k: int) -> str:
    return f"""{_FTS} ft as (select distinct query_id, unnest({TOKEN.format("q")}) term from ({queries})),
fs as (select query_id, p.chunk_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) score
 from ft join fp p using (term) join (select term, count(*) df from fp group by 1) x using (term) join fdl using (chunk_id), fst group by all),
fts as (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) rank from fs qualify rank <= {k})"""


def first_sql(*options: str) -> str:
    return f"coalesce({', '.join(f"nullif(trim({o}, ' '), '')" for o in options)})"


def json_text(json: str, key: str) -> str:
    """A member of a JSON object as text, null if there is none."""
    return f"json_extract_string({json}, '$.{key}')"


_ADDRESS = first_sql(*(json_text("metadata_json", k) for k in fusion.URL_KEYS))
_URL = f"case when regexp_matches({_ADDRESS}, '(?i)^https?://') then {_ADDRESS} else '' end"
_LAST = "list_filter(string_split(regexp_replace({}, '^[^/:]*://[^/?#]*|[?#].*$', '', 'g'), '/'), lambda x: x <> '')[-1]"
_NAMED = ", ".join(f"nullif(url_decode(replace(regexp_extract({_URL}, '[?&]{k}=([^&#]+)', 1), '+', ' ')), '')" for k in urls.NAME_KEYS)
_NAME = f"coalesce({_NAMED}, case when lower(url_decode({_LAST.format(_URL)})) <> 'getdocument' then url_decode({_LAST.format(_URL)}) end)"
TITLE = first_sql(*(json_text("metadata_json", k) for k in fusion.TITLE_KEYS), _NAME, "list_filter(string_split(trim(source_path, ' '), '/'), lambda x: x <> '')[-1]")


def _doc_sql(x: str) -> str:
    from fathom.plans.text_queries import doc_id_sql

    return doc_id_sql(x)


DOC = f"dc as (select chunk_id, {_doc_sql(TITLE)} doc from chunk_metadata)"
DOCLISTS = f"""with {POST}, {bm25_sql(FORM_QUERIES, 30)}, {DOC},
d1 as (select query_id, doc, chunk_id, score, rank r from bm join dc using (chunk_id) where doc <> '' qualify row_number() over (partition by query_id, doc order by score desc, rank) = 1),
e1 as (select *, row_number() over (partition by query_id order by score desc, r) rank from d1)"""
#: The unit vectors of texts as ``vectors.hash_embedding`` makes them, one row for each number: {0} names them, {1} is a query of id and x.
HASHED = """{0}_c as (select id, ('0x' || substr(md5(term), 1, 8))::bigint % 64 k, sum(case when substr(md5(term), 9, 1) >= '8' then 1 else -1 end)::double c from (select id, unnest(list_transform(regexp_extract_all(x, '[0-9A-Za-zÅÄÖåäö]+'), lambda w: lower(w))) term from ({1})) group by all),
{0} as (select id, k, (c / nullif(sqrt(sum(c * c) over (partition by id)), 0))::float x from {0}_c)"""
HAS_WORD = "regexp_matches(text, '[0-9A-Za-zÅÄÖåäö]')"


def prefixed(x: str, prefix: str) -> str:
    return f"case when starts_with(lower(trim({x}, ' ')), '{prefix}:') then trim({x}, ' ') else '{prefix}: ' || trim({x}, ' ') end"


UNIT = "list_transform(embedding, lambda x: x::double / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double))), 1e-12))"

ORACLE = {
    "postings": f"with {POST} select term, chunk_id, tf from post",
    "term_stats": f"with {POST} select term, count(*) as df, sum(tf)::bigint as cf from post group by 1",
    "corpus_stats": f"with {POST} select n, round(avgdl, 6) as avgdl from st",
    "bm25_topk": f"with {POST}, {bm25_sql(f"select 1 query_id, '{ONE_QUERY}' q", K)} select chunk_id, score, rank from bm",
    "bm25_batch": f"with {POST}, {bm25_sql(FORM_QUERIES, K)} select query_id, chunk_id, score, rank from bm",
    "fts_weighted_topk": f"with {fts_sql(FORM_QUERIES, K)} select query_id, chunk_id, score, rank from fts",
    "l2_normalize": f"with a as (select vec_id, {UNIT} u from embeddings) select vec_id, unnest(range(len(u)))::int as dim, round(unnest(u), 6) as value from a",
    "mean_pool": "with a as (select label, 1 m, unnest(embedding)::double x, unnest(range(len(embedding)))::int dim from embeddings) select label, dim, round(sum(x * m) / greatest(sum(m), 1e-9), 6) as value from a group by 1, 2",
    "e5_prefix": "select id, case when lower(trim(query_text)) like 'query:%' then trim(query_text) else 'query: ' || trim(query_text) end as query from submissions",
    "embed_text": f"with {HASHED.format('h', 'select doc_id id, text x from documents')}, n as (select id, round(sqrt(sum(x::double * x::double)), 4) n from h group by 1) select doc_id, 64 as dims, round(coalesce(n, 0), 4) as norm from documents left join n on id = doc_id",
    "vector_index_build": f"with {HASHED.format('h', f'select chunk_id id, {prefixed("text", "passage")} x from chunk_metadata where {HAS_WORD}')} select id as chunk_id, k::int as dim, round(x::double, 5) as value from h where x <> 0",
    "title_index": f"with {HASHED.format('h', f"select chunk_id id, text x from chunk_metadata where chunk_type = 'title' and {HAS_WORD}")} select id as chunk_id, k::int as dim, round(x::double, 5) as value from h where x <> 0",
    "vector_topk": f"with u as (select vec_id, {UNIT} e from embeddings), q as (select e qe from u order by vec_id limit 1) select vec_id, round(list_sum(list_transform(list_zip(e, qe), lambda p: p[1] * p[2])), 5) as score, row_number() over (order by round(list_sum(list_transform(list_zip(e, qe), lambda p: p[1] * p[2])), 5) desc, vec_id) as rank from u, q qualify rank <= 10",
    "vector_batch": f"with u as (select vec_id, {UNIT} e from embeddings), s as (select q.vec_id query_id, u.vec_id, round(list_dot_product(u.e, q.e), 5) score from u, u q where q.vec_id % 20 = 0) select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from s qualify rank <= 10",
    "result_title": f"select chunk_id, {TITLE} as title, case when chunk_id % 2 = 0 then {first_sql(*(json_text('metadata_json', k) for k in fusion.TITLE_KEYS[1:]), _NAME, "list_filter(string_split(trim(source_path, ' '), '/'), lambda x: x <> '')[-1]")} else {TITLE} end as other_title, {_URL} as url, coalesce(printf('%.12g', section_level / (section_index + 3)::double), '') as score from chunk_metadata",
    "best_chunk_per_doc": f"{DOCLISTS} select query_id, doc, chunk_id, score, rank from e1 where rank <= 10",
    "dedupe_docs": f"with {POST}, {bm25_sql(FORM_QUERIES, 30)}, {DOC}, a as (select query_id, doc, max(score) score from bm join dc using (chunk_id) where doc <> '' group by 1, 2) select query_id, doc, score, row_number() over (partition by query_id order by score desc, doc) as rank from a qualify rank <= 10",
    "search_log_rows": "with a as (select id, query_text, json_transform(payload_json, '{\"results\": [{\"title\": \"VARCHAR\", \"source_path\": \"VARCHAR\"}]}').results r from submissions where json_valid(payload_json)), b as (select id, query_text, coalesce(len(r), 0) result_count, case when coalesce(len(r), 0) = 0 then [null] else r end r from a) select id, query_text, result_count, unnest(case when result_count = 0 then [null] else range(1, result_count + 1) end) as rank, unnest(r).title as title from b",
    "validate_ratings": "with a as (select case when event_id % 11 = 0 then 'search_id is required' when not coalesce(regexp_matches(json_extract_string(props, '$.k'), '^\\s*[1-5]\\s*$'), false) then 'user_score must be 1 to 5' else '' end as error, event_type as document from events) select error, document, count(*) as n from a group by 1, 2",
    "validate_submissions": f"select id, concat_ws('|', case when {first_sql('participant_name')} is null then 'participant_name' end, case when {first_sql('information_need')} is null then 'information_need' end, case when {first_sql('query_text')} is null then 'query' end) as errors, coalesce({first_sql('participant_name')}, '') as user_name from submissions",
    "safe_parse": "select record_id, coalesce(case when regexp_matches(trim(regexp_replace(version, '^[vV]', '')), '^[0-9]+$') then try_cast(trim(regexp_replace(version, '^[vV]', '')) as int) end, -1) as version, case when lower(trim(comment)) in ('1', 'true', 'yes', 'on', 'y') then true else false end as flag from metadata",
}
