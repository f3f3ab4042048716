"""Queries over the runs of all engines, for both texts of a form: its search text and its stated need; and their SQL.

Each engine searches all chunks for every form, all of them in one pass over the
stored blocks of ``operators.engines``; the encoder of both dense engines is the
hashing one, which SQL can say as well. Queries that are stated for some forms only
name them by a condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions import text as t
from fathom.operators import engines, evaluation, fusion, index, stored, vectors
from fathom.plans import search_queries as words
from fathom.plans.evaluation_queries import JUDGED, SUMMARY, _qrels, metrics_sql
from fathom.plans.text_queries import corpus_fts
from fathom.tables import load, spread

INPUTS = ["query", "information_need"]
TEXTS = ["query_text", "information_need"]
#: Results of a run, of a search, of a weight sweep; how many times as many a fused method takes from its engines; what the dense bucket fetches.
K, TOP, SWEPT, DEEP, FETCHED = 20, 10, 100, 3, 100
#: The engines that a fused method takes its lists from.
FUSED = {"hybrid": ["bm25", "dense"], "hybrid_e5": ["bm25", "dense_e5"]}
#: Conditions on the forms that a query is stated for; only ``rrf_chunks`` is stated for some.
ALL, TWENTIETH = "", "id % 20 = 0"


def _asked(spark: SparkSession, d: str, some: str = ALL) -> DataFrame:
    """query_id (twice the form's id, and one more for its need), query; of all forms, or of those that a condition names."""
    f = load(spark, d, "submissions")
    f = f.where(some) if some else f
    texts = F.explode(F.array(*[F.struct((2 * F.col("id") + n).alias("query_id"), F.col(c).alias("query")) for n, c in enumerate(TEXTS)]))
    return f.select(texts.alias("x")).select("x.*").where(F.trim("query") != "")


def _packed(spark: SparkSession, d: str, terms: list[str], fields: bool) -> DataFrame:
    """The stored blocks of all chunks for these terms, with the words of their fields if they are asked for."""

    def build() -> DataFrame:
        c = spread(corpus_fts(spark, d, "text") if fields else load(spark, d, "chunk_metadata").select("chunk_id", "text"))
        weights = index.FIELD_WEIGHTS if fields else {}
        u = engines.units(c, "chunk_id", "text", list(weights))
        return engines.pack(u, terms, weights)

    name = stored.signature(spark, words.chunk_table(d), kind="engines", terms=terms, weights=index.FIELD_WEIGHTS if fields else {}, dims=vectors.DIMS)
    return stored.kept(spark, f"{name}-packed", build)


def _searched(spark: SparkSession, d: str, methods: dict[str, int], some: str = ALL) -> tuple[DataFrame, DataFrame]:
    """query (a number), chunk_id, score, rank, method: the best chunks of every distinct text, as many as said for each engine; and query_id, query."""
    q = _asked(spark, d, some)
    terms = engines.known_terms(q)
    hits, who = engines.search(_packed(spark, d, terms, "sqlite_fts" in methods), terms, q, methods)
    return hits.withColumnRenamed("key", "chunk_id"), who


def _of_forms(rows: DataFrame, who: DataFrame) -> DataFrame:
    """The rows of a distinct text for every form that has it: query_id in place of query."""
    return rows.join(F.broadcast(who), "query").select("query_id", *(c for c in rows.columns if c != "query"))


def _words(spark: SparkSession, d: str, method: str, k: int) -> DataFrame:
    return _of_forms(*_searched(spark, d, {method: k})).drop("method")


def _dense(spark: SparkSession, d: str, method: str, k: int) -> DataFrame:
    """Nearest chunks that have a token; the prefixes of queries and passages where the model wants them."""
    return _of_forms(*_searched(spark, d, {method: k})).drop("method")


def _titled(spark: SparkSession, d: str) -> DataFrame:
    """chunk_id, title, doc of all chunks."""
    title = fusion.result_title(F.from_json("metadata_json", "map<string,string>"), F.col("source_path"))
    return load(spark, d, "chunk_metadata").select("chunk_id", title.alias("title")).withColumn("doc", t.plain_doc_id(F.col("title")))


def _named(spark: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    """The hits with title and doc."""
    return hits.join(_titled(spark, d), "chunk_id")


def _distinct_runs(spark: SparkSession, d: str, methods: list[str], k: int = K) -> tuple[DataFrame, DataFrame]:
    """query, doc_id, score, rank, method, title: documents of the best ``k`` chunks; fused ones of the best 3k of both engines, k kept; and query_id, query.

    The overfetch comes before the reduction to documents. All rows of a query are
    brought together once, and every step after works within it.
    """
    fused = {m: FUSED[m] for m in methods if m in FUSED}
    names = [m for m in fusion.METHODS if m in methods and m not in fused or any(m in x for x in fused.values())]
    hits, who = _searched(spark, d, dict.fromkeys(names, k * (DEEP if fused else 1)))
    goes = [F.when(F.col("rank") <= k, F.col("method")) if m not in fused else F.when(F.col("method").isin(fused[m]), F.lit(m)) for m in [*fused, ""]]
    # Method and rank go through the shuffles as one number.
    at = F.col("rank") * len(names) + F.array_position(F.array(*map(F.lit, names)), F.col("method")).cast("int") - 1
    moved = _named(spark, d, hits.select("query", "chunk_id", "score", at.alias("at"))).where(F.coalesce("doc", F.lit("")) != "").select("query", "at", "score", "doc", "title").repartition("query")
    known = moved.select("query", F.element_at(F.array(*map(F.lit, names)), (F.col("at") % len(names) + 1).cast("int")).alias("method"), F.floor(F.col("at") / len(names)).cast("int").alias("rank"), "score", "doc", "title")
    to = known.withColumn("target", F.explode(F.array_compact(F.array(*goes)))).where(F.col("target").isin(methods))
    best = to.groupBy("target", "method", "query", F.col("doc").alias("doc_id")).agg(F.max("score").alias("score"), F.min("title").alias("title"))
    listed = evaluation.ranked(best, ["target", "method", "query"])
    single = F.col("target") == F.col("method")
    score = F.round(F.sum(F.when(single, F.col("score")).otherwise(1.0 / (fusion.RRF + F.col("rank")))), 9)
    out = listed.groupBy("target", "query", "doc_id").agg(score.alias("score"), F.min("title").alias("title")).withColumnRenamed("target", "method")
    return evaluation.ranked(out, ["method", "query"]).where(F.col("rank") <= k), who


def _runs(spark: SparkSession, d: str, methods: list[str], k: int = K) -> DataFrame:
    """``_distinct_runs`` with query_id, for every form."""
    return _of_forms(*_distinct_runs(spark, d, methods, k))


def _gold(judged: DataFrame, who: DataFrame) -> DataFrame:
    """query (a number), query_id, doc_id, relevance: what is relevant to each text that is asked."""
    best = judged.where("relevance > 0").groupBy("query_id", "doc_id").agg(F.max("relevance").alias("relevance"))
    return best.join(F.broadcast(who), "query_id")


def _marked(runs: DataFrame, gold: DataFrame) -> DataFrame:
    """The runs with relevance 1 where a document is relevant to any form that asks the text, else null; they stay where their query is."""
    docs = gold.groupBy("query").agg(F.collect_set("doc_id").alias("docs"))
    return runs.join(docs, "query", "left").withColumn("relevance", F.when(F.array_contains("docs", F.col("doc_id")), 1)).drop("docs")


def _relevant(runs: DataFrame, who: DataFrame, judged: DataFrame) -> DataFrame:
    """method, query_id, doc_id, rank, relevance of the relevant documents of ``_distinct_runs``; the others are never multiplied by the forms."""
    gold = _gold(judged, who)
    some = _marked(runs.select("method", "query", "doc_id", "rank"), gold).where("relevance > 0").drop("relevance")
    return some.join(gold, ["query", "doc_id"]).drop("query")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """The qrels of the forms, once for each of their texts."""
    return _qrels(spark, d).withColumn("query_id", F.explode(F.array(2 * F.col("query_id"), 2 * F.col("query_id") + 1)))


def _input(n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, INPUTS)), (n + 1).cast("int")).alias("query_input")


def _told(df: DataFrame) -> DataFrame:
    """The form's id as query_id, and which of its texts was asked."""
    return df.withColumn("query_input", _input(F.col("query_id") % 2)).withColumn("query_id", F.floor(F.col("query_id") / 2))


def _settings(spark: SparkSession, name: str, values: list) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} {'double' if isinstance(values[0], float) else 'string'}")


def grouped_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of every method for both texts of the forms."""
    judged = _judged(spark, d)
    found = _relevant(*_distinct_runs(spark, d, fusion.METHODS), judged)
    s = evaluation.per_query(found, judged, by=["method"], settings=_settings(spark, "method", fusion.METHODS), placed=True)
    return evaluation.summary(_told(s), ["method", "query_input"])


def hit_matrix(spark: SparkSession, d: str) -> DataFrame:
    judged = _judged(spark, d)
    return _told(evaluation.hit_matrix(_relevant(*_distinct_runs(spark, d, fusion.METHODS), judged), judged, fusion.METHODS))


def total_hits(spark: SparkSession, d: str) -> DataFrame:
    runs, who = _distinct_runs(spark, d, fusion.METHODS)
    judged = _judged(spark, d)
    # Every text that found anything counts; only its relevant documents are rows of their own.
    some = _of_forms(runs.select("method", "query").distinct(), who).withColumn("doc_id", F.lit(None).cast("string"))
    r = some.unionByName(_relevant(runs, who, judged).select("method", "query_id", "doc_id")).withColumn("label", F.concat_ws("|", "method", (F.col("query_id") % 2).cast("string")))
    h = evaluation.total_hits(r, judged, "label")
    return h.select(F.split_part("label", F.lit("|"), F.lit(1)).alias("method"), _input(F.split_part("label", F.lit("|"), F.lit(2)).cast("int")), "hits", "queries", "hit_rate")


def weight_sweep(spark: SparkSession, d: str) -> DataFrame:
    """bm25 and dense_e5 searched once, their documents fused for every weight: nDCG@10, RR@100, Recall@20."""
    runs, who = _distinct_runs(spark, d, ["bm25", "dense_e5"], SWEPT)
    judged = _judged(spark, d)
    gold = _gold(judged, who)
    # Equal texts are swept once; what is relevant to any form that asks is kept, and then meets the forms.
    marked = _marked(runs, gold).select(F.col("query").alias("query_id"), "doc_id", "rank", F.when(F.col("method") == "bm25", 1).otherwise(2).alias("side"), "relevance")
    fused = evaluation.weight_sweep_within(marked, k=SWEPT).where("relevance > 0").select("weight", F.col("query_id").alias("query"), "doc_id", "rank")
    found = fused.join(gold, ["query", "doc_id"]).drop("query")
    s = evaluation.per_query(found, judged, k=SWEPT, k_recall=20, by=["weight"], settings=_settings(spark, "weight", evaluation.WEIGHTS), placed=True)
    return evaluation.summary(_told(s), ["weight", "query_input"])


def search_all_methods(spark: SparkSession, d: str) -> DataFrame:
    """The best documents of the four engines, and of both fusions of words and vectors."""
    return _told(_runs(spark, d, fusion.METHODS, TOP)).select("query_id", "query_input", F.col("doc_id").alias("doc"), "rank", "method")


def pool_results(spark: SparkSession, d: str) -> DataFrame:
    runs, who = _distinct_runs(spark, d, fusion.METHODS, TOP)
    pooled = fusion.pool(runs.select("query", F.col("doc_id").alias("doc"), "method", "rank", "title"), "query", "doc")
    return _told(_of_forms(pooled, who))


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """Words and vectors: both engines' best 3k chunks, each reduced to documents, then fused."""
    return _told(_runs(spark, d, ["hybrid"], TOP)).select("query_id", "query_input", F.col("doc_id").alias("doc"), "score", "rank")


def rrf_documents(spark: SparkSession, d: str) -> DataFrame:
    return _told(_runs(spark, d, ["hybrid_e5"], TOP)).select("query_id", "query_input", F.col("doc_id").alias("doc"), "score", "rank")


def rrf_chunks(spark: SparkSession, d: str) -> DataFrame:
    hits, who = _searched(spark, d, dict.fromkeys(["bm25", "dense_e5"], DEEP * TOP), TWENTIETH)
    lists = hits.withColumn("list_no", F.when(F.col("method") == "bm25", 1).otherwise(2)).repartition("query")
    fused = fusion.reciprocal_ranks(lists, ["chunk_id"], F.when(F.col("list_no") == 1, 0.7).otherwise(0.3), TOP, ["query"])
    return _told(_of_forms(fused, who)).select("query_id", "query_input", "chunk_id", "score", "rank")


def eval_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of bm25, dense_e5 and hybrid_e5 for both texts of the forms: six buckets.

    bm25 has its chunks as they are; dense_e5 has the best chunk of each document of
    its best 100; hybrid_e5 fuses the best 3k of both, the dense side reduced so.
    """
    hits, who = _searched(spark, d, {"bm25": DEEP * TOP, "dense_e5": FETCHED})
    dense = F.col("method") == "dense_e5"
    known = hits.join(_titled(spark, d).drop("title"), "chunk_id", "left").withColumn("doc", F.when(dense, F.col("doc"))).where(~dense | (F.col("doc") != ""))
    of = known.select("query", "method", "chunk_id", "score", "rank", "doc").repartition("query")
    # The best chunk of a document is among the best 30 if any of its is. Chunks of bm25 stay as they are, whatever their document.
    best = F.row_number().over(Window.partitionBy("query", "method", F.coalesce("doc", F.col("chunk_id").cast("string"))).orderBy(F.desc("score"), "rank"))
    one = of.withColumn("n", best).where("n = 1").withColumn("new", F.row_number().over(Window.partitionBy("query", "method").orderBy(F.desc("score"), "rank")))
    place = F.when(dense, F.col("new")).otherwise(F.col("rank"))
    goes = F.array_compact(F.array(F.col("method"), F.when(F.col("rank") <= DEEP * TOP, F.lit("hybrid_e5"))))
    to = one.select("query", "chunk_id", "score", place.alias("place"), F.when(dense, 2).otherwise(1).alias("list_no"), F.col("method").alias("of"), F.explode(goes).alias("method"))
    single = F.col("of") == F.col("method")
    fused = to.groupBy("method", "query", "chunk_id").agg(
        F.max(F.when(single, F.col("score"))).alias("own"), F.min(F.when(single, F.col("place"))).alias("place"), F.round(F.sum(1.0 / (fusion.RRF + F.col("place"))), 9).alias("sum"), F.min(F.struct("list_no", "place")).alias("first")
    )
    scored = fused.select("query", "method", "chunk_id", F.coalesce("own", "sum").alias("score"), "place", "first")
    rank = F.row_number().over(Window.partitionBy("method", "query").orderBy("place", F.desc("score"), "first", "chunk_id"))
    out = scored.withColumn("rank", rank).where(F.col("rank") <= TOP)
    return _told(_of_forms(out, who)).select("query_id", "query_input", "method", "chunk_id", "score", "rank")


QUERIES = {f.__name__: f for f in (grouped_metrics, hit_matrix, total_hits, weight_sweep, search_all_methods, pool_results, hybrid_topk, rrf_documents, rrf_chunks, eval_buckets)}

def asked_sql(some: str = ALL) -> str:
    only = f"{some} and " if some else ""
    return f"select 2 * id query_id, query_text q from submissions where {only}trim(query_text, ' ') <> '' union all select 2 * id + 1, information_need from submissions where {only}trim(information_need, ' ') <> ''"


def dense_sql(name: str, k: int, e5: bool, asked: str) -> str:
    q, c = (words.prefixed("q", "query"), words.prefixed("text", "passage")) if e5 else ("q", "text")
    n = f"{name}_"
    unit = "(select id, k, x::double / greatest(sqrt(sum(x::double * x::double) over (partition by id)), 1e-12) u from {} where x is not null)"
    return f"""{words.HASHED.format(n + "q", f"select query_id id, {q} x from ({asked})")}, {words.HASHED.format(n + "v", f"select chunk_id id, {c} x from chunk_metadata where {words.HAS_WORD}")},
{n}d as (select a.id query_id, b.id chunk_id, sum(a.u * b.u) s from {unit.format(n + "q")} a join {unit.format(n + "v")} b using (k) group by 1, 2),
{n}s as (select query_id, chunk_id, round(coalesce(s, 0), 5) + 0.0 score from (select query_id from ({asked})) cross join (select chunk_id from chunk_metadata where {words.HAS_WORD}) left join {n}d using (query_id, chunk_id)),
{name} as (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) rank from {n}s qualify rank <= {k})"""


def hits_sql(k: int, some: str = ALL) -> str:
    asked = asked_sql(some)
    return f"{words.POST}, {words.bm25_sql(asked, k)}, {words.fts_sql(asked, k)}, {dense_sql('dn', k, False, asked)}, {dense_sql('de', k, True, asked)}"


def runs_sql(k: int, deep: int = DEEP) -> str:
    goes = [(m, m, k) for m in fusion.METHODS if m not in FUSED] + [(f, m, k * deep) for f, ms in FUSED.items() for m in ms]
    return f"""{hits_sql(k * deep)}, hits as (select *, 'bm25' as method from (select query_id, chunk_id, score, rank from bm) union all select *, 'sqlite_fts' from fts union all select *, 'dense' from dn union all select *, 'dense_e5' from de),
named as (select chunk_id, {words.TITLE} title, {words._doc_sql(words.TITLE)} doc_id from chunk_metadata),
best as (select target, method, query_id, doc_id, max(score) score, min(title) title from hits join (values {", ".join(map(str, goes))}) g(target, method, most) using (method) join named using (chunk_id) where rank <= most and doc_id <> '' group by 1, 2, 3, 4),
lst as (select *, row_number() over (partition by target, method, query_id order by score desc, doc_id) r from best),
fused as (select target as method, query_id, doc_id, round(sum(case when target = method then score else 1.0::double / (60 + r) end), 9) score, min(title) title from lst group by 1, 2, 3),
runs as (select *, row_number() over (partition by method, query_id order by score desc, doc_id) rank from fused qualify rank <= {k})"""


JUDGED_TWICE = f"{JUDGED}, judged as (select unnest([2 * query_id, 2 * query_id + 1]) query_id, doc_id, relevance from qrels)"
TOLD = "query_id // 2 as query_id, case when query_id % 2 = 0 then 'query' else 'information_need' end as query_input"
_METHODS = f"select unnest({fusion.METHODS}) as method"
_GOLD = "g as (select distinct query_id, doc_id from judged where relevance > 0)"
_ONE = "qualify row_number() over (partition by query_id, doc_id order by score desc, rank) = 1"
_CHUNKS_FUSED = "(select query_id, chunk_id, round(sum(w / (60 + rank)), 9) score, min((l, rank)) fst from {} group by 1, 2)"
_FUSED_RANK = "row_number() over (partition by query_id order by score desc, fst, chunk_id) rank"
ORACLE = {
    "grouped_metrics": f"with {JUDGED_TWICE}, {runs_sql(K)}, {metrics_sql('runs', 'method', qrels='judged', settings=_METHODS)} select method, {TOLD.split(', ', 1)[1]}, {SUMMARY} from sc group by 1, 2",
    "hit_matrix": f"with {JUDGED_TWICE}, {runs_sql(K)}, {_GOLD}, h as (select distinct query_id, method from runs join g using (query_id, doc_id)) select {TOLD}, {', '.join(f"coalesce(max(1) filter (method = '{m}'), 0) as {m}" for m in fusion.METHODS)} from (select distinct query_id from judged) j left join h using (query_id) group by j.query_id",
    "total_hits": f"with {JUDGED_TWICE}, {runs_sql(K)}, {_GOLD}, p as (select method, r.query_id, count(g.doc_id) h from runs r left join g on g.query_id = r.query_id and g.doc_id = r.doc_id group by 1, 2) select method, {TOLD.split(', ', 1)[1]}, sum(h)::bigint as hits, count(*) as queries, round(avg((h > 0)::int), 6) as hit_rate from p group by 1, 2",
    "weight_sweep": f"with {JUDGED_TWICE}, {runs_sql(SWEPT, 1)}, ws as (select unnest(range(11)) / 10.0::double weight), f as (select weight, query_id, doc_id, round(sum((case when method = 'bm25' then weight else 1 - weight end) / (60 + rank)), 9) score from runs, ws where method in ('bm25', 'dense_e5') group by all), {metrics_sql('f', 'weight', SWEPT, 20, 'judged', 'select weight from ws')} select weight, {TOLD.split(', ', 1)[1]}, {SUMMARY} from sc group by 1, 2",
    "search_all_methods": f"with {runs_sql(TOP)} select {TOLD}, doc_id as doc, rank, method from runs",
    "pool_results": f"with {runs_sql(TOP)}, p as (select query_id, doc_id, method, rank, title, list_position({fusion.METHODS}, method) no from runs) select {TOLD}, doc_id as doc, string_agg(method, '|' order by no) as pooled_from, string_agg(method || ':' || rank, '|' order by no) as ranks, count(*) as n_methods, arg_min(title, no) as first_title from p group by query_id, doc_id",
    "hybrid_topk": f"with {runs_sql(TOP)} select {TOLD}, doc_id as doc, score, rank from runs where method = 'hybrid'",
    "rrf_documents": f"with {runs_sql(TOP)} select {TOLD}, doc_id as doc, score, rank from runs where method = 'hybrid_e5'",
    "rrf_chunks": f"with {hits_sql(DEEP * TOP, TWENTIETH)}, a as {_CHUNKS_FUSED.format("(select query_id, chunk_id, rank, 0.7::double w, 1 l from bm union all select query_id, chunk_id, rank, 0.3::double, 2 from de)")}, b as (select *, {_FUSED_RANK} from a qualify rank <= {TOP}) select {TOLD}, chunk_id, score, rank from b",
    "eval_buckets": f"""with {hits_sql(FETCHED)}, named as (select chunk_id, {words._doc_sql(words.TITLE)} doc_id from chunk_metadata),
o as (select * from de join named using (chunk_id) where doc_id <> '' {_ONE}), o3 as (select * from de join named using (chunk_id) where doc_id <> '' and rank <= {DEEP * TOP} {_ONE}),
r as (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, rank) rank from o), r3 as (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, rank) rank from o3),
h as {_CHUNKS_FUSED.format(f"(select query_id, chunk_id, rank, 1.0::double w, 1 l from bm where rank <= {DEEP * TOP} union all select query_id, chunk_id, rank, 1.0::double, 2 from r3)")},
x as (select query_id, 'bm25' as method, chunk_id, score, rank from bm union all select query_id, 'dense_e5', chunk_id, score, rank from r union all select query_id, 'hybrid_e5', chunk_id, score, {_FUSED_RANK} from h)
select {TOLD}, method, chunk_id, score, rank from x where rank <= {TOP}""",
}
