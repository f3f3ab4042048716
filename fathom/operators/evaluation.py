"""Evaluation of rankings: judgements (qrels), runs, and the metrics over them.

A run has query_id, doc_id, score; qrels have query_id, doc_id, relevance and
optionally query_type. Metrics average over the queries of the qrels; a query
without results counts as 0. Ties in a run go by doc_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import text as t
from fathom.functions.numbering import dense_number

PLACES = 6
#: The weights of a weight sweep: the share of the first engine.
WEIGHTS = [round(i / 10, 1) for i in range(11)]


def unpivot_sheet(sheet: DataFrame, gold: str, types: list[str]) -> DataFrame:
    """query_type, query_id, doc_id, relevance 1 of a sheet with a column per query type; the query is its own id.

    Blank queries and rows whose gold title is empty in normal form are dropped;
    the same query and document within a type count once.
    """
    long = sheet.unpivot([gold], types, "query_type", "query_id")
    out = long.select("query_type", t.squeeze(F.col("query_id")).alias("query_id"), t.plain_doc_id(F.col(gold)).alias("doc_id"), F.lit(1).alias("relevance"))
    return out.where((F.coalesce("query_id", F.lit("")) != "") & (F.col("doc_id") != "")).distinct()


def clean_qrels(rows: DataFrame, keep_zero: bool = False, normalise: bool = False) -> DataFrame:
    """query, information_need, doc_id, relevance: trimmed, blanks dropped, distinct; relevance missing means 1."""
    doc = t.plain_doc_id(F.col("doc_id")) if normalise else F.trim("doc_id")
    out = rows.select(F.trim("query").alias("query"), F.trim("information_need").alias("information_need"), doc.alias("doc_id"), F.coalesce("relevance", F.lit(1)).alias("relevance"))
    out = out.where((F.col("query") != "") & (F.col("information_need") != "") & (F.col("doc_id") != ""))
    return (out if keep_zero else out.where("relevance > 0")).distinct()


def numbered_queries(rows: DataFrame, text: str, order: str, prefix: str) -> DataFrame:
    """text, query_id: ids like query_01 by first appearance. The distinct queries are numbered, not the rows."""
    first = rows.groupBy(text).agg(F.min(order).alias("_first"))
    n = (F.col("_n") + 1).cast("string")
    padded = F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n)
    return dense_number(first, ["_first", text], "_n").select(text, F.concat(F.lit(prefix), padded).alias("query_id"))


def run_table(hits: DataFrame, query_id: str = "query_id", doc: str = "doc_id", score: str = "score") -> DataFrame:
    """query_id, doc_id, score: one row per query and document, the highest score; empty ids are dropped."""
    known = hits.where(F.coalesce(F.col(doc).cast("string"), F.lit("")) != "")
    return known.groupBy(F.col(query_id).alias("query_id"), F.col(doc).alias("doc_id")).agg(F.max(score).alias("score"))


def ranked(run: DataFrame, by: list[str]) -> DataFrame:
    return run.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id")))


def per_query(run: DataFrame, qrels: DataFrame, k: int = 20, k_ndcg: int = 10, k_recall: int = 10, by: list[str] | None = None, settings: DataFrame | None = None, placed: bool = False) -> DataFrame:
    """by, query_id, first_rank, rr, ndcg, recall of every query of the qrels (for each value of ``by`` in ``settings``, else in the run).

    A run with relevance (see ``with_relevance``) is not joined with the qrels. One that
    is ``placed`` has its relevant documents only, with the ranks they have among all.
    """
    by = by or []
    keys = [*by, "query_id"]
    gold = qrels.groupBy("query_id", "doc_id").agg(F.max("relevance").alias("relevance")).where("relevance > 0")
    ideal = gold.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc_id")))
    best = ideal.groupBy("query_id").agg(F.sum(F.when(F.col("_n") <= k_ndcg, F.col("relevance") / F.log2(F.col("_n") + 1))).alias("ideal"), F.count(F.lit(1)).alias("all"))
    queries = qrels.select("query_id").distinct()
    if by:
        queries = queries.crossJoin(F.broadcast(run.select(*by).distinct() if settings is None else settings.select(*by)))  # methods or settings, a few
    found = run if placed else ranked(run, keys)
    found = found.where("relevance > 0") if "relevance" in run.columns else found.join(gold, ["query_id", "doc_id"])
    r = F.col("rank")
    got = found.groupBy(*keys).agg(
        F.min(F.when(r <= k, r)).alias("first_rank"), F.sum(F.when(r <= k_ndcg, F.col("relevance") / F.log2(r + 1))).alias("dcg"), F.sum(F.when(r <= k_recall, 1).otherwise(0)).alias("hits")
    )
    out = queries.join(got, keys, "left").join(best, "query_id", "left")
    zero = F.lit(0.0)
    return out.select(*keys, "first_rank", F.coalesce(1 / F.col("first_rank"), zero).alias("rr"), F.coalesce(F.col("dcg") / F.col("ideal"), zero).alias("ndcg"), F.coalesce(F.col("hits") / F.col("all"), zero).alias("recall"))


def summary(scores: DataFrame, by: list[str]) -> DataFrame:
    """by, n_queries, rr, ndcg, recall, average_rank (over queries with a hit, 0 if none has)."""
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("rr"), PLACES).alias("rr"), F.round(F.avg("ndcg"), PLACES).alias("ndcg"), F.round(F.avg("recall"), PLACES).alias("recall"), F.round(F.coalesce(F.avg("first_rank"), F.lit(0.0)), PLACES).alias("average_rank")
    )


def macro(by_type: DataFrame) -> DataFrame:
    """The unweighted mean over query types, and the number of queries in all: one row."""
    return by_type.agg(*(F.round(F.avg(c), PLACES).alias(c) for c in ("rr", "ndcg", "recall", "average_rank")), F.sum("n_queries").alias("num_queries_total"), F.count(F.lit(1)).alias("num_query_types"))


def weight_sweep(first: DataFrame, second: DataFrame, weights: list[float] | None = None, k: int = 100, const: int = 60) -> DataFrame:
    """weight, query_id, doc_id, score: both runs (with ranks) fused once for every weight of the first."""
    spark = first.sparkSession
    grid = spark.createDataFrame([(w,) for w in weights or WEIGHTS], "weight double")
    both = first.select("query_id", "doc_id", "rank", F.lit(1).alias("side")).unionByName(second.select("query_id", "doc_id", "rank", F.lit(2).alias("side")))
    w = F.when(F.col("side") == 1, F.col("weight")).otherwise(1 - F.col("weight"))
    fused = both.crossJoin(F.broadcast(grid)).groupBy("weight", "query_id", "doc_id").agg(F.round(F.sum(w / (const + F.col("rank"))), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("weight", "query_id").orderBy(F.desc("score"), "doc_id"))
    return fused.withColumn("rank", rank).where(F.col("rank") <= k)


def with_relevance(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run with the relevance of its documents, null for others."""
    gold = qrels.groupBy("query_id", "doc_id").agg(F.max("relevance").alias("relevance")).where("relevance > 0")
    return run.join(gold, ["query_id", "doc_id"], "left")


def weight_sweep_within(both: DataFrame, weights: list[float] | None = None, k: int = 100, const: int = 60) -> DataFrame:
    """weight, query_id, doc_id, score, rank, relevance: as ``weight_sweep``, without a shuffle of the rows that the weights make.

    ``both`` has query_id, doc_id, rank, side (1 or 2) and relevance, each document
    at most once a side. Rows come together by query before they meet the weights.
    """
    ranks = [F.min(F.when(F.col("side") == n, F.col("rank"))).alias(f"r{n}") for n in (1, 2)]
    docs = both.repartition("query_id").groupBy("query_id", "doc_id").agg(*ranks, F.max("relevance").alias("relevance"))
    grid = F.explode(F.array(*map(F.lit, weights or WEIGHTS))).alias("weight")
    part = lambda w, r: F.coalesce(w / (const + F.col(r)), F.lit(0.0))
    score = F.round(part(F.col("weight"), "r1") + part(1 - F.col("weight"), "r2"), 9).alias("score")
    fused = docs.select("query_id", "doc_id", "r1", "r2", "relevance", grid).select("weight", "query_id", "doc_id", score, "relevance")
    rank = F.row_number().over(Window.partitionBy("weight", "query_id").orderBy(F.desc("score"), "doc_id"))
    return fused.withColumn("rank", rank).where(F.col("rank") <= k)


def quantile_bins(df: DataFrame, x: str, y: str, bins: int = 5) -> DataFrame:
    """bin (int, from 1), n, mean_x, mean_y: bins between the quantiles of x, closed on the right, equal edges merged.

    Equal values share a bin. Null x are left out; an empty table has no bin.
    """
    edges = df.agg(F.array_distinct(F.percentile(F.col(x), F.array(*[F.lit(i / bins) for i in range(bins + 1)]))).alias("edges"))
    placed = df.where(F.col(x).isNotNull()).crossJoin(F.broadcast(edges)).withColumn("bin", F.greatest(F.lit(1), F.size(F.filter("edges", lambda e: e < F.col(x)))))
    return placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(x), PLACES).alias("mean_x"), F.round(F.avg(y), PLACES).alias("mean_y"))


def latest(df: DataFrame, group: str, time: str) -> DataFrame:
    """All rows of the latest time of each group; rows without a time are no candidates."""
    last = df.groupBy(group).agg(F.max(time).alias(time))
    return df.join(last, [group, time])


def relevant_sets(qrels: DataFrame) -> DataFrame:
    """query_type, query_id, docs (joined by "|"), n: the distinct relevant documents of each query."""
    docs = F.array_sort(F.collect_set(F.when(F.col("relevance") > 0, F.col("doc_id"))))
    return qrels.groupBy("query_type", "query_id").agg(docs.alias("x")).select("query_type", "query_id", F.array_join("x", "|").alias("docs"), F.size("x").alias("n"))


def hit_matrix(runs: DataFrame, qrels: DataFrame, methods: list[str]) -> DataFrame:
    """query_id and a column per method: 1 if it found any relevant document, else 0."""
    gold = qrels.where("relevance > 0").select("query_id", "doc_id").distinct()
    hits = runs.join(gold, ["query_id", "doc_id"], "left_semi").groupBy("query_id").pivot("method", methods).agg(F.lit(1))
    return qrels.select("query_id").distinct().join(hits, "query_id", "left").select("query_id", *(F.coalesce(F.col(f"`{m}`"), F.lit(0)).alias(m) for m in methods))


def total_hits(runs: DataFrame, qrels: DataFrame, label: str) -> DataFrame:
    """label, hits, queries, hit_rate: distinct relevant documents found, and the share of queries with any."""
    gold = qrels.where("relevance > 0").select("query_id", "doc_id").distinct()
    found = runs.select(label, "query_id", "doc_id").distinct().join(gold.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    per = found.groupBy(label, "query_id").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("h"))
    return per.groupBy(label).agg(F.sum("h").alias("hits"), F.count(F.lit(1)).alias("queries"), F.round(F.avg((F.col("h") > 0).cast("double")), PLACES).alias("hit_rate"))


def run_label(parts: list[Column]) -> Column:
    """The parts that are not blank, joined by " | "."""
    return F.concat_ws(" | ", *(F.nullif(F.trim(p.cast("string")), F.lit("")) for p in parts))


def short_model(name: Column) -> Column:
    return F.regexp_extract(name, r"([^/]*)$", 1)


def method_order(methods: DataFrame, column: str, preferred: list[str]) -> DataFrame:
    """column, position: preferred methods first in their order, the others by name."""
    at = F.array_position(F.array(*map(F.lit, preferred)), F.col(column))
    order = [F.when(at > 0, at).otherwise(len(preferred) + 1), F.col(column)]
    return methods.where(F.col(column).isNotNull()).select(column).distinct().withColumn("position", F.row_number().over(Window.orderBy(*order)))


def first_of_equal(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """The first row, in the order given, of those that agree in the columns; nulls agree."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*columns).orderBy(*order))).where("_n = 1").drop("_n")


def grid(spark, **values: list) -> DataFrame:
    """All combinations of some lists of settings, a column each."""
    frames = [spark.createDataFrame([(v,) for v in vs], [name]) for name, vs in values.items()]
    return reduce(lambda a, b: a.crossJoin(b), frames)
