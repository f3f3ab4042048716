"""One entry for all search methods.

A method is a function of chunks, queries and k that gives a run: query_id,
chunk_id, score, rank. ``register`` adds one; ``search`` runs one by name, or all
of them together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.operators import fusion, index, vectors

Method = Callable[[DataFrame, DataFrame, int], DataFrame]
DEFAULT, DEFAULT_K = "bm25", 5
METHODS: dict[str, Method] = {}


def register(name: str) -> Callable[[Method], Method]:
    def put(f: Method) -> Method:
        METHODS[name] = f
        return f

    return put


@register("bm25")
def bm25(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    terms = index.query_terms(queries, "query_id", "query")
    return index.bm25(terms, index.term_postings(chunks, "chunk_id", "text", terms), index.corpus_stats(index.lengths(chunks, "chunk_id", "text")), "chunk_id", "query_id", k)


@register("sqlite_fts")
def weighted(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Weighted fields; a chunk without title_text and metadata_text has its text as body only."""
    fields = list(index.FIELD_WEIGHTS)
    made = {"title_text": F.lit(""), "body_text": F.col("text"), "metadata_text": F.lit("")}
    c = chunks.select("chunk_id", *((F.col(f) if f in chunks.columns else made[f]).alias(f) for f in fields))
    terms = index.query_terms(queries, "query_id", "query")
    return index.weighted_fields(terms, index.field_postings(c, "chunk_id", fields, terms), index.corpus_stats(index.field_lengths(c, "chunk_id", fields)), "chunk_id", "query_id", k)


def _dense(chunks: DataFrame, queries: DataFrame, k: int, model: str) -> DataFrame:
    """Nearest embeddings; those of the chunks are made here unless they have a column ``embedding``."""
    c = chunks if "embedding" in chunks.columns else vectors.index_rows(chunks, "chunk_id", "text", model)
    q = queries.withColumn("query", vectors.with_prefix(F.col("query"), "query: ")) if vectors.needs_prefix(model) else queries
    return vectors.search(vectors.embed(q, "query_id", "query"), c.select("chunk_id", "embedding"), k, key="chunk_id")


@register("vector")
def dense(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return _dense(chunks, queries, k, "swedish_bert")


@register("vector_e5")
def dense_e5(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return _dense(chunks, queries, k, "e5_large_instruct")


def _fused(chunks: DataFrame, queries: DataFrame, k: int, near: Method, weight: float) -> DataFrame:
    """The best 3k of words and of vectors, fused by reciprocal rank."""
    lists = bm25(chunks, queries, 3 * k).withColumn("list_no", F.lit(1)).unionByName(near(chunks, queries, 3 * k).withColumn("list_no", F.lit(2)))
    w = F.when(F.col("list_no") == 1, 2 * weight).otherwise(2 * (1 - weight))
    return fusion.reciprocal_ranks(lists, ["chunk_id"], w, k, ["query_id"])


@register("hybrid")
def hybrid(chunks: DataFrame, queries: DataFrame, k: int, weight: float = 0.5) -> DataFrame:
    return _fused(chunks, queries, k, dense, weight)


@register("hybrid_e5")
def hybrid_e5(chunks: DataFrame, queries: DataFrame, k: int, weight: float = 0.5) -> DataFrame:
    return _fused(chunks, queries, k, dense_e5, weight)


def search(chunks: DataFrame, queries: DataFrame, method: str = DEFAULT, k: int = DEFAULT_K) -> DataFrame:
    """query_id, chunk_id, score, rank, method. ``method`` "all" runs every method; an unknown one is an error.

    ``chunks`` has chunk_id and text, ``queries`` query_id and query. Blank queries
    and k of 0 or less have no rows.
    """
    names = list(METHODS) if method == "all" else [method]
    unknown = [n for n in names if n not in METHODS]
    if unknown:
        raise ValueError(f"no such method: {unknown[0]}; there are {', '.join(METHODS)} and all")
    asked = queries.where(F.trim("query") != "").select("query_id", "query")
    runs = [METHODS[n](chunks, asked, k).select("query_id", "chunk_id", "score", "rank").withColumn("method", F.lit(n)) for n in names]
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out.where(F.col("rank") <= k)


def default_search(chunks: DataFrame, queries: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """The search of an evaluation that names no method: words and vectors."""
    return search(chunks, queries, "hybrid", k)


def search_each(chunks: DataFrame, queries: DataFrame, methods: list[str] | None = None, k: int = DEFAULT_K) -> tuple[DataFrame | None, dict[str, str]]:
    """The runs of the methods that can be planned, and what is wrong with the others; an error only if none can."""
    runs, errors = None, {}
    for m in methods or list(METHODS):
        try:
            one = search(chunks, queries, m, k)
        except Exception as e:  # noqa: BLE001
            errors[m] = str(e)
            continue
        runs = one if runs is None else runs.unionByName(one)
    if runs is None and errors:
        raise ValueError("; ".join(f"{m}: {e}" for m, e in errors.items()))
    return runs, errors
