"""Searches by all engines over packed blocks: the lists of the engines one by one, whatever the sizes of blocks and groups."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from fathom.functions import text as t
from fathom.operators import engines, evaluation, fusion, index, vectors
from fathom.plans import engine_queries

ROWS = [(1, "Vård och vård", "a"), (2, None, "vård"), (3, "passage: och rutin", ""), (4, "rutin rutin prov", "rutin"), (5, "...", "x"), (6, "vård och vård", None), (7, "och", "och"), (8, "prov och vård i rutin", "prov")] + [(10 + n, f"ord{n % 7} och rutin{n % 3} vård" * (1 + n % 2), f"ord{n % 5}") for n in range(60)]
ASKED = [(1, "vård och"), (2, "och vård"), (3, "vård och"), (4, "query: rutin rutin"), (5, "saknas"), (6, "?"), (7, "ord1 och rutin2 vård prov"), (8, "rutin rutin ord3")]


@pytest.mark.parametrize("small", [False, True])
def test_lists_are_those_of_the_single_engines(spark, monkeypatch, small):
    if small:
        for name, x in (("TEXTS", 16), ("FIRST", 4), ("GROUP", 2), ("PART", 20), ("TILE", 5), ("ASKED", 2), ("COMMON", 4)):
            monkeypatch.setattr(engines, name, x)
    df = spark.createDataFrame(ROWS, "key long, text string, title string").repartition(3)
    q = spark.createDataFrame(ASKED, "query_id long, query string")
    terms = engines.known_terms(q)
    assert terms == sorted({w for _, x in ASKED for w in x.lower().replace(":", "").replace("?", "").split()})
    weights = {"title": 5.0, "text": 1.0}
    packed = engines.pack(engines.units(df, "key", "text", list(weights)), terms, weights)
    methods = {"bm25": 5, "sqlite_fts": 4, "dense": 6, "dense_e5": 5}
    hits, who = engines.search(packed, terms, q, methods)
    numbers = {r.query_id: r["query"] for r in who.collect()}
    assert len(numbers) == 8 and numbers[1] == numbers[3] and len(set(numbers.values())) == 7
    got = {m: sorted((r.query_id, r["rank"], r.key, r.score) for r in engine_queries._of_forms(hits, who).where(F.col("method") == m).collect()) for m in methods}

    want_terms = index.query_terms(q, "query_id", "query")
    bm = index.bm25(want_terms, index.term_postings(df, "key", "text", want_terms), index.corpus_stats(index.lengths(df, "key", "text")), "key", "query_id", 5)
    fields = list(weights)
    fts = index.weighted_fields(want_terms, index.field_postings(df, "key", fields, want_terms), index.corpus_stats(index.field_lengths(df, "key", fields)), "key", "query_id", 4, weights)
    has = df.where(F.size(t.tokens(F.col("text"))) > 0)
    dense = vectors.search(vectors.embed(q, "query_id", "query"), vectors.index_rows(has, "key", "text", "swedish_bert"), 6, key="key")
    e5 = vectors.search(vectors.embed(q.withColumn("query", vectors.with_prefix(F.col("query"), "query: ")), "query_id", "query"), vectors.index_rows(has, "key", "text"), 5, key="key")
    for m, x in zip(methods, (bm, fts, dense, e5)):
        assert got[m] == sorted((r.query_id, r["rank"], r.key, r.score) for r in x.collect()), m


def test_no_text_or_no_query(spark):
    df, q = spark.createDataFrame([], "key long, text string"), spark.createDataFrame(ASKED, "query_id long, query string")
    methods = dict.fromkeys(engines.WORDS[:1] + engines.DENSE, 3)
    packed = engines.pack(engines.units(df, "key", "text"), ["vård"], {})
    assert engines.search(packed, engines.known_terms(q), q, methods)[0].count() == 0
    hits, who = engines.search(packed, [], q.where("false"), methods)
    assert hits.count() == 0 and who.count() == 0


@pytest.mark.parametrize("name", ["pool_results", "search_all_methods", "total_hits", "hit_matrix", "grouped_metrics", "weight_sweep", "rrf_chunks", "rrf_documents", "hybrid_topk", "eval_buckets"])
def test_no_score_of_a_pair_is_joined(spark, name):
    """No query meets texts or postings in a join or a product; only the titles of hits, few settings and query numbers are looked up."""
    plan = engine_queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(c in plan for c in ("avgdl", "qtf", "v_numbers", "q_numbers"))
    assert set(fusion.METHODS) == {*engines.WORDS, *engines.DENSE, *engine_queries.FUSED}


def test_weights_are_swept_without_a_join_of_what_they_make(spark):
    """The same scores and metrics as by the sweep of two runs, and relevance known before the weights are met."""
    runs = spark.createDataFrame([(q, f"d{(q * n) % 7}", s, n) for q in (1, 2, 3) for s in (1, 2) for n in range(1, 4 + s)], "query_id long, doc_id string, side int, rank int").dropDuplicates(["query_id", "doc_id", "side"])
    qrels = spark.createDataFrame([(1, "d1", 2), (1, "d3", 1), (2, "d4", 1), (4, "d1", 1)], "query_id long, doc_id string, relevance int")
    one = evaluation.weight_sweep(runs.where("side = 1"), runs.where("side = 2"), k=4)
    two = evaluation.weight_sweep_within(evaluation.with_relevance(runs, qrels), k=4)
    assert sorted(map(tuple, one.select("weight", "query_id", "doc_id", "score", "rank").collect())) == sorted(map(tuple, two.select("weight", "query_id", "doc_id", "score", "rank").collect()))
    told = lambda x: sorted(map(tuple, evaluation.per_query(x, qrels, by=["weight"]).collect()), key=str)
    assert told(one) == told(two)
