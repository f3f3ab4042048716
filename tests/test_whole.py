"""No form is left out: the queries over all engines take every form of the table, and their metrics are over all of them."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from fathom.plans import engine_queries
from fathom.plans.evaluation_queries import _qrels
from fathom.tables import load


@pytest.fixture(scope="module")
def asked(spark):
    """The form and which of its texts, of all that are not blank."""
    f = load(spark, SMALL, "submissions")
    return {(r.id, n) for n, c in zip(engine_queries.INPUTS, engine_queries.TEXTS) for r in f.where(F.trim(c) != "").select("id").collect()}


@pytest.mark.parametrize("name", ["eval_buckets", "hybrid_topk", "pool_results", "rrf_documents", "search_all_methods"])
def test_every_form_has_its_list(spark, asked, name):
    got = {(r.query_id, r.query_input) for r in engine_queries.QUERIES[name](spark, SMALL).select("query_id", "query_input").distinct().collect()}
    assert len(asked) > 60 and got == asked
    assert " % 20" not in engine_queries.ORACLE[name]


@pytest.fixture(scope="module")
def judged(spark):
    """The forms that have a judgement."""
    return {r.query_id for r in _qrels(spark, SMALL).select("query_id").distinct().collect()}


@pytest.mark.parametrize("name", ["grouped_metrics", "weight_sweep"])
def test_metrics_are_over_every_form(spark, judged, name):
    got = {r.n_queries for r in engine_queries.QUERIES[name](spark, SMALL).collect()}
    assert len(judged) > 20 and got == {len(judged)}
    assert " % 20" not in engine_queries.ORACLE[name]


def test_hits_are_of_every_form(spark, judged):
    got = sorted((r.query_id, r.query_input) for r in engine_queries.hit_matrix(spark, SMALL).select("query_id", "query_input").collect())
    assert got == sorted((i, n) for i in judged for n in engine_queries.INPUTS)
    assert " % 20" not in engine_queries.ORACLE["hit_matrix"]


def test_total_hits_count_every_form(spark, asked):
    got = {(r.method, r.query_input): r.queries for r in engine_queries.total_hits(spark, SMALL).collect()}
    assert all(got["dense", n] == sum(x == n for _, x in asked) for n in engine_queries.INPUTS)
    assert " % 20" not in engine_queries.ORACLE["total_hits"]
