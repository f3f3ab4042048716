import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from fathom.operators import evaluation, fusion, index
from fathom.functions import text as t
from fathom.plans import evaluation_queries as e
from fathom.plans.text_queries import _stored, corpus_bm25

D = SMALL.replace("0.001", "0.01")
METRICS = ["rr", "ndcg", "recall", "average_rank"]


def test_sweep_scores_every_setting(spark):
    got = {(r["size"], r.overlap, r.titles): r for r in e.sweep_grid(spark, D).collect()}
    assert len(got) == 18 and {r.n_queries for r in got.values()} == {e._qrels(spark, D).where("query_id % 20 = 0").select("query_id").distinct().count()}
    # One setting by the index itself.
    c = corpus_bm25(spark, D).withColumn("key", F.concat_ws("#", "source_path", "section_index", "unit", "chunk_index")).persist()
    q = e.load(spark, D, "submissions").where("id % 20 = 0").select(F.col("id").alias("query_id"), "query_text")
    terms = index.query_terms(q, "query_id", "query_text")
    hits = index.bm25(terms, index.term_postings(c, "key", "text", terms), index.corpus_stats(index.lengths(c, "key", "text")), "key", "query_id", 20)
    docs = _stored(spark, D)[0]
    named = docs.select("source_path", t.plain_doc_id(fusion.result_title(F.create_map(F.lit("title"), F.col("title")), F.col("source_path"))).alias("doc_id"))
    run = evaluation.run_table(hits.join(c.select("key", "source_path"), "key").join(named, "source_path"))
    want = evaluation.summary(evaluation.per_query(run, e._qrels(spark, D).where("query_id % 20 = 0")), []).first()
    assert [got[500, 50, True][m] for m in METRICS] == [want[m] for m in METRICS] and got[500, 50, True].n_chunks == c.count()


@pytest.mark.parametrize("query, settings", [(e.chunking_compare, {"chunked", "per_section"}), (e.segmentation_compare, {"whole", "cascade", "toc_or_whole"})])
def test_settings_are_compared_by_metrics(spark, query, settings):
    got = {(r.setting, r.query_input): r for r in query(spark, D).collect()}
    assert set(got) == {(s, q) for s in settings for q in e.TEXTS}
    assert all(0 <= r[m] for r in got.values() for m in METRICS) and len({r.n_queries for r in got.values()}) == 1


def test_sections_are_chunked(spark):
    """A document as one section makes more texts than its title, its heading and itself."""
    n = e.load(spark, D, "documents").where("trim(text) <> ''").count()
    assert {r.setting: r.n_chunks for r in e.segmentation_compare(spark, D).collect()}["whole"] > 3 * n
