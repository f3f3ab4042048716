import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from fathom.functions import text as t
from fathom.operators import batch, fusion, index, stored, vectors
from fathom.plans import engine_queries
from fathom.plans.text_queries import corpus_fts
from fathom.tables import load

D = SMALL.replace("0.001", "0.01")


@pytest.mark.parametrize("method", ["bm25", "sqlite_fts"])
def test_batch_and_stored_index_agree(spark, method, monkeypatch):
    """Scores of the texts where they are read, of the stored index, and of an index made for these terms."""
    monkeypatch.setattr(batch, "HELD", 200)
    c = load(spark, D, "chunk_metadata").select(F.col("chunk_id").alias("key"), F.lit("d").alias("doc"), "text", F.lit(False).alias("title"), F.lit(0).alias("part"))
    c = c if method == "bm25" else c.join(corpus_fts(spark, D).withColumnRenamed("chunk_id", "key"), "key")
    q = engine_queries._asked(spark, D)
    got = batch.lists(c, q, 10, formula=batch.FIELDS if method == "sqlite_fts" else batch.BM25)[0]
    rows = sorted((r.query_id, r["rank"], r.key, round(r.score, 5)) for r in got.collect())
    assert rows and rows == sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 5)) for r in engine_queries._words(spark, D, method, 10).collect())
    terms = index.query_terms(q, "query_id", "query")
    if method == "bm25":
        own = index.bm25(terms, index.term_postings(c, "key", "text", terms), index.corpus_stats(index.lengths(c, "key", "text")), "key", "query_id", 10)
    else:
        fields = list(index.FIELD_WEIGHTS)
        own = index.weighted_fields(terms, index.field_postings(c, "key", fields, terms), index.corpus_stats(index.field_lengths(c, "key", fields)), "key", "query_id", 10)
    assert rows == sorted((r.query_id, r["rank"], r.key, round(r.score, 5)) for r in own.collect())


def test_an_index_is_built_once_and_anew_when_its_source_changes(spark, tmp_path, monkeypatch):
    source = str(tmp_path / "chunks")
    spark.createDataFrame([(1, "vård och vård"), (2, None), (3, " ")], "chunk_id long, text string").write.parquet(source)
    first = stored.bm25_index(spark, source, "chunk_id", "text")
    assert {(r.term, r.chunk_id, r.f, r.dl) for r in first.postings.collect()} == {("vård", 1, 2.0, 3), ("och", 1, 1.0, 3)}
    assert first.stats.collect() == [(1, 3.0)] and {(r.term, r.df) for r in first.terms.collect()} == {("vård", 1), ("och", 1)}
    fields = stored.fields_index(spark, source, "chunk_id", lambda: spark.read.parquet(source).withColumn("a", F.lit("vård")), {"text": 1.0, "a": 5.0})
    assert {(r.term, r.chunk_id, r.f) for r in fields.postings.collect()} == {("vård", 1, 7.0), ("och", 1, 1.0), ("vård", 2, 5.0), ("vård", 3, 5.0)} and fields.stats.first().n == 3
    made = []
    monkeypatch.setattr(t, "tokens", lambda c, old=t.tokens: made.append(1) or old(c))
    assert stored.bm25_index(spark, source, "chunk_id", "text").stats.first().n == 1 and not made
    spark.createDataFrame([(4, "nytt")], "chunk_id long, text string").write.mode("append").parquet(source)
    assert stored.bm25_index(spark, source, "chunk_id", "text").stats.first().n == 2
    spark.createDataFrame([], "chunk_id long, text string").write.mode("overwrite").parquet(source)
    empty = stored.bm25_index(spark, source, "chunk_id", "text")
    assert empty.postings.count() == 0 and empty.stats.first().n == 0


def test_one_of_two_builders_wins(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "shared_folder", lambda spark: f"file:{tmp_path}")
    inner = lambda: stored.kept(spark, "x", lambda: spark.range(3))

    def outer():
        inner()  # another builder is done in the meantime
        return spark.range(5)

    assert stored.kept(spark, "x", outer).count() == 3 and inner().count() == 3
    assert [p.name for p in (tmp_path / "fathom-index").iterdir() if p.is_dir()] == ["x"]


def test_searches_read_no_text(spark):
    plan = engine_queries._words(spark, D, "bm25", 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "chunk_metadata" not in plan and plan.count("-postings") <= 1


def test_vectors_by_blocks(spark, monkeypatch):
    """Blocks, parts of products and lists handed on before the end change nothing; ties go by key, also many."""
    rows = [(k, [float((k * 7 + j * j) % 5) - 2 for j in range(3)]) for k in range(300)]
    v = spark.createDataFrame(rows + [(1000, None), (1001, [1.0, 2.0]), (1002, [0.0, 0.0, 0.0])], "vec_id long, embedding array<double>").repartition(5)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    want = {}
    data = {r.vec_id: r.embedding for r in v.collect() if r.embedding}
    unit = lambda x: [y / max(sum(z * z for z in x) ** 0.5, 1e-12) for y in x]
    for a in [r.query_id for r in q.collect() if r.query_id in data]:
        scored = sorted((-round(sum(x * y for x, y in zip(unit(data[a]), unit(data[b]))), 5) + 0.0, b) for b in data if len(data[b]) == len(data[a]))
        want[a] = [(b, n) for n, (_, b) in enumerate(scored[:7], 1)]
    for limit in ("10MB", "-1"):  # a side is broadcast; none is
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        for sizes in ((vectors.BLOCK_BYTES, vectors.PRODUCT, vectors.HELD), (100, 10, 30)):
            for name, x in zip(("BLOCK_BYTES", "PRODUCT", "HELD"), sizes):
                monkeypatch.setattr(vectors, name, x)
            got = {}
            for r in vectors.search(q, v, 7).orderBy("query_id", "rank").collect():
                got.setdefault(r.query_id, []).append((r.vec_id, r["rank"]))
            assert got == want
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert vectors.search(q, v, 0).count() == 0


def test_views(spark, monkeypatch):
    rows = [(0, "a", "A", False, "b x"), (0, "b", "A", True, "a"), (0, "c", "B", False, "a b"), (1, "d", "B", False, "b a a"), (1, "e", None, False, None)]
    units = spark.createDataFrame(rows, "part int, key string, doc string, title boolean, text string")
    q = spark.createDataFrame([(1, "b a"), (2, "B A"), (3, "saknas"), (4, None)], "query_id long, query string")
    got, size = batch.lists(units, q, 2, [(0, 0, True), (1, 0, False), (2, 1, True)])
    assert size == {0: 3, 1: 2, 2: 2}
    rows = got.orderBy("view", "query_id", "rank").collect()
    monkeypatch.setattr(batch, "BLOCK", 1)
    apart, same = batch.lists(units, q, 2, [(0, 0, True), (1, 0, False), (2, 1, True)])
    assert sorted(map(tuple, apart.collect())) == sorted(map(tuple, rows)) and same == size
    assert [(r.view, r.key) for r in rows if r.query_id == 1] == [(0, "c"), (0, "b"), (1, "c"), (1, "a"), (2, "d")]
    assert [r[2:] for r in rows if r.query_id == 1] == [r[2:] for r in rows if r.query_id == 2]
    for view, where in ((0, "part = 0"), (1, "part = 0 and not title"), (2, "part = 1")):
        u, terms = units.where(where), index.query_terms(q, "query_id", "query")
        want = index.bm25(terms, index.term_postings(u, "key", "text", terms), index.corpus_stats(index.lengths(u, "key", "text")), "key", "query_id", 2)
        assert sorted((r.query_id, r.key, r.score) for r in want.collect()) == sorted((r.query_id, r.key, r.score) for r in rows if r.view == view)


def test_no_form_loses_its_hits(spark):
    """bm25 is searched for every form, also those whose id is divisible by 3, and dense is not its reversal."""
    r = engine_queries._runs(spark, D, fusion.METHODS)
    forms = {(x.method, x.form) for x in r.select("method", F.floor(F.col("query_id") / 2).alias("form")).distinct().collect()}
    assert {m for m, _ in forms} == set(fusion.METHODS) and any(m == "bm25" and f % 3 == 0 for m, f in forms)
    lists = {m: [x.doc_id for x in r.where(F.col("method") == m).orderBy("query_id", "rank").collect()] for m in ("bm25", "dense")}
    assert set(lists["bm25"]) != set(lists["dense"])


def test_every_method_has_its_metrics(spark):
    got = {(r.method, r.query_input): r for r in engine_queries.grouped_metrics(spark, D).collect()}
    assert set(got) == {(m, i) for m in fusion.METHODS for i in engine_queries.INPUTS} and len({r.n_queries for r in got.values()}) == 1
    assert max(r.rr for r in got.values()) > 0
    assert engine_queries.weight_sweep(spark, D).count() == 22


def test_dense_lists_and_all_buckets(spark):
    got = engine_queries.eval_buckets(spark, SMALL).groupBy("method", "query_input").agg(F.max("rank").alias("n")).collect()
    assert {(r.method, r.query_input) for r in got} == {(m, i) for m in ("bm25", "dense_e5", "hybrid_e5") for i in engine_queries.INPUTS} and max(r.n for r in got) == 10
    assert {r.method for r in engine_queries.search_all_methods(spark, SMALL).select("method").distinct().collect()} == set(fusion.METHODS)
    near = {(r.query_id, r.chunk_id) for r in engine_queries._dense(spark, SMALL, "dense_e5", 10).collect()}
    fused = {(2 * r.query_id + (r.query_input != "query"), r.chunk_id) for r in engine_queries.rrf_chunks(spark, SMALL).collect()}
    assert near & fused
