import pytest
from pyspark.sql import functions as F

from fathom.operators import analytics, evaluation, judgements


def scores(spark, run, qrels, **k):
    r = spark.createDataFrame(run, "query_id string, doc_id string, score double")
    q = spark.createDataFrame(qrels, "query_id string, doc_id string, relevance int")
    return evaluation.per_query(r, q, **k)


def listed(query, doc, place, n=30):
    return [(query, doc if k == place else f"{query}{k:02d}", 1.0 / k) for k in range(1, n + 1)]


def test_hit_and_miss(spark):
    s = scores(spark, listed("a", "gold", 4), [("a", "gold", 1), ("b", "gold", 1)])
    r = evaluation.summary(s, []).first()
    assert (r.rr, r.average_rank, r.n_queries) == (0.125, 4.0, 2)


def test_outside_k_and_ranks(spark):
    r = evaluation.summary(scores(spark, listed("a", "gold", 25), [("a", "gold", 1)]), []).first()
    assert (r.rr, r.average_rank) == (0.0, 0.0)
    r = evaluation.summary(scores(spark, listed("a", "g", 1) + listed("b", "g", 5), [("a", "g", 1), ("b", "g", 1)]), []).first()
    assert r.average_rank == 3.0


def test_types_and_macro(spark):
    run = listed("a", "g", 1) + listed("b", "g", 3) + listed("c", "g", 5)
    s = scores(spark, run, [(q, "g", 1) for q in "abcd"]).withColumn("query_type", F.when(F.col("query_id").isin("a", "b"), "x").otherwise("y"))
    by = {r.query_type: r for r in evaluation.summary(s, ["query_type"]).collect()}
    assert by["x"].rr == pytest.approx((1 + 1 / 3) / 2, abs=1e-6) and by["y"].rr == 0.1 and (by["x"].average_rank, by["y"].average_rank) == (2, 5)
    m = evaluation.macro(evaluation.summary(s, ["query_type"])).first()
    assert m.rr == pytest.approx(((1 + 1 / 3) / 2 + 0.1) / 2, abs=1e-6) and m.average_rank == 3.5 and m.num_queries_total == 4


def test_graded_ndcg_recall(spark):
    run = [("q", d, s) for d, s in (("a", 3.0), ("b", 2.0), ("c", 1.0), ("z", 1.0))]
    r = scores(spark, run, [("q", "a", 1), ("q", "c", 2), ("q", "x", 0), ("q", "y", 1)]).first()
    import math

    ideal = 2 + 1 / math.log2(3) + 1 / 2
    assert r.ndcg == pytest.approx((1 + 2 / math.log2(4)) / ideal) and r.recall == pytest.approx(2 / 3) and r.first_rank == 1


def test_empty_run(spark):
    r = evaluation.summary(scores(spark, [], [("a", "g", 1)]), []).first()
    assert (r.rr, r.ndcg, r.recall, r.average_rank) == (0, 0, 0, 0)
    hits = spark.createDataFrame([], "query_id string, doc_id string, score double")
    assert evaluation.run_table(hits).columns == ["query_id", "doc_id", "score"] and evaluation.run_table(hits).count() == 0


def test_bins(spark):
    df = spark.createDataFrame([(x, float(x)) for x in (1, 1, 1, 2, 3, 9)] + [(None, 1.0)], "x int, y double")
    assert sorted((r.bin, r.n) for r in evaluation.quantile_bins(df, "x", "y").collect()) == [(1, 4), (2, 1), (3, 1)]
    assert evaluation.quantile_bins(df.limit(0), "x", "y").count() == 0


def test_labels_orders_firsts(spark):
    df = spark.createDataFrame([("b", 2, "x"), ("a", 1, "x"), ("zz", 3, None), (None, 4, None)], "m string, n int, g string")
    assert [(r.m, r.position) for r in evaluation.method_order(df, "m", ["zz"]).orderBy("position").collect()] == [("zz", 1), ("a", 2), ("b", 3)]
    assert sorted(r.n for r in evaluation.first_of_equal(df, ["g"], ["n"]).collect()) == [1, 3]
    assert [r[0] for r in df.orderBy("n").select(evaluation.run_label([F.col("m"), F.col("g")])).collect()] == ["a | x", "b | x", "zz", ""]
    assert {r.n for r in evaluation.latest(df, "g", "n").collect()} == {2}


PAYLOAD = '{"query": "q", "results": [{"title": "Rutin B.pdf", "assessment": {"rating": "relevant", "comment": " k "}}, {"metadata": {"title": ""}, "source_path": "docs/Rutin C.docx", "assessment": {"rating": "not_relevant"}}, {"title": " "}]}'


def test_judgements(spark):
    rows = [(1, "t", "p", "behov", "fråga", "", PAYLOAD), (2, "t", None, "Test", "q2", None, PAYLOAD[:60]), (3, "t", "p", "x", "q3", "", None), (4, "t", "p", "x", "q4", "", '{"query": "q4", "results": []}')]
    df = spark.createDataFrame(rows, "id long, created_at string, participant_name string, information_need string, query_text string, general_comment string, payload_json string")
    forms = judgements.parsed(df)
    assert sorted(r.id for r in forms.collect()) == [1, 4]
    assert [tuple(r) for r in judgements.to_qrels(forms).collect()] == [(1, "q", "rutin b", 1)]
    assert sorted((r.doc_id, r.relevance) for r in judgements.to_qrels(forms, True).collect()) == [("docs/rutin c", 0), ("rutin b", 1)]
    a = {r.id: r for r in judgements.audit(forms).collect()}
    assert (a[1].num_results, a[1].num_relevant, a[1].num_non_relevant, a[1].num_unrated, a[1].looks_like_test) == (3, 1, 1, 1, False) and a[4].num_results == 0
    assert [(r.result_index, r.document_title, r.assessment_comment) for r in judgements.relevant_chunks(forms).collect()] == [(1, "Rutin B.pdf", "k")]
    assert sorted(r.id for r in judgements.excluding(df, df.where("id = 2")).collect()) == [1, 3, 4]


def test_analytics(spark):
    df = spark.createDataFrame([("2024-1-5", 1, "a, b,,a"), ("2024-13-40", 2, None), (" ", 3, " "), (None, 10, "b"), ("20240105", None, "b")], "d string, n int, v string")
    assert [str(r[0]) for r in df.select(analytics.lenient_date(F.col("d"))).collect()] == ["2024-01-05", "None", "None", "None", "None"]
    assert analytics.percentiles(df, "n", [0.1]).first().p10 == 1.3
    assert {(r.value, r.n) for r in analytics.multivalue_counts(df, ["v"]).collect()} == {("a", 2), ("b", 3)}
    cover = analytics.field_coverage(df, ["v"]).first()
    assert (cover.n_docs, cover.percent, cover.n_values) == (3, 60.0, 2)
    assert [(r.low, r.n) for r in analytics.step_histogram(spark.createDataFrame([(0.2,), (0.5,), (1.0,), (-1.0,), (None,)], "x double"), "x", 0.5).orderBy("low").collect()] == [(0.0, 1), (0.5, 2)]
    assert sorted((r.bin, r.n) for r in analytics.equal_width(df, "n", 3).collect()) == [(1, 3), (3, 1)]
    filled = {r.value: r.n for r in analytics.zero_filled(df, "n", 0, 3).collect()}
    assert filled == {0: 0, 1: 1, 2: 1, 3: 1, None: 1}
    empty = df.limit(0)
    assert analytics.length_stats(empty, "n").first().n == 0 and analytics.step_histogram(empty, "n", 0.5).count() == 0 and analytics.equal_width(empty, "n", 3).count() == 0
    again = spark.createDataFrame([("s", 1, 5), ("s", 2, None), ("t", 3, None)], "stem string, id int, p int")
    assert {r.id for r in analytics.latest_records(again, "stem", ["id"]).collect()} == {2, 3}
    assert {r.id: r.p for r in analytics.backfill(again, again.select("stem", "p"), "stem", "p").collect()} == {1: 5, 2: 5, 3: None}
