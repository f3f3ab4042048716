import pytest
from conftest import SMALL

from fathom.functions import config
from fathom.operators import schema_drift
from fathom.plans import search


@pytest.fixture(scope="module")
def tables(spark):
    chunks = spark.createDataFrame([(1, "rutin för läkemedel"), (2, "läkemedel i skåpet"), (3, "annat"), (4, None)], "chunk_id long, text string")
    return chunks, spark.createDataFrame([(1, "läkemedel rutin"), (2, " "), (3, "saknas")], "query_id long, query string")


@pytest.mark.parametrize("method", ["bm25", "sqlite_fts", "vector", "vector_e5", "hybrid", "hybrid_e5"])
def test_methods(tables, method):
    got = [(r.query_id, r.chunk_id) for r in search.search(*tables, method, 2).orderBy("query_id", "rank").collect()]
    assert [c for q, c in got if q == 1] == [1, 2] and not [q for q, _ in got if q == 2]


def test_all_default_and_unknown(tables):
    assert {r.method for r in search.search(*tables, "all", 2).collect()} == set(search.METHODS)
    assert {r.method for r in search.search(*tables).collect()} == {"bm25"}
    assert search.search(*tables, "bm25", 0).count() == 0
    with pytest.raises(ValueError):
        search.search(*tables, "nothing")


def test_default_and_errors(tables):
    assert {r.method for r in search.default_search(*tables).collect()} == {"hybrid"}
    runs, errors = search.search_each(*tables, ["bm25", "nothing"], 2)
    assert {r.method for r in runs.collect()} == {"bm25"} and list(errors) == ["nothing"]
    with pytest.raises(ValueError, match="no such method"):
        search.search_each(*tables, ["nothing"])


def test_settings():
    assert config.text_source("text") == "text"
    with pytest.raises(ValueError):
        config.text_source("raw_text")
    assert config.parse_list(" 1, 2,,3 ", int) == [1, 2, 3] and config.parse_bool(" Y ") and not config.parse_bool("off")
    for bad in (lambda: config.parse_list(" , "), lambda: config.parse_bool("kanske"), lambda: config.flat_settings(["a b=1"]), lambda: config.flat_settings(["a=1", "a=2"])):
        with pytest.raises(ValueError):
            bad()
    assert config.flat_settings(["a=1", "b=1.5", "c=True", "d=x=y"]) == {"a": 1, "b": 1.5, "c": True, "d": "x=y"}
    assert [p.slug for p in config.sweep("250,500", "0", "on,off")] == ["cs-250_ov-0_title-on", "cs-250_ov-0_title-off", "cs-500_ov-0_title-on", "cs-500_ov-0_title-off"]


def test_strict_reading(spark):
    df = spark.createDataFrame([(0, 1, "rank,method"), (0, 2, "1,a,b")], "file_id long, line_no int, line string")
    fields = [("rank", "double"), ("method", "string")]
    assert schema_drift.ingest(df, fields).count() == 1
    with pytest.raises(Exception, match="3 cells under a header of 2"):
        schema_drift.ingest(df, fields, strict=True).collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
    assert e.queries()["value_counts"](spark, SMALL).count() > 0
