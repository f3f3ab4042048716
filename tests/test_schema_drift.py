import json

import pytest

from fathom.operators import schema_drift as s

FIELDS = [("rank", "double"), ("method", "string"), ("top_k", "int"), ("flag", "boolean"), ("at", "timestamp")]


def lines(spark, *files):
    rows = [(f, n, x) for f, xs in enumerate(files) for n, x in enumerate(xs, 1)]
    return spark.createDataFrame(rows, "file_id long, line_no int, line string")


def changes(spark, *files):
    return sorted((r.file_id, r.line_no, r.change, r.field) for r in s.drift(lines(spark, *files), FIELDS).collect())


def test_no_change(spark):
    assert changes(spark, ["﻿rank, \"method\",top_k,flag,at", "1.5,bm25,10,True,2024-01-02T03:04:05+01:00", "", None]) == []


def test_added_removed_renamed(spark):
    got = changes(spark, ["rank,metod,k,extra;", "1,a,2,x"])
    assert got == [(0, 1, "added", "extra;"), (0, 1, "removed", "at"), (0, 1, "removed", "flag"), (0, 1, "renamed", "method"), (0, 1, "renamed", "top_k")]


def test_retyped(spark):
    got = changes(spark, ["rank;method;top_k;flag;at", '"2,5 plats";7;topp 10;ja;1710031256', '"2,6 plats";8;;nej;'])
    assert got == [(0, 1, "retyped", f) for f in ("at", "flag", "method", "rank", "top_k")]
    assert changes(spark, ["rank;method;top_k;flag;at", '1;"[""a""]";1;true;2024-01-01', "x;[];1;true;2024-01-01"]) == [(0, 1, "retyped", "method")]
    assert changes(spark, ["rank;method;top_k;flag;at", ";;;;"]) == []


def test_rows_of_an_earlier_header(spark):
    got = changes(spark, ["rank,method,top_k,flag,at", "1,a,1,true,2024-01-01", "rank,method,top_k,flag", "x,a,1,true", "2,b,3,false,2024-01-01", "y,a,1,true"])
    assert got == [(0, 3, "removed", "at"), (0, 3, "retyped", "rank")]


def test_ingest_and_promote(spark):
    files = ["rank,method,top_k,extra", "1.5,bm25,topp 20,7", "oops,a,3,x,more"]
    rows = {r.line_no: r for r in s.ingest(lines(spark, files), FIELDS).collect()}
    assert rows[2].rank == 1.5 and rows[2].top_k is None and rows[2].flag is None
    assert json.loads(rows[2].rescued) == {"unknown": {"extra": "7"}, "uncast": {"top_k": "topp 20"}}
    assert json.loads(rows[3].rescued)["extra"] == ["more"]
    late = {r.line_no: r for r in s.promote(s.ingest(lines(spark, files), FIELDS), FIELDS, [("extra", "int")]).collect()}
    assert late[2].top_k == 20 and late[2].extra == 7 and late[3].extra is None


def test_empty(spark):
    assert s.drift(lines(spark, [None]), FIELDS).count() == 0
    assert s.ingest(lines(spark, ["only,data,1"]), FIELDS).count() == 0


@pytest.mark.parametrize("name, field", [("mthd", "method"), ("Method", "method"), ("topK", "top_k"), ("method_version", None), ("meth", "method")])
def test_names(name, field):
    assert s.Names([f for f, _ in FIELDS]).resolve([name]) == [field]


def test_exact_name_goes_first():
    assert s.Names(["method"]).resolve(["engine", "method"]) == [None, "method"]


def test_no_value_ends_the_job(spark):
    long, deep = "x" * 200_000, "[" * 100_000
    got = s.ingest(lines(spark, ["rank,method,top_k,flag,at", f"1,{long},{long},true,2024-01-01", f"2,{deep},3,{deep},", "3,a\rb,4,\0,\r"]), FIELDS).orderBy("line_no").collect()
    assert got[0].method == long and json.loads(got[0].rescued) == {"uncast": {"top_k": long}}
    assert got[1].method == deep and json.loads(got[1].rescued) == {"uncast": {"flag": deep}} and got[2].method == "a b" and got[2].top_k == 4
    assert changes(spark, ["rank,method,top_k,flag,at", f"1,{deep},3,true,2024-01-01"]) == []
