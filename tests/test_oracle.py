"""Every query that has SQL gives the rows of its SQL, on the smallest tables."""

import csv
import html
import json
import pathlib
import re
from collections import Counter

import oracle
import pandas as pd
import pytest
from conftest import SMALL

from fathom.operators import fusion, schema_drift
from fathom.plans import registry


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows(spark, con, name):
    got = registry.QUERIES[name](spark, SMALL).toPandas()
    assert oracle.difference(got, con.execute(registry.ORACLE[name]).df()) == ""


def read_by_hand(spark):
    """file_id, line_no and the cells under their columns of all data rows, file by file, one line after another."""
    fields = [f for f, _ in registry.target_fields(spark, SMALL)]
    names = schema_drift.Names(fields)
    lines = pd.read_parquet(f"{SMALL}/evaluation_summary.parquet").sort_values(["file_id", "line_no"])
    for i, of in lines.groupby("file_id"):
        heads = []
        for n, s in zip(of.line_no, of.line):
            if not isinstance(s, str) or not s.strip(schema_drift.BLANKS):
                continue
            if got := schema_drift.is_header(s, names, n == 1):
                heads.append(got)
            elif heads:
                rows = [(h, next(csv.reader([s.strip("\ufeff\r\n")], delimiter=h[0]))) for h in reversed(heads)]
                (_, columns), cells = next((x for x in rows if len(x[1]) == len(x[0][1])), rows[0])
                yield i, n, dict(zip(columns, [c.strip(schema_drift.BLANKS) for c in cells])), of.source_file.iloc[0]


def test_appended_csv(spark):
    want = {(i, n): cells for i, n, cells, _ in read_by_hand(spark)}
    got = {(r.file_id, r.line_no): r for r in registry.QUERIES["appended_csv"](spark, SMALL).collect()}
    assert set(got) == set(want) and len(got) > 20
    for k, cells in want.items():
        assert got[k].method == (cells.get("method") or None) if "method" in cells else True
        kept = json.loads(got[k].rescued or "{}")
        assert set(kept.get("unknown", {}).values()) <= set(cells.values()) and set(kept.get("uncast", {}).values()) <= set(cells.values())
    table = {(r.file_id, r.line_no): r for r in registry.QUERIES["p3_table"](spark, SMALL).collect()}
    assert set(table) == set(want)
    for k, cells in want.items():
        for c in ("notes", "qrels_path", "method_version"):
            if c in cells and c in table[k]:
                assert table[k][c] == (cells[c] or None)
    runs = {(r.file_id, r.line_no): (r.source_kind, r.method) for r in registry.QUERIES["collect_runs"](spark, SMALL).collect()}
    assert runs == {(i, n): (re.search("results/([^/]+)/", f)[1] if "results/" in f else "", got[i, n].method) for i, n, _, f in read_by_hand(spark)}


def test_changes_of_headers(spark):
    """Added, renamed and removed columns against the header lines as they are; a retyped field is none of those removed."""
    fields = [f for f, _ in registry.target_fields(spark, SMALL)]
    got = {(r.file_id, r.line_no, r.change, r.field) for r in registry.QUERIES["p3_found"](spark, SMALL).collect()}
    lines = pd.read_parquet(f"{SMALL}/evaluation_summary.parquet")
    names, heads = schema_drift.Names(fields), {}
    for i, n, s in zip(lines.file_id, lines.line_no, lines.line):
        if h := schema_drift.is_header(s if isinstance(s, str) else None, names, n == 1):
            heads[i, n] = h[1]
    assert {(i, n) for i, n, _, _ in got} <= set(heads)
    for k, columns in heads.items():
        change = {c: {f for i, n, x, f in got if (i, n) == k and x == c} for c in ("added", "removed", "renamed", "retyped")}
        assert change["added"] <= set(columns) - set(fields) and change["renamed"] | change["retyped"] <= set(fields) - change["removed"]
        assert change["removed"] == set(fields) - set(columns) - change["renamed"] and len(set(columns) - {""}) == len(change["added"]) + len(set(fields) - change["removed"])


def test_packed_values(spark):
    rows = registry.QUERIES["p2_found"](spark, SMALL).collect()
    meta = pd.read_parquet(f"{SMALL}/metadata.parquet").set_index("record_id")
    by = {}
    for r in rows:
        by.setdefault((r.record_id, r.field), []).append((r.position, r.value))
    letters = lambda x: re.sub(r"[\W_]", "", html.unescape(x)).casefold()
    for (i, f), got in by.items():
        assert sorted(p for p, _ in got) == list(range(1, len(got) + 1))
        # Nothing is lost but delimiters, quotes and blanks, and the order stays.
        assert "".join(letters(v) for _, v in sorted(got)) == letters(meta.loc[i, f])
    counts = {(r.field, r.value): (r.n, r.n_first) for r in registry.QUERIES["p2_value_counts"](spark, SMALL).collect()}
    want = Counter((r.field, r.value) for r in rows)
    first = Counter((r.field, r.value) for r in rows if r.position == 1)
    assert counts == {k: (n, first[k]) for k, n in want.items()}


def test_seeded_shuffle(spark):
    lists = {}
    for r in registry.QUERIES["bm25_batch"](spark, SMALL).orderBy("query_id", "rank").collect():
        lists.setdefault(str(r.query_id), []).append(r.chunk_id)
    got = {}
    for r in sorted(registry.QUERIES["seeded_shuffle"](spark, SMALL).collect(), key=lambda r: r.position):
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got and got == {q: fusion.shuffled(xs, f"{q}:run-1") for q, xs in lists.items()}


def test_signatures(spark):
    files = [p.stat() for p in pathlib.Path(SMALL).glob("*.parquet")]
    r = registry.QUERIES["dir_signature"](spark, SMALL).first()
    assert (r.n_files, r.n_bytes) == (len(files), sum(f.st_size for f in files)) and abs(r.last_modified.timestamp() - max(f.st_mtime for f in files)) < 24 * 3600
    one = registry.QUERIES["index_signature"](spark, SMALL).first().signature
    assert re.fullmatch("[0-9a-f]{64}", one) and one != registry.QUERIES["index_signature"](spark, SMALL.replace("0.001", "0.01")).first().signature


def test_every_query_is_tested():
    """A query without SQL has an expectation above."""
    assert set(registry.QUERIES) - set(registry.ORACLE) == {"appended_csv", "p3_table", "collect_runs", "p3_found", "p2_found", "p2_value_counts", "seeded_shuffle", "dir_signature", "index_signature"}
