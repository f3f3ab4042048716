import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathom.llm import bpe, packing

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary here")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_containers(sizes):
    boxes = packing.SumOfSquares(64)
    level = {}
    for s in sizes:
        box, at = boxes.place(s)
        assert level.get(box, 0) == at
        level[box] = at + s
        assert level[box] <= 64
    assert sum(level.values()) == sum(sizes)
    assert [int(n) for n in boxes.levels[1:64]] == [sum(v == h for v in level.values()) for h in range(1, 64)]


def test_packing_is_whole(spark):
    df = spark.createDataFrame([(k, "ord " * (k * 37 % 900)) for k in range(1, 120)] + [(500, None), (501, ""), (502, "a b " * 4000)], "doc_id long, text string")
    rows = packing.pack_documents(df).collect()
    want = {r.doc_id: r.n_tokens for r in bpe.token_counts(df, "doc_id", "text").collect() if r.n_tokens}
    by_doc, by_box = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_box.setdefault(r.container, []).append(r)
    assert {k: sum(r.n_tokens for r in v) for k, v in by_doc.items()} == want
    assert all(sum(r.n_tokens for r in v) <= packing.CAPACITY for v in by_box.values())
    assert all(len(v) == 1 for k, v in by_doc.items() if want[k] <= packing.CAPACITY)
    for v in by_box.values():  # pieces lie one behind the other
        at = 0
        for r in sorted(v, key=lambda r: r.at):
            assert r.at == at
            at += r.n_tokens
    report = packing.fill_report(packing.pack_documents(df)).first()
    assert report.tokens == sum(want.values()) and report.containers == len(by_box)
    empty = packing.fill_report(packing.pack_documents(df.limit(0))).first()
    assert (empty.containers, empty.tokens, empty.used_share) == (0, 0, None)


def test_pieces():
    assert packing.pieces(5000, 2048) == [2048, 2048, 904] and packing.pieces(4096, 2048) == [2048, 2048] and packing.pieces(0, 2048) == []


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_fill_does_not_hang_on_parts(spark, parts):
    """Open containers of all tasks are packed together, so many small tasks waste little."""
    df = spark.createDataFrame([(k, "ord " * (k * 37 % 1500)) for k in range(1, 1200)], "doc_id long, text string").repartition(parts)
    assert packing.fill_report(packing.pack_documents(df)).first().used_share > 0.985
    assert packing.fill_report(packing.pack_documents(df, lookahead=1)).first().used_share > 0.9


def test_arrow_batches_change_nothing(spark):
    df = spark.createDataFrame([(k, "ord " * (k * 37 % 900)) for k in range(1, 300)], "doc_id long, text string").repartition(2, "doc_id").sortWithinPartitions("doc_id")
    rows = lambda: sorted(map(tuple, packing.pack_documents(df, lookahead=40).collect()))
    want = rows()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert rows() == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_nulls_repeats_and_other_columns(spark):
    df = spark.createDataFrame([(None, "ord ord", 1), (1, "ord", 2), (1, "ord", 3)], "doc_id long, text string, container int")
    rows = packing.pack_documents(df).collect()
    assert sorted((r.doc_id or 0, r.piece) for r in rows) == [(0, 0), (1, 0), (1, 0)] and len({r.container for r in rows}) == 1
    with pytest.raises(ValueError):
        packing.pack_documents(df, lookahead=0)
