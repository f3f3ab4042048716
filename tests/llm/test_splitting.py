import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathom.llm.splitting import paragraphs, split, split_texts, unavoidable_cuts

TEXT = st.lists(st.sampled_from(["ord", "längre", "mening.", "Ja!", " ", "  ", "\n", "\n\n", "\r\n", "\r\n\r\n", "\f", "\xa0", "x" * 40, "é" * 7, "2.1 Rubrik", "🩺"]), max_size=160).map("".join)


def brute_paragraphs(s):
    out, now, at = [], None, 0
    for line in re.split(r"(\r\n|\n|\r|\f)", s):
        if line and line not in ("\r\n", "\n", "\r", "\f"):
            if line.strip():
                a, b = at + len(line) - len(line.lstrip()), at + len(line.rstrip())
                now = (now[0], b) if now else (a, b)
            elif now:
                out.append(now)
                now = None
        elif line == "" and now and at and s[at - 1 : at] in "\r\n\f" and s[at : at + 1] in ("\r", "\n", "\f"):
            out.append(now)
            now = None
        at += len(line)
    return out + ([now] if now else [])


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_paragraphs(s):
    assert paragraphs(s) == brute_paragraphs(s)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(30, 120), st.integers(0, 25))
def test_pieces(s, limit, overlap):
    got = split(s, limit, overlap)
    if not s.strip():
        assert got == []
        return
    for a, b in zip(got, got[1:]):
        assert a.end <= b.core or not s[b.core : a.end].strip() or a.end == b.core
        assert not s[a.end : b.core].strip(), "no visible character is lost"
        assert a.start <= b.start <= b.core and b.start >= a.core or b.start >= a.start
        if overlap and a.end - overlap >= a.start and b.end - (a.end - overlap) <= limit:
            assert a.end - b.start >= overlap
    assert all(0 < p.end - p.start <= limit for p in got)
    assert not s[: got[0].core].strip() and not s[got[-1].end :].strip()
    # Two paragraphs that fit a piece each, but not one together, are cut between.
    most, ps, cuts = limit - overlap, paragraphs(s), {p.core for p in got[1:]}
    for x, y in zip(ps, ps[1:]):
        if x[1] - x[0] <= most and y[1] - y[0] <= most and y[1] - x[0] > limit:
            assert y[0] in cuts


def test_natural_boundaries():
    s = "Första meningen är här. Andra meningen följer. " * 20
    got = split(s)
    assert all(s[p.core - 2 : p.core] == ". " for p in got[1:]) and all(p.level == "sentence" for p in got[1:])
    assert [p.level for p in split("x" * 1200)] == ["", "character", "character"]
    assert split("kort") == [(0, 0, 4, "", 0, 0, 0)] and split(None) == [] and split(" \n ") == []


def test_frame(spark):
    long = ("a" * 300 + "\n\n") * 3
    df = spark.createDataFrame([(1, long, "h", "clash"), (2, None, None, "x"), (3, "  ", "h", None), (1, long, "h", "y")], "chunk_id long, t string, section_heading string, text string")
    rows = split_texts(df, "chunk_id", {"f": F.col("t")}, keep=["section_heading"]).collect()
    assert len(rows) == 6 and {r.section_heading for r in rows} == {"h"} and all(len(r.text) <= 500 for r in rows)
    assert sorted(r.cut_at for r in unavoidable_cuts(split_texts(df, "chunk_id", {"f": F.col("t")}, with_text=False), "chunk_id").collect()) == [302, 302, 604, 604]
    assert split_texts(df.limit(0), "chunk_id", {"f": F.col("t")}).count() == 0
