import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathom.functions import text as t
from fathom.functions import urls
from fathom.operators import chunking, sections


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("x, want", [("1. Syfte", True), ("MÅL", True), ("Mål Och Medel", True), ("Vi går", True), ("5 mg", True), ("det här är text", False), ("Slut.", False), ("Sidan 3 av 4", False), ("ab", False), ("Version: 2 AB", False), ("(Barn) Läkemedel", False), ('"Mål" Och Medel', True), ('"Mål Medel', False), ("2Mål Medel", False), ("Mål 2 Medel", True)])
def test_heading(spark, x, want):
    assert one(spark, t.is_heading, x) is want


def test_level_tokens_slug_dates(spark):
    assert one(spark, t.heading_level, "1.2.3 A") == 3 and one(spark, t.heading_level, "A") == 1
    assert one(spark, t.tokens, "Café Ärende-12") == ["caf", "ärende", "12"]
    assert one(spark, t.unicode_tokens, "Café") == ["café"]
    assert one(spark, t.slug, " Å b/C ") == "b-c" and one(spark, t.slug, None) == "run"
    assert one(spark, t.approved_date, "Godkänt den: 2024-01-02") == "2024-01-02" and one(spark, t.approved_date, "x") is None
    assert one(spark, t.squeeze, " a\xa0\x1cb\n") == "a b"


@pytest.mark.parametrize("x, want", [(" Rutin–A.PDF ", "rutin-a"), ("Straße.docx", "strasse"), ("a.json", "a.json"), ("ＡＢ  c", "ab c"), (None, "")])
def test_doc_id(spark, x, want):
    assert t.doc_id(x) == want
    assert one(spark, t.normal_doc_id, x) == want


def test_urls(spark):
    assert urls.document_name("https://x/getdocument?id=1&file=A%20b.pdf") == "A b.pdf"
    assert urls.document_name("https://x/getdocument?id=1") == "" and urls.document_name("https://x/a%20b.pdf") == "a b.pdf" and urls.document_name(None) == ""
    assert urls.set_page("https://x/s?q=1&page=3#t", 7) == one(spark, lambda c: urls.with_page(c, F.lit(7)), "https://x/s?q=1&page=3#t") == "https://x/s?q=1&page=7"
    assert one(spark, lambda c: urls.with_page(c, F.lit(1)), "https://x/s") == "https://x/s?page=1"
    assert one(spark, urls.sanitized_query, "a?b (å)-c") == "a b å -c"


CONTENTS = "Titel\nInnehåll\n1 Syfte ....... 1\n  1.1 Mål ....... 2\n      Djupt ... 2\nAnsvar ..... 3\n\nInledning\n1 Syfte\ntext ett\n1.1 Mål\n5 mg\n1+0+0\nDjupt\nAnsvar\nslut"


def of(df, *columns):
    by = {}
    for r in sorted(df.collect(), key=lambda r: (r.doc_id, r["index"] if "index" in r else r.source_index)):
        by.setdefault(r.doc_id, []).append(tuple(r[c] for c in columns))
    return by


DOCS = "doc_id long, text string, title string"


def test_contents(spark):
    before = CONTENTS.replace("Inledning", "ALLMÄNT OM\nnågot")
    apart = "x\nContents\nEn lång\n\nrubrik ... 1\n\nlös\n\nAndra\ndelen ..... 2\nSidan 2 av 3\nPage ... 9\n\nEn lång rubrik\nkropp"
    docs = spark.createDataFrame([(1, CONTENTS, "Titel"), (2, before, "Titel"), (3, "a\nb", None), (4, "Innehåll\nEn ... 1", None), (5, apart, None), (6, None, None), (7, "Innehåll\n" + "ord " * 25 + "... 1\nA ... 2\nB ... 3\nA\nB", None)], DOCS)
    entries = of(sections.toc_entries(docs, "doc_id", "text"), "heading", "level", "page")
    assert entries[1] == [("1 Syfte", 1, 1), ("1.1 Mål", 2, 2), ("Djupt", 2, 2), ("Ansvar", 1, 3)]
    # Before the first entry a blank line cuts nothing off, later it does; a heading of too many words is none.
    assert entries[5] == [("En lång rubrik", 1, 1), ("Andra delen", 1, 2), ("Page", 1, 9)] and entries[7] == [("A", 1, 2), ("B", 1, 3)] and set(entries) == {1, 2, 5, 7}
    got = of(sections.document_sections(docs, "doc_id", "text", "title", "toc_or_whole"), "source", "heading", "text", "path_text")
    assert [s[0] for s in got[1]] == ["toc"] * 4
    assert [s[2] for s in got[1]] == ["text ett", "5 mg 1+0+0", "", "slut"]
    assert got[1][1][3] == "1 Syfte > 1.1 Mål"
    assert got[2][0][:3] == ("toc_preface", "Titel", "ALLMÄNT OM något")
    assert got[3] == [("whole_document", "Document", "a b", "Document")] and got[5][0][0] == "whole_document" and 6 not in got


def test_cascade(spark):
    docs = spark.createDataFrame([(1, CONTENTS, "Titel"), (2, "MÅL\nrad ett\nrad två\nANSVAR\nx\nSLUT", None), (3, "bara text här", "T"), (4, None, "T"), (5, " ", "T"), (6, "BARA\nRUBRIKER", "T")], DOCS)
    by = of(sections.document_sections(docs, "doc_id", "text", "title"), "heading", "source", "raw_text")
    assert by[2] == [("MÅL", "heuristic", "rad ett\nrad två"), ("ANSVAR", "heuristic", "x")] and by[3] == [("T", "heuristic", "bara text här")] and 4 not in by and 5 not in by
    assert [x[1] for x in by[1]] == ["toc"] * 4 and by[6] == [("T", "fallback", "BARA\nRUBRIKER")]
    h = sections.heuristic_sections(docs, "doc_id", "text", "title")
    assert {(r.doc_id, r.heading, r.raw_text) for r in h.where("doc_id in (2, 3)").collect()} == {(k, a, c) for k in (2, 3) for a, _, c in by[k]}


def test_parsed_sections(spark):
    from fathom.sources.documents import SECTION

    s = lambda **x: {"index": None, "heading": None, "title": None, "level": None, "page": None, "source": None, "raw_text": None, "text": None, "path": None, "path_text": None} | x
    rows = [
        (1, [s(heading=" A  b ", level=2, page=3, text=" x ", path=["P", "A b"], path_text="P > A b", source="toc")], "t", "T"),
        (2, [s(title="1.1 C", level=-1, page=0, raw_text="r  s", path=["Q"]), None, s(text="y")], "t", "T"),
        (3, [], "MÅL\nz", "T"), (4, None, None, "T"),
    ]
    df = spark.createDataFrame(rows, f"doc_id long, sections array<{SECTION}>, text string, title string")
    got = of(sections.parsed_sections(df, "doc_id", "sections", "text", "title"), "heading", "level", "page", "source", "text", "path_text")
    assert got[1] == [("A b", 2, 3, "toc", "x", "P > A b")]
    # One has no path, so all are made anew.
    assert got[2] == [("1.1 C", 2, None, "stored", "r s", "1.1 C"), ("T", 1, None, "stored", "y", "T")]
    assert got[3] == [("MÅL", 1, None, "heuristic", "z", "MÅL")] and 4 not in got


def test_section_paths(spark):
    s = spark.createDataFrame([(1, i, lv, f"h{i}") for i, lv in enumerate([1, 3, 3, 2])] + [(2, 0, None, "x")], "k long, section_index int, level int, heading string")
    got = {(r.k, r.section_index): (r.depth, r.path_text) for r in sections.section_paths(s, "k").collect()}
    assert [got[1, i][0] for i in range(4)] == [1, 2, 3, 2] and got[1, 2][1] == "h0 > h1 > h2" and got[2, 0] == (1, "x")


def test_profiles():
    assert chunking.settings("swedish_bert") == (250, 50, True, "") and chunking.settings("e5_large_instruct", overlap=0) == (500, 0, True, "passage: ") and chunking.settings(size=9, titles=False) == (9, 50, False, "")
    with pytest.raises(ValueError):
        chunking.settings("none")


def test_chunk_words():
    assert chunking.chunk_words("ett två tre fyra", 10, 0) == ["ett två", "tre fyra"]
    assert chunking.chunk_words("ett två tre fyra", 10, 1) == ["ett två", "två tre", "tre fyra"]
    assert chunking.chunk_words("x" * 50, 10, 5) == ["x" * 50] and chunking.chunk_words(None, 10, 5) == [] and chunking.chunk_words("  ", 10, 5) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abå", min_size=1, max_size=14), max_size=40), st.integers(1, 30), st.integers(0, 35))
def test_chunks_hold_all_words(words, size, overlap):
    got = chunking.chunk_words(" ".join(words), size, overlap)
    at = 0
    for c in got:
        w = c.split()
        # Each chunk ends further on in the text than the one before, and leaves no word out.
        ends = [k for k in range(len(words) + 1) if words[max(0, k - len(w)) : k] == w]
        assert any(k - len(w) <= at < k for k in ends)
        at = min(k for k in ends if k - len(w) <= at < k)
    assert at == len(words)


def test_dense_chunk_ids(spark):
    df = spark.createDataFrame([(k, "ord" if k % 5 else " - ") for k in range(200)], "n long, text string")
    got = chunking.with_chunk_ids(df, ["n"]).orderBy("n").collect()
    assert [r.chunk_id for r in got] == list(range(160))
