import datetime
import io
import json
import zipfile

from pyspark.sql import functions as F

from fathom.operators import schema_drift
from fathom.sources import documents, results
from fathom.streaming import events


def test_scan(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"text": "x", "metadata": {"title": "T", "page_count": 3, "ok": True}, "sections": [{"heading": "h", "path": ["h"]}]}))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text(json.dumps({"path": "own", "text": "y"}))
    (tmp_path / "d.txt").write_text("no")
    rows = {r.text: r for r in documents.scan_parsed(spark, str(tmp_path)).collect()}
    assert set(rows) == {"x", "y"} and rows["y"].path == "own" and rows["x"].path.endswith("a.json") and rows["x"].metadata["page_count"] == "3" and rows["x"].sections[0].path == ["h"]
    sig = documents.folder_signature(spark, str(tmp_path), "*.json").first()
    assert sig.n_files == 3 and sig.n_bytes == sum((tmp_path / f"{c}.json").stat().st_size for c in "abc")
    one = documents.index_signature(documents.folder_signature(spark, str(tmp_path)), size=500).first().signature
    assert one == documents.index_signature(documents.folder_signature(spark, str(tmp_path)), size=500).first().signature != documents.index_signature(documents.folder_signature(spark, str(tmp_path)), size=250).first().signature


def test_binaries(spark):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>Hej</w:t></w:p><w:p><w:t>du</w:t></w:p>")
    df = spark.createDataFrame([("a.docx", bytearray(held.getvalue())), ("b.pdf", bytearray(b"/Type /Page x /Type /Pages /Type/Page")), ("c.docx", bytearray(b"no")), ("d.xyz", None)], "path string, content binary")
    got = {r.path: (r.text, r.page_count) for r in documents.extract(df).collect()}
    assert got == {"a.docx": ("Hej\ndu\n", None), "b.pdf": ("", 2), "c.docx": ("", None), "d.xyz": ("", None)}


PAGE = """<div class="x file-row"><a href="/getdocument?file=A%20b.pdf#p2"> </a><a href="/second.pdf">no</a><button class="file-metadata" data-title=" T " data-version="2" data-documentcollection="C&amp;D" data-publishdate="2024-01-02"
 data-type="Rutin" data-taxkeyword="a;b" data-url="/m" data-typeofaction="x" data-validforarea="y" data-subjectarea="z" data-process="" data-other="no"></button></div>
<li class="file-row"><div><a href="d.pdf">Doku<b>ment</b></a></div></li><div class="file-row"><a href="d.pdf#again">again</a></div><div class="file-row"><a href="/help">Help</a></div><a href="/outside.pdf">o</a>"""


def test_links(spark):
    home = "https://h.example/s/list?page=1"
    rows = [(1, PAGE, home), (2, '<a href="x.pdf">X</a><a href="x.pdf">Y</a><a href="y.pdf"></a><a href="no.html">N</a>', home), (3, None, home), (4, "", None), (5, '<div class="file-row"><a href="/help">H</a></div><a href="/a.docx">A</a>', home)]
    df = spark.createDataFrame(rows, "page_id long, html string, page_url string")
    got = {(r.page_id, r.position): (r.url, r.title, r.fields) for r in documents.page_links(df, "page_id", "html", "page_url").collect()}
    fields = {"title": "T", "version": "2", "document_collection": "C&D", "publish_date": "2024-01-02", "document_type": "Rutin", "tax_keyword": "a;b", "metadata_url": "/m", "type_of_action": "x", "valid_for_area": "y", "subject_area": "z", "process": ""}
    assert got == {
        (1, 1): ("https://h.example/getdocument?file=A%20b.pdf", "A b.pdf", fields), (1, 2): ("https://h.example/s/d.pdf", "Dokument", {}), (2, 1): ("https://h.example/s/x.pdf", "X", {}), (2, 2): ("https://h.example/s/y.pdf", "y.pdf", {}), (5, 1): ("https://h.example/a.docx", "A", {}),
    }
    every = [r.url for r in documents.page_links(df, "page_id", "html", "page_url", rows=False).where("page_id = 1").orderBy("position").collect()]
    assert [u.rsplit("/", 1)[1] for u in every] == ["getdocument?file=A%20b.pdf", "second.pdf", "d.pdf", "outside.pdf"]


def test_live_scores(spark):
    links = spark.createDataFrame([(1, 0, "a", 1), (1, 0, "b", 2), (1, 1, "a", 1), (1, 2, "c", 1), (2, 0, "", 1), (2, 0, "d", 2), (2, 1, "e", 1)], "q long, page int, doc string, position int")
    pages = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2)], "q long, page int")
    got = sorted((r.q, r.doc, r.score) for r in documents.live_scores(links, pages, "q", "page", "doc", "position", 2).collect())
    # The second page of the first search holds nothing new, so the third isn't read.
    assert got == [(1, "a", 2.0), (1, "b", 1.0), (2, "d", 2.0), (2, "e", 1.0)]


def test_log(spark, tmp_path):
    rows = spark.createDataFrame([("q", 1, "x")], "query string, rank int, unknown string")
    for _ in range(2):
        documents.append_log(rows, str(tmp_path / "log"), ["query", "rank", "user"])
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "log")).collect()] == [("q", "1", "")] * 2


def test_stream(spark, tmp_path):
    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    rows = [(1, at(1), 7, "view", 1.0, "{}"), (1, at(1), 7, "view", 1.0, "{}"), (2, at(1, 30), 7, "view", 2.0, None), (3, at(3), 8, "click", 4.0, "{}")]
    spark.createDataFrame(rows, events.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = events.append_events(events.read_events(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]
    still = events.windowed_counts(spark.createDataFrame(rows, events.EVENTS).selectExpr("event_id", "cast(ts as timestamp) ts", "event_type", "value"))
    assert sorted((r.event_type, r.n, r.total) for r in still.collect()) == [("click", 1, 4.0), ("view", 3, 4.0)]


def test_pdf(spark):
    import zlib

    page = zlib.compress(b"BT /F1 12 Tf 72 700 Td (Rutin f\\366r \\(l\344kemedel\\)) Tj 0 -14 Td [(an) -20 (dra)] TJ T* <48656a> Tj ET")
    objects = zlib.compress(b"1 0 2 40 << /Type /Page >> << /Type /Pages >> << /Type /Page >>")
    data = b"%PDF-1.5\n1 0 obj << /Length 9 /Filter /FlateDecode >>\nstream\n" + page + b"\nendstream endobj\n2 0 obj << /Type /ObjStm /N 2 /Filter /FlateDecode >>\nstream\n" + objects + b"\nendstream endobj\n3 0 obj << /Type /Page >> endobj"
    df = spark.createDataFrame([("a.PDF", bytearray(data)), ("b.pdf", bytearray(b"<< /Filter /FlateDecode >>\nstream\nbroken\nendstream"))], "path string, content binary")
    got = {r.path: (r.text, r.page_count) for r in documents.extract(df).collect()}
    assert got == {"a.PDF": ("Rutin för (läkemedel)\nandra\nHej", 3), "b.pdf": ("", None)}


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("p1", "x", {"title": "T"}), ("p2", None, None)], "path string, text string, metadata map<string,string>")
    documents.write_parsed(docs, str(tmp_path / "d"))
    (tmp_path / "d" / "bad.json").write_text("{broken\n")
    back = {r.path: (r.text, r.metadata) for r in documents.scan_parsed(spark, str(tmp_path / "d"), lines=True).collect()}
    assert back == {"p1": ("x", {"title": "T"}), "p2": (None, None)}
    documents.write_metadata(docs.withColumnRenamed("path", "source_url"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).where("source_url = 'p1'").first().metadata.title == "T"
    assert tuple(documents.crawl_summary(docs.withColumn("path", F.when(F.col("path") == "p1", F.col("path")))).first()) == (2, 1)


def test_result_files(spark, tmp_path):
    for name, text in (("e1/results/aggregate/s.csv", "method,rank\r\nbm25,1\n"), ("e2/results/runs/x/y.csv", "method,rank,experiment\ndense,2,own\n"), ("e2/results/runs/x/y.txt", "no"), ("all.csv", "method,rank\nfts,3")):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    files = results.discover(spark, str(tmp_path), root=str(tmp_path / "all.csv")).persist()
    fields = [("method", "string"), ("rank", "double"), ("experiment", "string")]
    got = results.with_experiment(schema_drift.ingest(files, fields), files)
    assert {(r.method, r["rank"], r.experiment, r.source_kind) for r in got.collect()} == {("bm25", 1.0, "e1", "aggregate"), ("dense", 2.0, "own", "runs"), ("fts", 3.0, None, "root")}
    assert results.discover(spark, str(tmp_path), runs=False).select("source_kind").distinct().count() == 1 and results.discover(spark, str(tmp_path / "none")).count() == 0
    page = results.html_report("A & B", {"<t>": files.select("line_no").orderBy("line_no")}, most=2)
    assert "<h1>A &amp; B</h1>" in page and "&lt;t&gt;" in page and page.count("<tr>") == 3


def test_sheet(spark, tmp_path):
    (tmp_path / "s.csv").write_text('title,q1\n"A, ""b""",x\nC,\n')
    want = [("A, \"b\"", "x"), ("C", None)]
    assert [tuple(r) for r in results.read_sheet(spark, str(tmp_path / "s.csv"), str(tmp_path / "kept")).collect()] == want
    assert [tuple(r) for r in results.read_sheet(spark, str(tmp_path / "gone.csv"), str(tmp_path / "kept")).collect()] == want
