import hashlib
import io
import zipfile

from pyspark.sql import functions as F

from quillspan.functions import tables as B
from quillspan.operators import layout as L
from quillspan.sources import html as H, office as O, sinks, sniff


def test_word_region_join(spark):
    w = spark.createDataFrame([("d", 1, 0, 0.0, 0.0, 10.0, 10.0), ("d", 1, 1, 95.0, 0.0, 105.0, 10.0), ("d", 1, 2, 300.0, 0.0, 310.0, 10.0), ("d", 1, 3, 20.0, 0.0, 30.0, 10.0)], "doc_id string, page_number int, word_id int, x0 double, y0 double, x1 double, y1 double")
    r = spark.createDataFrame([("d", 1, 0, 0.0, 0.0, 100.0, 100.0, "text", False), ("d", 1, 1, 15.0, 0.0, 35.0, 20.0, "text", False)], "doc_id string, page_number int, region_id int, x0 double, y0 double, x1 double, y1 double, kind string, decorative boolean")
    assert {x.word_id: x.region_id for x in L.assign_words(w, r).collect()} == {0: 0, 1: None, 2: None, 3: 1}
    assert sorted(x.word_id for x in L.orphans(w, r).collect()) == [1, 2]


CELL = "array<array<struct<text:string,row_span:int,col_span:int,is_header:boolean>>>"


def table(spark, rows, **k):
    return spark.createDataFrame([([[(c, 1, 1, False) if isinstance(c, str) else c for c in r] for r in rows],)], f"rows {CELL}")


def test_table_views(spark):
    t = table(spark, [["Party", "Role"], ["Applicant", "Owner\nof it"], ["x"]])
    r = t.select(B.markdown(F.col("rows"), F.lit("Cap")).alias("m"), B.linearized(F.col("rows"), F.lit(True), F.lit(None).cast("string")).alias("l"), B.entries(F.col("rows"), F.lit(True)).alias("e")).first()
    assert r.m.split("\n") == ["**Cap**", "", "| Party | Role |", "| --- | --- |", "| Applicant | Owner of it |", "| x |  |"]
    assert r.l.startswith("[Table]\n• Row 1:\n   - Party: Applicant")
    assert [(e.lead, [tuple(d) for d in e.details]) for e in r.e] == [("Applicant", [("Role", "Owner\nof it")]), ("x", [])]
    wide = table(spark, [[f"Heading {k}" for k in range(6)], [f"some text {k}" for k in range(6)]]).withColumn("m", B.measures(F.col("rows")))
    fit = lambda w: wide.select(B.fit(F.col("rows"), F.col("m"), F.lit(w), F.lit(20.0)).alias("f")).first().f.tier
    assert fit(900.0) == "enlarged" and fit(150.0) == "linearize" and fit(350.0) in ("split", "linearize")
    parts = wide.select(B.split_parts(F.col("rows"), F.lit("T")).alias("p")).first().p
    assert [len(p.rows[0]) for p in parts] == [3, 3, 2] and all(p.rows[1][0].text == "some text 0" for p in parts) and parts[0].caption == "T (Part 1 of 3)"
    spans = table(spark, [[("a", 1, 2, False), "hidden", "b"], [("c", 9, 1, False), "d", "e"]])
    assert [(v.r, v.c, v.rs, v.cs) for v in spans.select(B.visible_cells(F.col("rows")).alias("v")).first().v] == [(0, 0, 1, 2), (0, 2, 1, 1), (1, 0, 1, 1), (1, 1, 1, 1), (1, 2, 1, 1)]


def _packed(members):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for n, c in members.items():
            z.writestr(n, c)
    return buf.getvalue()


def _zip(**members):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for n, c in members.items():
            z.writestr(n.replace("__", "/").replace("_xml", ".xml"), c)
    return buf.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_sources(spark):
    doc = f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:br w:type="page"/><w:t>after break</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>h</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    styles = f'<w:styles {W}><w:style w:styleId="Heading1"><w:name w:val="heading 1"/></w:style></w:styles>'
    raw = _zip(word__document_xml=doc, word__styles_xml=styles)
    df = spark.createDataFrame([("a", bytearray(raw)), ("b", bytearray(b"%PDF-1.7")), ("c", bytearray(b"")), ("e", bytearray(b"PK\x03\x04junk"))], "doc_id string, content binary")
    assert {r.doc_id: r.k for r in df.select("doc_id", sniff.detect(F.col("content")).alias("k")).collect()} == {"a": "docx", "b": "pdf", "c": None, "e": None}
    b = O.read_docx(df.filter("doc_id = 'a'")).orderBy("ord").collect()
    assert [(x.type, x.text, x.source_page, x.level) for x in b] == [("page_marker", None, 1, None), ("heading", "Top", 1, 1), ("page_marker", None, 2, None), ("paragraph", "after break", 1, None), ("table", None, 2, None)]
    assert O.unreadable(df.filter("doc_id <> 'b'"), "docx").filter("fatal").count() == 2 and O.read_docx(df).select("doc_id").distinct().count() == 1
    rels = '<Relationships><Relationship Id="r1" Target="media/p.png"/></Relationships>'
    shown = f'<w:document {W} xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><w:body><w:p><w:r><a:blip r:embed="r1"/></w:r></w:p></w:body></w:document>'
    parts = {"word/document.xml": shown, "word/_rels/document.xml.rels": rels, "word/media/p.png": "pixels", "word/footnotes.xml": "<broken"}
    more = {"p": parts, "q": {"word/document.xml": "<!DOCTYPE x>" + shown}, "r": {"word/document.xml": shown, "word/big.bin": "0" * 12_000_000}, "s": {"word/document.xml": shown, "../out": "1"}}
    files = spark.createDataFrame([(k, bytearray(_packed(v))) for k, v in more.items()], "doc_id string, content binary")
    assert [(x.type, x.asset, x.digest) for x in O.read_docx(files).filter("asset is not null").collect()] == [("image", "word/media/p.png", hashlib.sha256(b"pixels").hexdigest())]
    assert {(x.doc_id, x.fatal) for x in O.unreadable(files, "docx").collect()} == {("p", False), ("q", True), ("r", True), ("s", True)}
    bad = spark.createDataFrame([("x", bytearray(_zip(**{"..__evil": "1", "ok": "2"})))], "path string, content binary")
    assert [r.name for r in sniff.unsafe_members(bad).collect()] == ["../evil"]
    assert H.blocks_of("<h2>T</h2><p>a<br>b<script>x()</script></p><ul><li>c</ul>") == [("heading", 2, "T"), ("paragraph", None, "a b"), ("list", None, "c")]


def test_reader_html_and_files(spark, tmp_path):
    b = spark.createDataFrame([("d", 0, "page_marker", None, None, "en", "ltr", 1, None, None, None, None), ("d", 1, "paragraph", "a < b", None, "en", "rtl", None, None, None, None, "look")], f"doc_id string, ord int, type string, text string, level int, language string, text_direction string, page_marker int, role string, rows {CELL}, caption string, note string")
    p = spark.createDataFrame([("d", 1, "iv")], "doc_id string, page_number int, printed_page string")
    d = spark.createDataFrame([("d", "My & book")], "doc_id string, title string")
    h = sinks.reader_html(b, d, p).first().html
    assert 'id="page-1">Original page 1 (printed iv)' in h and '<p dir="rtl">a &lt; b</p><p class="note">look</p>' in h and "<title>My &amp; book</title>" in h
    sinks.put_file(str(tmp_path / "x.html"), h.encode())
    assert [f.name for f in tmp_path.iterdir()] == ["x.html"]


def test_job_stream(spark, tmp_path):
    from quillspan.streaming import jobs

    rows = ['{"job_id":"j","type":"checkpoint","ts":"2026-01-01T00:00:%02d","page_number":%d,"classification":"native","flagged_for_review":%s}' % (k, k, "true" if k == 3 else "false") for k in range(5)]
    (tmp_path / "e.json").write_text("\n".join(rows))
    q = jobs.throughput(jobs.read_events(spark, str(tmp_path))).writeStream.outputMode("complete").format("memory").queryName("pages_done").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.pages, r.flagged) for r in spark.sql("select pages, flagged from pages_done").collect()] == [(5, 1)]


def test_large_print_round_trip(spark):
    from quillspan.sources import docx

    styles = [(2, 5, True, False, False)]
    rows = [("d", 0, "page_marker", None, None, "ltr", 0, [], None, 1), ("d", 1, "heading", "Top & <more>", 2, "ltr", 0, [], None, None), ("d", 2, "paragraph", "a bold\nword \x01here", None, "ltr", 0, styles, None, None),
            ("d", 3, "list", "1. one", None, "ltr", 2, [], None, None), ("d", 4, "table", None, None, "rtl", 0, [], [[("h", 1, 1, True), ("k", 1, 1, True)], [("x", 1, 2, False)]], None), ("d", 5, "paragraph", "ألف", None, "rtl", 0, [], None, None), ("e", 0, "quote", "said", None, "ltr", 0, None, None, None)]
    b = spark.createDataFrame(rows, f"doc_id string, ord int, type string, text string, level int, text_direction string, indent_level int, styles array<struct<start:int,end:int,bold:boolean,italic:boolean,underline:boolean>>, rows {CELL}, page_marker int")
    made = docx.large_print(b)
    got = O.read_docx(made).orderBy("doc_id", "ord").collect()
    assert [(x.type, x.text, x.level) for x in got if x.doc_id == "d" and x.type != "page_marker"] == [
        ("paragraph", "Original page 1", None), ("heading", "Top & <more>", 2), ("paragraph", "a bold\nword here", None), ("list", "1. one", None), ("table", None, None), ("paragraph", "ألف", None)]
    table = next(x for x in got if x.type == "table")
    assert [[c.text for c in r] for r in table.rows] == [["h", "k"], ["x"]] and table.text_direction == "rtl" and [x.text for x in got if x.doc_id == "e" and x.type == "quote"] == ["said"]
    xml = zipfile.ZipFile(io.BytesIO(bytes(made.filter("doc_id = 'd'").first().content))).read("word/document.xml").decode()
    assert '<w:b/></w:rPr><w:t xml:space="preserve">bol</w:t>' in xml and '<w:gridSpan w:val="2"/>' in xml and xml.count("<w:bidi/>") >= 2
