import io
import zipfile

from quillspan.operators import characters as C
from quillspan.sources import archives as R

CHARS = "doc_id string, page_number int, ord int, ch string, x0 double, y0 double, x1 double, y1 double, base double, size double, font string, bold boolean, italic boolean, space_before boolean"


def chars(spark, text, x=10.0, y=100.0, step=5.0, size=10.0, down=False):
    rows, space, at = [], False, 0
    for ch in text:
        if ch == " ":
            space = True
        else:
            a, b = (x, y + at * step) if down else (x + at * step, y)
            rows.append(("d", 1, len(rows), ch, a, b - size, a + step - 0.5, b, b, size, "F", False, False, space))
            space = False
        at += 1
    return spark.createDataFrame(rows, CHARS)


def test_words_from_chars(spark):
    got = C.words_from_chars(chars(spark, "two words")).orderBy("word_id").collect()
    assert [w.text for w in got] == ["two", "words"] and (got[0].x0, got[0].x1) == (10.0, 24.5)
    wide = chars(spark, "ab").union(chars(spark, "cd", x=60.0).withColumn("ord", C.F.col("ord") + 100))
    assert [w.text for w in C.words_from_chars(wide).orderBy("word_id").collect()] == ["ab", "cd"]


def test_reading_quarter(spark):
    assert C.reading_quarter(chars(spark, "plain text that runs across the page")).first().quarter == 0
    assert C.reading_quarter(chars(spark, "text that runs down the page instead", down=True)).first().quarter == 3
    assert C.reading_quarter(chars(spark, "short", down=True)).first().quarter == 0


def test_recognised_lines(spark):
    p = [(0.0, 0.0), (9.0, 0.0), (9.0, 4.0), (0.0, 4.0)]
    rows = [("d", 1, p, " ok ", 0.5), ("d", 1, p, "  ", 0.9), ("d", 1, p[:3], "x", 0.9), ("d", 1, [(float("nan"), 0.0), *p[1:]], "y", 0.9), ("d", 1, p, "sure", 1.7)]
    df = spark.createDataFrame(rows, "doc_id string, page_number int, polygon array<struct<x:double,y:double>>, text string, confidence double")
    assert sorted((r.text, r.x1, r.confidence, r.doubtful) for r in C.recognised_lines(df).collect()) == [("ok", 9.0, 0.5, True), ("sure", 9.0, 1.0, False)]


def test_image_regions(spark):
    images = spark.createDataFrame([("d", 1, k, *map(float, b)) for k, b in enumerate([(0, 0, 600, 800), (50, 50, 150, 150), (60, 60, 140, 140), (0, 0, 3, 90), (300, 20, 400, 60)])], "doc_id string, page_number int, image_id int, x0 double, y0 double, x1 double, y1 double")
    words = spark.createDataFrame([("d", 1, 10.0, 10.0, 20.0, 20.0)], "doc_id string, page_number int, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([("d", 1, 595.0, 842.0)], "doc_id string, page_number int, width double, height double")
    assert [r.image_id for r in C.image_regions(images, words, pages).orderBy("ord").collect()] == [4, 1]


def test_image_in_dropped_image(spark):
    """1 lies in 0 and goes; 2 lies in 1, but just 80 % of it in 0: it stays.  Another page is on its own."""
    boxes = [(1, 0, 0, 0, 100, 100), (1, 1, 10, 0, 110, 100), (1, 2, 20, 0, 120, 100), (2, 0, 10, 0, 110, 100)]
    images = spark.createDataFrame([("d", p, k, *map(float, b)) for p, k, *b in boxes], "doc_id string, page_number int, image_id int, x0 double, y0 double, x1 double, y1 double")
    words = spark.createDataFrame([], "doc_id string, page_number int, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([("d", 1, 595.0, 842.0), ("d", 2, 595.0, 842.0)], "doc_id string, page_number int, width double, height double")
    assert sorted((r.page_number, r.image_id) for r in C.image_regions(images, words, pages).collect()) == [(1, 0), (1, 2), (2, 0)]


def test_captions_and_footnotes(spark):
    df = spark.createDataFrame([("d", k, t, x, 1) for k, (t, x) in enumerate([("image", None), ("paragraph", "Figure 4.1: A bridge"), ("footnote", "1 note"), ("paragraph", "Figure 2 shows"), ("paragraph", "Table 1. Data"), ("table", None)])], "doc_id string, ord int, type string, text string, source_page int")
    assert [r.type for r in C.label_captions(df).orderBy("ord").collect()] == ["image", "caption", "footnote", "paragraph", "caption", "table"]
    assert [r.type for r in C.footnotes_last(df).orderBy("ord").collect()][-1] == "footnote"


def test_archives_and_references(spark):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", "<x/>")
        z.writestr("word/vbaProject.bin", "macro")
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="1" TargetMode="External" Target="file:///etc/x"/><Relationship Id="2" TargetMode="External" Target="https://ok"/></Relationships>')
    r = R.clean_archives(spark.createDataFrame([("a", bytearray(buf.getvalue()))], "doc_id string, content binary")).first()
    z = zipfile.ZipFile(io.BytesIO(bytes(r.content)))
    assert r.removed == ["ArchiveMember:word/vbaProject.bin", "ExternalRel:file:///etc/x"] and z.namelist() == ["word/document.xml", "word/_rels/document.xml.rels"]
    assert b'Target="#"' in z.read("word/_rels/document.xml.rels") and b"https://ok" in z.read("word/_rels/document.xml.rels")
    t = spark.createDataFrame([("c", 1, None), ("c", 2, "text")], "case string, priority int, content string")
    v = spark.createDataFrame([("c", '{"reading_order":["a"],"source_pages":[1],"image_count":2}')], "case string, value string")
    got = R.references(t, v).first()
    assert (got.transcript, got.reading_order, got.image_count) == ("text", ["a"], 2)
