"""Office documents with every kind of block, written and read again."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quillspan.sources import docx, office as O

CELL = "array<array<struct<text:string,row_span:int,col_span:int,is_header:boolean>>>"
FIELDS = f"doc_id string, ord int, type string, text string, level int, text_direction string, indent_level int, styles array<struct<start:int,end:int,bold:boolean,italic:boolean,underline:boolean>>, rows {CELL}, page_marker int, caption string, asset string"


def row(ord_, type_, text=None, level=None, rows=None, caption=None, asset=None, direction="ltr", marker=None):
    return ("d", ord_, type_, text, level, direction, 0, [], rows, marker, caption, asset)


def grid(columns, words=1):
    cell = lambda t, head: (" ".join([t] * words), 1, 1, head)
    return [[cell(f"head{c}", True) for c in range(columns)], *([cell(f"r{r}c{c}", False) for c in range(columns)] for r in range(2))]


def read(spark, rows, **k):
    return O.read_docx(docx.large_print(spark.createDataFrame(rows, FIELDS), **k)).orderBy("ord").collect()


def test_all_kinds(spark):
    pixels = [bytearray(b"one"), bytearray(b"two")]
    pictures = spark.createDataFrame([("d", "a1", pixels[0], "image/png", 400, 300), ("d", "a2", pixels[1], "image/jpeg", 40, 3000), ("d", "a3", None, "image/png", 1, 1), ("d", "a4", pixels[0], "image/tiff", 9, 9)], "doc_id string, asset string, content binary, mime_type string, width int, height int")
    rows = [row(0, "title", "Top"), row(1, "heading", "Part", 3), row(2, "paragraph", "Body"), row(3, "list", "one"), row(4, "quote", "said"), row(5, "caption", "below"), row(6, "footnote", "1 note"), row(7, "image", "A boat <x>", asset="a1"),
            row(8, "image", asset="a2"), row(9, "image", "no bytes", asset="a3"), row(10, "image", "no kind", asset="a4"), row(11, "table", rows=grid(2), caption="Small"), row(12, "aside", "boxed"), row(13, "table", rows=[])]
    got = [r for r in read(spark, rows, pictures=pictures) if r.type != "page_marker"]
    assert [(r.type, r.text) for r in got if r.type != "table" and r.type != "image"] == [("heading", "Top"), ("heading", "Part"), ("paragraph", "Body"), ("list", "one"), ("quote", "said"), ("caption", "below"), ("footnote", "1 note"), ("paragraph", "no bytes"), ("paragraph", "no kind"), ("caption", "Small"), ("paragraph", "boxed")]
    assert [r.digest for r in got if r.type == "image"] == [hashlib.sha256(p).hexdigest() for p in pixels]
    assert [[c.text for c in r] for r in next(x for x in got if x.type == "table").rows] == [["head0", "head1"], ["r0c0", "r0c1"], ["r1c0", "r1c1"]]


def test_tables_that_do_not_fit(spark):
    wide = read(spark, [row(0, "table", rows=grid(10), caption="Wide")])
    parts = [r for r in wide if r.type == "table"]
    assert len(parts) == 5 and [r.text for r in wide if r.type == "caption"] == [f"Wide (Part {k} of 5)" for k in range(1, 6)]
    assert [[c.text for c in p.rows[1]] for p in parts] == [["r0c0", "r0c1", "r0c2"], ["r0c0", "r0c3", "r0c4"], ["r0c0", "r0c5", "r0c6"], ["r0c0", "r0c7", "r0c8"], ["r0c0", "r0c9"]]
    long = grid(3)
    long[1] = [("x" * 60, 1, 1, False)] * 3
    listed = read(spark, [row(0, "table", rows=long, caption="Long")])
    assert not [r for r in listed if r.type == "table"]
    assert [r.text for r in listed if r.type in ("caption", "list")] == ["Long", "x" * 60, "head1: " + "x" * 60, "head2: " + "x" * 60, "r1c0", "head1: r1c1", "head2: r1c2"]


@pytest.mark.parametrize("bad", [{"body": 5.0}, {"body": float("nan")}, {"spacing": 9.0}, {"paper": "B7"}])
def test_ranges(spark, bad):
    with pytest.raises(ValueError, match="out of range"):
        docx.large_print(spark.createDataFrame([row(0, "paragraph", "x")], FIELDS), **bad)
