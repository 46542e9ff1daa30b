"""Lines, columns, items, tables and order of pages laid out for each case."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quillspan.operators import boxes as B, composition as C, flow as W
from quillspan.schema import REGIONS, RULES, WORDS

PAGES = "doc_id string, page_number int, width double, height double"


class Page:
    """A page's tables, filled word by word; pages are told apart by number."""

    def __init__(self):
        self.words, self.regions, self.rules, self.pages = [], [], [], []
        self.page()

    def page(self):
        self.no = len(self.pages) + 1
        self.pages.append(("d", self.no, 600.0, 800.0))
        return self

    def word(self, text, x, y, size=10.0, bold=False, width=None, **k):
        box = (float(x), float(y), float(x + (width or 0.6 * size * len(text))), float(y + size))
        self.words.append(("d", self.no, len(self.words), text, *box, float(size), bold, k.get("italic", False), False, False, k.get("visual", False), k.get("sure", 1.0)))
        return self

    def line(self, text, x, y, size=10.0, bold=False, step=None, **k):
        for t in text.split():
            self.word(t, x, y, size, bold, **k)
            x += step or 0.6 * size * (len(t) + 1)
        return self

    def region(self, kind, x0, y0, x1, y1, label="seen", order=None):
        self.regions.append(("d", self.no, len(self.regions), kind, float(x0), float(y0), float(x1), float(y1), 0.9, float(len(self.regions) if order is None else order), label, False))
        return self

    def rule(self, x0, y0, x1, y1, vertical=False):
        self.rules.append(("d", self.no, len(self.rules), float(x0), float(y0), float(x1), float(y1), vertical))
        return self

    def tables(self, spark):
        return tuple(spark.createDataFrame(rows, schema) for rows, schema in ((self.words, WORDS), (self.regions, REGIONS), (self.rules, RULES), (self.pages, PAGES)))

    def blocks(self, spark, **k):
        return C.assemble_pages(*self.tables(spark), **k).orderBy("page_number", "ord").collect()


def test_reading_order_of_boxes():
    boxes = np.array([[40, 30, 560, 55], [40, 70, 270, 150], [310, 70, 560, 120], [40, 170, 270, 300], [40, 640, 560, 660]], float)
    assert B.reading_order(boxes) == [0, 1, 3, 2, 4]
    assert B.reading_order(boxes, True) == [0, 2, 1, 3, 4]
    # columns in a column
    inner = np.array([[0, 0, 100, 10], [200, 0, 290, 10], [310, 0, 400, 10], [200, 40, 290, 50], [310, 40, 400, 50]], float)
    assert B.reading_order(inner) == [0, 1, 3, 2, 4]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 50)] * 4), max_size=12), st.booleans())
def test_reading_order_is_a_permutation(raw, rtl):
    boxes = np.array([(a, b, a + c + 1, b + d + 1) for a, b, c, d in raw], float).reshape(-1, 4)
    assert sorted(B.reading_order(boxes, rtl)) == list(range(len(boxes)))


def test_fragments_of_a_line():
    b = np.array([[10, 100, 60, 110], [70, 101, 120, 111], [125, 99, 160, 109], [400, 100, 450, 110], [10, 300, 60, 310]], float)
    text = np.ones(5, bool)
    assert B.fragments(b, text, 10.0, np.zeros((0, 4))).tolist() == [0, 0, 0, 3, 4]
    far = np.array([[10, 100, 60, 110], [150, 100, 200, 110]], float)
    assert B.fragments(far, text[:2], 10.0, np.zeros((0, 4))).tolist() == [0, 1]
    assert B.fragments(far, text[:2], 10.0, np.array([[62, 101, 148, 110]], float)).tolist() == [0, 0]


def test_rows_and_lines(spark):
    p = Page().line("first line here", 50, 100).word("raised", 300, 97).line("second one", 50, 114).line("right side", 400, 107)
    w = W.line_facts(W.lines(W.with_rows(p.tables(spark)[0], ["doc_id"]), ["doc_id"]), ["doc_id"])
    got = [r.l_text for r in w.filter("at = 1").orderBy("line").collect()]
    assert sorted(got) == ["first line here", "raised", "right side", "second one"] and got.index("first line here") < got.index("second one")
    skew = Page()
    for k in range(12):
        skew.word(f"w{k}", 50 + 40 * k, 100 + 0.3 * k)
    w = W.lines(W.with_rows(skew.tables(spark)[0], ["doc_id"]), ["doc_id"], 9.0)
    assert w.select("line").distinct().count() == 1


def test_right_to_left_line(spark):
    a, b, c = "ألف", "باء", "تاء"
    p = Page().word(c, 50, 100).word("IR", 100, 100).word("2024", 130, 100).word(b, 180, 100).word(a, 230, 100)
    w = W.line_facts(W.lines(W.with_rows(p.tables(spark)[0], ["doc_id"]), ["doc_id"], 99.0), ["doc_id"])
    assert w.first().l_text == f"{a} {b} IR 2024 {c}"
    p = Page().word(c, 50, 100, visual=True).word(b, 180, 100).word(a, 230, 100)
    w = W.line_facts(W.lines(W.with_rows(p.tables(spark)[0], ["doc_id"]), ["doc_id"], 99.0), ["doc_id"])
    assert w.first().l_text == f"{c} {b} {a}"


def test_columns(spark):
    p = Page()
    for k in range(8):
        p.line("some words of prose", 40, 100 + 14 * k).line("and their gloss too", 300, 100 + 14 * k)
    p.word("x", 590, 100)
    w = W.columns(p.tables(spark)[0], ["doc_id"])
    assert {(r.col, r.n) for r in w.groupBy("col").agg(F.count("*").alias("n")).collect()} == {(0, 32), (1, 33)}


def grid(p, rows, xs, top, step, bold=True):
    for k, row in enumerate(rows):
        for text, x in zip(row, xs):
            p.line(text, x, top + step * k, bold=bold and k == 0)
    return p


ROWS = [["Name", "Born", "Town"], ["Adams", "1801", "Leeds"], ["Brown", "1822", "York"]]


def two_columns(p, detected):
    p.line("The title of the page", 100, 40, 16)
    for k in range(4):
        p.line(f"left line {k} of words", 40, 100 + 13 * k).line(f"right line {k} of words", 330, 104 + 13 * k)
    p.line("a footer across the whole of the page and more of it still", 40, 700)
    if detected:
        p.region("title", 90, 30, 500, 60).region("text", 30, 95, 280, 160).region("text", 320, 95, 570, 165)


def items(p):
    p.region("text", 40, 90, 560, 400)
    p.line("A well-", 50, 100).line("known", 50, 114).word("case", 90, 114, bold=True).line("here", 130, 114).word("far", 200, 114)
    p.line("1. one thing", 50, 150).line("2. another", 50, 164).line("that goes on", 66, 178).line("Run in", 50, 220, bold=True).line("Plain text after it.", 50, 234)


def ruled(p):
    grid(p, ROWS, (60, 200, 340), 200, 24).region("table", 50, 190, 460, 280)
    for x in (50, 190, 330, 459):
        p.rule(x, 190, x + 1, 280, True)
    for y in (190, 217, 241, 279):
        p.rule(50, y, 460, y + 1)


def heads(p):
    p.line("Name", 60, 200, bold=True).line("Born", 200, 200, bold=True).line("Died", 340, 200, bold=True).line("Town", 420, 200, bold=True).region("table", 50, 190, 500, 300)
    for y in (190, 217, 241, 265, 299):
        p.rule(50, y, 500, y + 1)


def undetected_grid(p):
    grid(p, [["Stage", "When", "State"], ["Draft", "May", "Done"]], (90, 250, 420), 140, 60)
    for x in (80, 240, 410, 560):
        p.rule(x, 120, x + 1, 270, True)
    for y in (120, 180, 269):
        p.rule(80, y, 561, y + 1)


def labels(p):
    p.region("heading", 73, 100, 300, 115).region("text", 50, 100, 62, 115).region("text", 80, 130, 400, 160).region("text", 80, 165, 100, 178)
    p.line("B", 52, 102).line("The next part", 75, 102).line("An answer ends here", 82, 132).line(".", 84, 167)


def notes(p):
    p.region("footer", 40, 700, 560, 730).region("footnote", 40, 600, 560, 615).region("text", 40, 100, 560, 120).region("page_number", 290, 760, 310, 775).region("header", 40, 10, 560, 25)
    p.line("1 See the second chapter of the book.", 42, 702, 8).line("* Not so.", 42, 602, 8).line("Body text.", 42, 102).line("17", 295, 762).line("A running head", 42, 12)


CASES = {
    "items": items,
    "dialogue": lambda p: p.region("text", 40, 90, 560, 400).line("1 Ann: Where is it?", 50, 100).line("Ben: Over there.", 50, 114),
    "detected": lambda p: two_columns(p, True),
    "undetected": lambda p: two_columns(p, False),
    "blank": lambda p: p.line("He", 72, 100).word("home.", 210, 100).rule(95, 109, 205, 110),
    "underlined": lambda p: p.line("Look closely", 72, 100).rule(72, 109.5, 72 + 6 * 12, 110),
    "leader": lambda p: p.region("contents", 60, 90, 560, 120).line("Preface", 72, 100).word("9", 500, 100).rule(125, 109, 495, 110),
    "ruled": ruled,
    "white": lambda p: grid(p, [["Word", "Sense"], ["Oath", "A promise"], ["Deed", "A paper"]], (60, 260), 300, 20).region("table", 50, 290, 420, 360),
    # a row that goes on below, told by its empty first cell
    "long row": lambda p: grid(p, [["Word", "Sense"], ["Oath", "A promise that"]], (60, 260), 300, 14).line("binds", 260, 326).line("Deed", 60, 340).line("A paper", 260, 340).region("table", 50, 290, 420, 360),
    "no columns": lambda p: p.line("only one column of words", 60, 100).line("and one more line", 60, 116).region("table", 50, 90, 300, 130),
    "no words": lambda p: p.region("table", 50, 90, 300, 130),
    "heads": heads,
    "grid by rules": undetected_grid,
    "box": lambda p: p.line("A box around prose", 90, 150).line("isn't a table", 90, 200).rule(80, 120, 81, 270, True).rule(560, 120, 561, 270, True).rule(80, 120, 561, 121).rule(80, 269, 561, 270),
    "labels": labels,
    "letter": lambda p: p.region("text", 50, 100, 62, 115, order=5).region("text", 80, 100, 400, 140, order=1).line("C", 52, 102).line("Opens this text", 82, 102),
    "cut sentence": lambda p: p.region("text", 40, 50, 560, 70).region("figure", 40, 100, 300, 200).region("text", 40, 210, 400, 225).region("text", 40, 240, 560, 260).line("The bridge,", 42, 52).line("Figure 3.2: A bridge", 42, 212).line("which stood long.", 42, 242),
    "picture words": lambda p: p.region("figure", 40, 100, 300, 200).line("WAY OUT", 60, 120).line("9", 80, 160),
    "notes": notes,
    "empty": lambda p: p,
    "spaces": lambda p: p.word(" ", 10, 10).line("x y", 40, 40),
}


def book(which=CASES):
    p = Page()
    for k, name in enumerate(which):
        CASES[name](p.page() if k else p)
    return p


@pytest.fixture(scope="module")
def blocks(spark):
    """The blocks of all cases, each a page of one book."""
    found = {name: [] for name in CASES}
    for b in book().blocks(spark):
        found[list(CASES)[b.page_number - 1]].append(b)
    return found


def text_of(b):
    return [[c.text for c in r] for r in b.rows]


def test_text_of_items(blocks):
    got = blocks["items"]
    assert [(b.type, b.text, b.list_marker) for b in got] == [
        ("paragraph", "A well-known case here\nfar", None), ("list", "1. one thing", "1."), ("list", "2. another that goes on", "2."), ("heading", "Run in", None), ("paragraph", "Plain text after it.", None)]
    assert [(s.start, s.end, s.bold) for s in got[0].styles] == [(13, 17, True)] and got[3].level == 3
    assert [b.ord for b in got] == list(range(5)) and got[0].y1 == 700.0


def test_dialogue(blocks):
    got = blocks["dialogue"]
    assert [(b.type, b.role, b.indent_level) for b in got] == [("list", None, 0), ("list", "dialogue", 1)]
    assert [(s.start, s.end) for s in got[0].styles] == [(2, 6)]


@pytest.mark.parametrize("name", ["detected", "undetected"])
def test_two_columns_and_strays(blocks, name):
    got = [b.text for b in blocks[name]]
    assert got[0] == "The title of the page" and got[1].startswith("left line 0") and got[2].startswith("right line 0") and got[3].startswith("a footer") and len(got) == 4


def test_blanks_underlines_and_leaders(spark, blocks):
    words = C.with_blanks(C.with_ruled_tables(C.gathered(*book(("blank", "underlined", "leader")).tables(spark)))).select("page_number", F.explode("words").alias("w")).select("page_number", "w.*").collect()
    assert [(w.page_number, w.text) for w in words if w.blank] == [(1, "______")]
    assert {w.page_number for w in words if w.underline} == {2} and sum(w.underline for w in words) == 2
    assert [b.text for b in blocks["blank"]] == ["He ______ home."] and {b.role for b in blocks["leader"]} == {"contents"}


def test_tables(blocks):
    (a,), (b,), (c,) = blocks["ruled"], blocks["white"], blocks["long row"]
    assert text_of(a) == ROWS and a.has_header and a.confidence == 0.9 and [x.is_header for x in a.rows[0]] == [True] * 3 and not a.rows[1][0].is_header
    assert text_of(b) == [["Word", "Sense"], ["Oath", "A promise"], ["Deed", "A paper"]] and b.confidence == 0.8
    assert text_of(c) == [["Word", "Sense"], ["Oath", "A promise that binds"], ["Deed", "A paper"]]
    assert [(x.text, x.role, len(x.warnings)) for x in blocks["no columns"]] == [("only one column of words", "table_row", 1), ("and one more line", "table_row", 0)]
    assert [x.type for x in blocks["no words"]] == ["image"]
    (h,) = blocks["heads"]
    assert h.has_header and [len(r) for r in h.rows] == [4] * 4 and h.rows[1][0].text == ""


def test_grids_found_by_their_rules(blocks):
    assert [(b.type, text_of(b)) for b in blocks["grid by rules"]] == [("table", [["Stage", "When", "State"], ["Draft", "May", "Done"]])]
    assert {b.type for b in blocks["box"]} == {"paragraph"}


def test_marginal_labels_and_lone_stops(blocks):
    assert [(b.type, b.text) for b in blocks["labels"]] == [("heading", "B The next part"), ("paragraph", "An answer ends here .")]
    assert [(b.type, b.text) for b in blocks["letter"]] == [("heading", "C"), ("paragraph", "Opens this text")]


def test_pictures_captions_and_sentences(blocks):
    assert [(b.type, b.text) for b in blocks["cut sentence"]] == [("paragraph", "The bridge, which stood long."), ("image", None), ("caption", "Figure 3.2: A bridge")]
    assert [(b.type, b.role, b.text) for b in blocks["picture words"]] == [("image", None, None), ("caption", "figure_text", "WAY OUT 9")]


def test_notes_furniture_and_numbers(blocks):
    got = blocks["notes"]
    assert {(b.type, b.role) for b in got[:3]} == {("aside", "page_number"), ("aside", "running_text"), ("paragraph", None)}
    assert [b.text for b in got[3:]] == ["* Not so.", "1 See the second chapter of the book."] and {b.type for b in got[3:]} == {"footnote"}


def test_odd_pages(blocks):
    assert blocks["empty"] == [] and [b.text for b in blocks["spaces"]] == ["x y"]


def test_artwork(spark):
    s = spark.createDataFrame([("d", 1, k, float(x), float(y), float(x + 60), float(y + 60)) for k, (x, y) in enumerate([(50, 50), (112, 50), (50, 113), (400, 400)])] + [("d", 1, 9, 500.0, 700.0, 505.0, 705.0)], "doc_id string, page_number int, shape_id int, x0 double, y0 double, x1 double, y1 double")
    got = B.clusters(s, spark.createDataFrame([("d", 1, 600.0, 400.0)], PAGES)).collect()
    assert sorted((r.x0, r.y0, r.x1, r.y1) for r in got) == [(50.0, 50.0, 172.0, 173.0)]
