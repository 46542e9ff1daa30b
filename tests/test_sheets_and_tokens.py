"""Sheets of large print, aligned tokens and hidden text: the cases that their docstrings define."""

from pyspark.sql import functions as F

from quillspan.operators import characters as H, layout as L, paging as S

TOKENS = "doc_id string, page_number int, line_id int, text string, x0 double, y0 double, x1 double, y1 double, confidence double, tokens array<struct<text:string,x0:double,x1:double>>"


def words(spark, rows):
    df = spark.createDataFrame([("d", 1, k, t, 0.0, 0.0, 100.0, 10.0, 0.9, tokens) for k, (t, tokens) in enumerate(rows)], TOKENS)
    out = {}
    for r in L.ocr_words(df).orderBy("line_id", "k").collect():
        out.setdefault(r.line_id, []).append((r.text, r.x0, r.x1))
    return [out.get(k, []) for k in range(len(rows))]


def test_tokens(spark):
    got = words(spark, [
        (" ab  cd ", [("a", 0.0, 1.0), (" b ", 1.0, 2.0), ("cd", 5.0, 7.0)]),  # two tokens make a word, spaces around tokens and words don't count
        ("ab cd", [("ab cd", 1.0, 9.0)]),  # a token with a space in it stays one word
        ("ab cd", [("abc", 0.0, 1.0), ("d", 1.0, 2.0)]),  # crosses a space: shared out
        ("ab  cd", [("ab cd", 0.0, 1.0)]),  # another space than the line's
        ("ab cd", [("ab", 0.0, 1.0)]),  # letters left over
        ("ab", [("ab", 0.0, 1.0), ("c", 1.0, 2.0)]),  # a token too many
        ("abcd", None), ("abcd", []), ("", [("a", 0.0, 1.0)]), (None, None), ("a", [("", 0.0, 1.0), (None, 0.0, 1.0), ("a", 4.0, 6.0)]),
        ("é\U0001f600 x", [("é", 0.0, 1.0), ("\U0001f600", 2.0, 3.0), ("x", 5.0, 6.0)]),
    ])
    shared = [("ab", 0.0, 40.0), ("cd", 60.0, 100.0)]
    assert got == [[("ab", 0.0, 2.0), ("cd", 5.0, 7.0)], [("ab cd", 1.0, 9.0)], shared, shared, shared, [("ab", 0.0, 100.0)], [("abcd", 0.0, 100.0)], [("abcd", 0.0, 100.0)], [], [], [("a", 4.0, 6.0)], [("é\U0001f600", 0.0, 3.0), ("x", 5.0, 6.0)]]


def test_hidden_text(spark):
    page = spark.createDataFrame([("d", 1, 100.0, 100.0), ("d", 2, 100.0, 100.0)], "doc_id string, page_number int, width double, height double")
    objects = spark.createDataFrame([("d", 1, 1, 0, "text", 0, 0.0, 0.0, 1.0, 1.0), ("d", 1, 2, 1, "image", None, 0.0, 0.0, 100.0, 90.0), ("d", 1, 3, 2, "text", 0, 0.0, 0.0, 1.0, 1.0), ("d", 1, 4, 3, "text", 3, 0.0, 0.0, 1.0, 1.0), ("d", 1, 5, 4, "image", None, 0.0, 0.0, 10.0, 10.0),
        ("d", 2, 1, 0, "text", 0, 0.0, 0.0, 1.0, 1.0), ("d", 1, 6, None, "text", 0, 0.0, 0.0, 1.0, 1.0)], "doc_id string, page_number int, object_id int, draw int, kind string, render_mode int, x0 double, y0 double, x1 double, y1 double")
    at = lambda p, o, ch, x=5.0, w=1.0: ("d", p, o, ch, x, 5.0, x + w, 6.0 if w else 5.0)
    chars = spark.createDataFrame([at(1, 1, "a"), at(1, 3, "b"), at(1, 4, "�"), at(1, 6, "d"), at(1, None, "e"), at(2, 1, "f"), at(1, 3, " "), at(1, 3, "out", 200.0), at(1, 3, "flat", 5.0, 0.0)], "doc_id string, page_number int, object_id int, ch string, x0 double, y0 double, x1 double, y1 double")
    assert {(r.page_number, r.object_id) for r in H.hidden_objects(objects, page).collect()} == {(1, 1), (1, 4), (1, 6)}
    assert sorted(r.ch for r in H.painted_chars(chars, objects, page).collect()) == ["b", "e", "f"]
    assert {r.page_number: (r.visible, r.broken, r.hidden) for r in H.page_text_counts(chars, objects, page).collect()} == {1: (4, 1, 3), 2: (1, 0, 0)}
    assert {r.page_number: r.visible for r in H.page_text_counts(chars).collect()} == {1: 7, 2: 1}


BLOCKS = "doc_id string, ord int, type string, level int, text string, source_page int, points double, page_marker int"


def placed(spark, rows, **k):
    df = spark.createDataFrame([("d", i, *r) for i, r in enumerate(rows)], BLOCKS)
    m = S.measured(df, **k)
    got = S.on_sheets(m).orderBy("ord").collect()
    return [(r.first_sheet, r.last_sheet) for r in got], S.sheets(S.on_sheets(m)).orderBy("sheet").collect()


def test_sheets(spark):
    height = S.frame("A4")[1]
    half = ("image", None, None, 1, height / 40, None)
    text = ("paragraph", None, "x", 2, None, None)
    head = ("heading", 2, "head", 2, None, None)
    # two pictures of half a sheet don't share one, as space comes after the first; a heading goes on with what follows it
    assert placed(spark, [half, half])[0] == [(1, 1), (2, 2)]
    full = ("image", None, None, 1, height / 20 - 60, None)
    got, sheets = placed(spark, [full, head, head, text])
    assert got == [(1, 1), (2, 2), (2, 2), (2, 2)]
    assert [(r.source_label, r.sheet_label) for r in sheets] == [("Original page 1", "Page 1 of 2"), ("Original page 2", "Page 2 of 2")]
    long = ("paragraph", None, "\n".join(["line"] * 200), 3, None, None)
    got, sheets = placed(spark, [text, long, text])
    assert got[0] == (1, 1) and got[1][0] == 1 and got[1][1] > 4 and got[2][0] == got[1][1]
    assert sheets[0].source_label == "Original pages 2–3" and sheets[1].source_label == "Original page 3"
    # a picture taller than a sheet takes one; headings at the end stay; every source page on a sheet of its own
    assert placed(spark, [("image", None, None, 1, 9999.0, None), head])[0] == [(1, 1), (2, 2)]
    marker = lambda n: ("page_marker", None, None, n, None, n)
    assert [p[0] for p in placed(spark, [marker(1), text, marker(2), text], sheet_per_page=True)[0]] == [1, 1, 2, 2]
    assert placed(spark, [])[0] == []


def test_fill_is_linear_and_whole():
    blocks = [(n % 7 + 1, 300 + n % 50, 10, 20, 400, n % 97 == 0) for n in range(200_000)]
    out = list(S.fill(iter(blocks), 10_000))
    assert len(out) == len(blocks) and all(a <= b for a, b in out) and all(x[1] <= y[0] for x, y in zip(out, out[1:]))
