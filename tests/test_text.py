import pytest
from pyspark.sql import functions as F

from quillspan.functions import bidi, glyphs, text as X


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("text, direction, language", [
    ("هذا نص عربي كامل", "rtl", "ar"), ("An English sentence.", "ltr", "en"), ("قضية دونوغ ضد ستيفنسون Donoghue v Stevenson", "rtl", "ar"), ("", "ltr", "en"), ("--- 12345 ---", "ltr", "en"), (None, "ltr", "en"),
])
def test_direction(spark, text, direction, language):
    c = lambda t: X.script_counts(t)
    assert one(spark, text, lambda t: X.direction(c(t))) == direction
    assert one(spark, text, lambda t: X.language(c(t))) == language


def test_exact_counts_agree_on_letters(spark):
    t = "abc دون 12 שלום!"
    a = one(spark, t, X.script_counts)
    assert (a.rtl, a.ltr, a.digit, a.other) == bidi.counts(t)


def test_markers(spark):
    for text, want in (("• x", "•"), ("1.2) y", "1.2)"), ("2Anna: z", "2"), ("(iv) q", "(iv)"), ("plain", None), ("3.14159 is", None), ("*", "*")):
        assert one(spark, text, X.list_marker) == want
    r = spark.createDataFrame([("1.  Go on", "1.")], "t string, m string").select(X.split_marker(F.col("t"), F.col("m")).alias("s")).first().s
    assert tuple(r) == ("1.", "Go on")


def test_reordering(spark):
    painted = one(spark, "(ש) Smith v Jones\r\n", bidi.paint)
    assert painted.endswith("\r\n") and "Smith v Jones" in painted
    assert one(spark, "abc", lambda c: bidi.paint(c, "ltr")) == "abc" and one(spark, "(אב)", bidi.paint) == "(בא)"
    assert bidi.recognised("12 بأ") == "أب 12"
    assert bidi.logical("plain text") == "plain text"
    assert bidi.logical_line("هذا نص عربي") == "هذا نص عربي"


def test_labels_and_cleaning(spark):
    assert one(spark, "39", lambda t: X.page_label(F.lit(41), t)) == "Original page 41 (printed 39)"
    assert one(spark, "41", lambda t: X.page_label(F.lit(41), t)) == "Original page 41"
    assert one(spark, "a\x00b\x0bc", X.xml_clean) == "abc"
    assert one(spark, "<a> & 'b' ______", X.html_text).startswith("&lt;a&gt; &amp; &#x27;b&#x27; <span")
    assert one(spark, "Law_of_[site]_Contract - ", X.readable_title) == "Law of Contract"
    assert one(spark, "ab", glyphs.clean) == "a•b"


def test_segments_join_to_the_text(spark):
    t = "Hello bold and italic"
    styles = [(6, 10, True, False, False), (8, 14, False, True, False)]
    df = spark.createDataFrame([(t, styles)], "t string, s array<struct<start:int,end:int,bold:boolean,italic:boolean,underline:boolean>>")
    seg = df.select(X.styled_segments(F.col("t"), F.col("s")).alias("x")).first().x
    assert "".join(s.text for s in seg) == t
    assert [(s.text, s.tags) for s in seg] == [("Hello ", []), ("bo", ["b"]), ("ld", ["b", "i"]), (" and", ["i"]), (" italic", [])]


def test_edits(spark):
    df = spark.createDataFrame([("a", "paragraph", "new"), ("b", "paragraph", None)], "t string, k string, e string")
    assert [r.x for r in df.select(X.apply_edit(F.col("e"), F.col("k"), F.col("t")).alias("x")).collect()] == ["new", "b"]
    with pytest.raises(Exception, match="can't be edited"):
        spark.createDataFrame([("image", "x")], "k string, e string").select(X.apply_edit(F.col("e"), F.col("k"), F.lit(None).cast("string"))).collect()
