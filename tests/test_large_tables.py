"""Tables of thousands of rows: steps that grow with a table's cells, not with their square."""

import time

import numpy as np
from pyspark.sql import functions as F

from quillspan.functions import tables as B, text as X
from quillspan.operators import boxes as O, grids as T, layout as L, pages as P
from quillspan.plans import catalog
from quillspan.sources import html as H


def test_a_grid_of_thousands_of_rows(spark):
    n = 6000
    word = "word_id int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, confidence double"
    said = [["Key", "Name"], *([f"k{r}", f"name {r}"] for r in range(1, n))]
    words = [(2 * r + c, t, x, 100.0 + 20 * r, x + 6.0 * len(t), 110.0 + 20 * r, 10.0, r == 0, 1.0) for r, row in enumerate(said) for c, (t, x) in enumerate(zip(row, (60.0, 200.0)))]
    page = [(60.0, 100.0, 300.0, 20.0 * n + 110, words[::-1], ([], []))]
    region = spark.createDataFrame(page, f"x0 double, y0 double, x1 double, y1 double, words array<struct<{word.replace(' ', ':').replace(',:', ',')}>>, ruling struct<vx:array<double>,hy:array<double>>")
    start = time.time()
    g = T.built(region).select("grid.has_header", F.transform("grid.rows", lambda r: F.transform(r, lambda c: c["text"])).alias("rows")).first()
    assert g.has_header and g.rows == said and time.time() - start < 40


def test_recognised_words_are_not_shuffled(spark):
    """A line of many words and tokens is worked out in its row, with the same words as a short one."""
    n = 30_000
    text = " ".join(f"w{k}" for k in range(n))
    rows = [(1, text, [(f"w{k}", float(k), k + 0.5) for k in range(n)]), (2, text, None), (3, "a bc", [("a", 0.0, 1.0), ("b", 2.0, 3.0), ("c", 3.0, 4.0)]), (4, "a b", [("a", 0.0, 1.0)]), (5, None, None), (6, " ", [])]
    x = spark.createDataFrame(rows, "line_id int, text string, tokens array<struct<text:string,x0:double,x1:double>>")
    x = x.selectExpr("1L as doc_id", "1 as page_number", "*", "0D as x0", "0D as y0", "100D as x1", "10D as y1", "0.9D as confidence")
    start = time.time()
    for lines in (x, x.drop("tokens")):
        words = L.ocr_words(lines)
        assert "Exchange" not in words._jdf.queryExecution().executedPlan().toString()
        got = {(r.line_id, r.k): (r.text, r.x0, r.x1) for r in words.collect()}
        assert len(got) == 2 * n + 4 and all(got[i, k][0] == f"w{k}" for i in (1, 2) for k in range(n))
        if "tokens" in lines.columns:
            assert got[1, n - 1] == (f"w{n - 1}", n - 1.0, n - 0.5) and (got[3, 0], got[3, 1]) == (("a", 0.0, 1.0), ("bc", 2.0, 4.0))
        assert got[2, n - 1][2] == 100.0 and got[4, 1] == ("b", 2 * (100 / 3), 100.0)
    assert time.time() - start < 40


def grid(n: int):
    """n rows of two cells as a column: every second first cell reaches over the next row."""
    cell = lambda text, down: F.struct(text.alias("text"), down.alias("row_span"), F.lit(1).alias("col_span"), F.lit(False).alias("is_header"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda r: F.array(cell(r.cast("string"), F.when(r % 2 == 0, 2).otherwise(1)), cell(F.lit("b"), F.lit(1))))


def test_visible_cells_of_a_long_grid(spark):
    n, start = 30_000, time.time()
    v = spark.range(1).select(B.visible_cells(grid(n)).alias("v")).first().v
    assert [(c.r, c.c, c.rs) for c in v] == [(r, c, 2 if c == 0 else 1) for r in range(n) for c in range(2) if c or r % 2 == 0] and time.time() - start < 30


def test_quality_of_a_long_grid(spark):
    start = time.time()
    assert spark.range(1).select(grid(40_000).alias("g")).select(B.quality(F.col("g"), F.lit(True)).alias("q")).first().q == 1.0 and time.time() - start < 20


def test_reading_order_of_many_boxes(spark):
    n, start = 60_000, time.time()
    k = np.arange(n)
    b = np.stack([40.0 + 180 * (k % 3), 30.0 * (k // 3) + 7 * (k % 3), 190.0 + 180 * (k % 3), 30.0 * (k // 3) + 7 * (k % 3) + 24], axis=1)
    assert O.reading_order(b) == [*range(0, n, 3), *range(1, n, 3), *range(2, n, 3)] and time.time() - start < 30


def test_letters_of_pages_stay_where_they_are(spark, tmp_path):
    rows = [(k, "turned letters that run on and on " * 300) for k in range(4)] + [(4, ""), (5, None), (6, "a b c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    q = catalog.queries()["reading_quarters"](spark, str(tmp_path))
    assert "Window" not in q._jdf.queryExecution().optimizedPlan().toString()
    assert {r.doc_id: r.quarter for r in q.collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0, 6: 0}


def test_character_classes_hold_for_all_characters(spark):
    """Counts by what is left of a text against each character by itself, for all of the first plane and some beyond."""
    chars = [chr(k) for k in range(0x10000) if not 0xD800 <= k < 0xE000] + ["\U0001D400", "\U0001E900", "\U000E0001", "\U0010FFFD"]
    x = spark.createDataFrame([(c,) for c in chars], "c string")
    rtl, letter = F.col("c").rlike(f"[{X.RTL}]"), F.col("c").rlike(r"\p{L}")
    counts = X.script_counts(F.col("c"))
    assert not x.filter((counts["rtl"] != rtl.cast("int")) | (counts["ltr"] != (letter & ~rtl).cast("int"))).count()
    hidden = F.col("c").rlike(rf"[{X.REPLACEMENT}\x{{0}}-\x{{8}}\x{{B}}\x{{C}}\x{{E}}-\x{{1F}}\x{{7F}}-\x{{A0}}\x{{AD}}\p{{Cf}}\p{{Co}}\p{{Cn}}\p{{Zl}}\p{{Zp}}]") | (F.col("c").rlike(r"\p{Zs}") & (F.col("c") != " "))
    replaced = F.col("c").rlike(rf"[{X.REPLACEMENT}\x{{E000}}-\x{{F8FF}}\x{{0}}-\x{{8}}\x{{B}}\x{{C}}\x{{E}}-\x{{1F}}]")
    kind = P.classify(F.col("c"), F.lit(0.0), F.lit(1))["classification"]
    want = F.when(hidden | replaced, "broken_digital").when(X.strip(F.col("c")) == "", "scanned").otherwise("native")
    assert not x.filter(kind != want).count()


def test_pages_leave_in_small_batches(spark):
    """Blocks of a few pages at a time, not of a whole batch."""
    page = "<h1>Head</h1><p>one</p><p>two</p>"
    got = H.read_html(spark.range(1, 1001).selectExpr("id as page_id", f"'{page}' as html")).select("*", F.spark_partition_id().alias("p"))
    assert got.count() == 3000 and H.PAGES_AT_ONCE <= 100
    assert [(r.ord, r.type, r.level, r.text) for r in got.filter("page_id = 7").orderBy("ord").collect()] == [(0, "heading", 1, "Head"), (1, "paragraph", None, "one"), (2, "paragraph", None, "two")]
    assert not H.read_html(spark.createDataFrame([(1, None), (2, "")], "page_id long, html string")).count()
