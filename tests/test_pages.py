import pytest
from pyspark.sql import functions as F

from quillspan import schema as S
from quillspan.operators import metrics as M, pages as P, review as V


def test_page_selection():
    assert P.page_selection(None, 3) is None and P.page_selection("  ", 3) is None
    assert P.page_selection("2-", 3) == {2, 3} and P.page_selection("-2", 3) == {1, 2}
    assert P.page_selection("1-5, 8, 11-13", 20) == {1, 2, 3, 4, 5, 8, 11, 12, 13}
    assert P.page_selection((1, 3), 3) == {1, 2, 3} and P.page_selection([1, 3], 3) == {1, 3}
    for bad in ("nonsense", "8", "3-1", "1,invalid", "1,", "-", [], [True], [0], [1, 4], (1, 4), "1 2"):
        with pytest.raises(ValueError):
            P.page_selection(bad, 3)
    assert P.runs_label({1, 2, 3, 5}) == "1–3, 5"


@pytest.fixture()
def three_pages(spark):
    rows = [("d", k, f"b{k}", t, x, p, m) for k, (t, x, p, m) in enumerate([("page_marker", None, 1, 1), ("paragraph", "One", 1, None), ("page_marker", None, 2, 2), ("heading", "Two", 2, None), ("paragraph", "Body", 2, None), ("page_marker", None, 3, 3), ("paragraph", "Three", 3, None)])]
    b = spark.createDataFrame(rows, "doc_id string, ord int, id string, type string, text string, source_page int, page_marker int")
    p = spark.createDataFrame([("d", k, "native") for k in (1, 2, 3)], "doc_id string, page_number int, classification string")
    d = spark.createDataFrame([("d", "Book", 3)], "doc_id string, title string, page_count int")
    return b, p, d


def test_slices(three_pages):
    b, p, d = P.slice_range(2, 2, *three_pages)
    assert (b.count(), p.count(), d.first().title, d.first().page_count) == (3, 1, "Book (Page 2)", 1)
    assert P.slice_range(2, 3, *three_pages)[0].count() == 5
    assert P.slice_set({1, 3}, *three_pages)[2].first().title == "Book (pages 1, 3)"
    for bad in ((0, 2), (3, 2)):
        with pytest.raises(ValueError):
            P.slice_range(*bad, *three_pages)
    with pytest.raises(ValueError):
        P.slice_set(set(), *three_pages)


def test_furniture(spark):
    rows = []
    for p in (1, 2, 3):
        rows += [("Law of Contract", "running_text", p), (str(40 + p), "page_number", p), (f"p{p}", None, p)]
    rows.insert(4, ("once", "running_text", 2))
    b = spark.createDataFrame([("d", k, *r) for k, r in enumerate(rows)], "doc_id string, ord int, text string, role string, source_page int")
    pages = spark.createDataFrame([("d", p) for p in (1, 2, 3)], "doc_id string, page_number int")
    kept, details = P.settle_furniture(b, pages)
    assert [(r.text, r.role) for r in kept.orderBy("ord").collect()] == [("p1", None), ("once", "page_note"), ("p2", None), ("p3", None)]
    x = {r.page_number: r for r in details.collect()}
    assert x[1].printed_page == "41" and x[3].running_text == ["Law of Contract"]


def test_validation_and_json(spark, three_pages):
    b, p, d = three_pages
    full = b.withColumns({c: F.lit(None).cast(t) for c, t in (f.strip().split(" ", 1) for f in S._split(S.BLOCK_FIELDS)) if c not in b.columns})
    full = full.withColumns({"confidence": F.lit(1.0), "extraction_method": F.lit("native"), "text_direction": F.lit("ltr"), "indent_level": F.lit(0)})
    assert S.violations(full).count() == 0 and S.violations(full.withColumn("indent_level", F.lit(9))).count() == 7
    pages = p.withColumns({c: F.lit(None).cast(t) for c, t in (f.strip().split(" ", 1) for f in S._split(S.PAGE_FIELDS)) if c not in p.columns})
    docs = d.withColumns({"source_file_name": F.lit("x.pdf"), "created_at": F.lit("2026-01-01")})
    j = S.to_json(full, pages, docs)
    back = S.read_json(j)
    assert [r.text for r in S.explode_blocks(back).orderBy("ord").collect()] == [None, "One", None, "Two", "Body", None, "Three"]
    with pytest.raises(Exception, match="unknown fields"):
        S.read_json(spark.createDataFrame([('{"metadata":{},"surprise":1}',)], "value string")).select("doc").collect()


def test_metrics(spark):
    df = spark.createDataFrame([("Hello world", "Hella world", 1 / 11, 0.5), ("", "", 0.0, 0.0), ("abc", "", 1.0, 1.0), ("", "x", 1.0, 1.0), ("für dich", "fur dich", 1 / 8, 0.5), ("a b c d e", "a b x d e", 1 / 9, 0.2)], "r string, h string, c double, w double")
    for r in df.select("*", M.cer(F.col("r"), F.col("h")).alias("gc"), M.wer(F.col("r"), F.col("h")).alias("gw")).collect():
        assert r.gc == pytest.approx(r.c) and r.gw == pytest.approx(r.w)
    assert M.edit_distance("kitten", "sitting") == 3 and M.lcs("abcbdab", "bdcaba") == 4
    o = spark.createDataFrame([(["a", "b"], ["a", "b"]), (["a", "b"], ["b", "a"]), (["a", "b"], ["a", "b", "a"]), ([], [])], "a array<string>, b array<string>")
    assert [r.x for r in o.select(M.order_accuracy("a", "b").alias("x")).collect()] == [1.0, 0.5, pytest.approx(2 / 3), 1.0]
    u = spark.createDataFrame([("131 one two 1 one", ["1", "one"])], "t string, u array<string>")
    assert u.select(M.unit_order("t", "u").alias("x")).first().x == [1, 0, 1]


def test_review(spark, three_pages):
    b, _, _ = three_pages
    b = b.withColumn("caption", F.lit(None).cast("string"))
    assert V.search(b, " THREE").count() == 1 and V.search(b, "t").count() == 0 and V.search(b, "body", page=1).count() == 0
    assert V.outline(b).count() == 4 and V.step(0, -1, 5) == 4 and V.readable(b).count() == 4
    x = spark.createDataFrame([("d", 0, ["b", "a"]), ("d", 1, ["a", "c"])], "doc_id string, ord int, warnings array<string>")
    assert V.warnings_in_order(x).first().warnings == ["b", "a", "c"]
    lang = spark.createDataFrame([("d", "en", 1), ("d", "ar", 0), ("d", "ar", 3), ("d", "en", 2)], "doc_id string, language string, ord int")
    assert V.dominant(lang, ["doc_id"], "language", "ord").first().language == "ar"


def test_classify(spark):
    df = spark.createDataFrame([("good text", 0.1, 3), ("", 0.0, 0), ("��ab", 0.0, 1), ("x", 0.9, 1), ("  ", 0.0, 1)], "t string, r double, o int")
    got = [tuple(r.c) for r in df.select(P.classify(F.col("t"), F.col("r"), F.col("o")).alias("c")).collect()]
    assert got == [("native", False, False), ("scanned", False, True), ("broken_digital", True, False), ("mixed", False, False), ("scanned", False, False)]
