"""Queries on pages, blocks, words and regions."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import geometry as G
from ..operators import boxes as B, composition as C, flow as W, grids as T, layout as L, metrics as M, pages as P, review as V
from ..sources import html as H
from .text_queries import LINES_SQL, lines, pick, pick_sql, t

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT conv_id, turn + 1 AS page, role FROM conversations WHERE turn + 1 BETWEEN 2 AND 3")
def slice_range(spark, d):
    c = t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("source_page"), "role")
    docs = c.groupBy("doc_id").agg(F.lit("Talk").alias("title"), F.max("source_page").cast("int").alias("page_count"))
    b, _, _ = P.slice_range(2, 3, c, c.select("doc_id", F.col("source_page").alias("page_number")), docs)
    return b.select(F.col("doc_id").alias("conv_id"), F.col("source_page").alias("page"), "role")


@query("""
SELECT conv_id, 'Talk (pages 1–2, 4)' AS title, CAST(CASE WHEN count(*) FILTER (turn IN (0, 1, 3)) = 0 THEN 3 ELSE count(*) FILTER (turn IN (0, 1, 3)) END AS INTEGER) AS page_count
FROM conversations GROUP BY conv_id
""")
def slice_set(spark, d):
    c = t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("source_page"), "role")
    docs = c.groupBy("doc_id").agg(F.lit("Talk").alias("title"), F.max("source_page").cast("int").alias("page_count"))
    _, _, out = P.slice_set({1, 2, 4}, c, c.select("doc_id", F.col("source_page").alias("page_number")), docs)
    return out.select(F.col("doc_id").alias("conv_id"), "title", "page_count")


@query("""
WITH p AS (SELECT DISTINCT user_id, CAST(event_id % 97 AS BIGINT) AS page FROM events), i AS (SELECT *, page - row_number() OVER (PARTITION BY user_id ORDER BY page) AS g FROM p),
r AS (SELECT user_id, g, min(page) AS a, max(page) AS b FROM i GROUP BY ALL)
SELECT user_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '–' || b END, ', ' ORDER BY a) AS label FROM r GROUP BY user_id
""")
def slice_label(spark, d):
    return P.label_runs(t(spark, d, "events").select("user_id", (F.col("event_id") % 97).alias("page")), ["user_id"], "page")


@query("SELECT conv_id, turn + 1 AS page FROM conversations GROUP BY ALL")
def page_list(spark, d):
    b = t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("source_page"))
    return V.page_list(b).select(F.col("doc_id").alias("conv_id"), F.col("source_page").alias("page"))


KINDS = ["page_marker", "heading", "paragraph", "image", "table", "paragraph", "paragraph"]
_BLOCKS = f"""{LINES_SQL}, t AS (SELECT *, {pick_sql(KINDS, 'k')} AS type FROM l),
b AS (SELECT doc_id, k AS ord, 'b' || k AS id, type, CASE WHEN (doc_id + k) % 61 = 0 THEN 0 ELSE 1 + k // 7 END AS source_page, (doc_id + k) % 5 <> 0 AS has_asset, (doc_id + k) % 3 <> 0 AS has_table,
    CASE WHEN type = 'page_marker' AND doc_id % 4 <> 0 THEN 1 + k // 7 END AS page_marker, CASE WHEN (doc_id + k) % 9 <> 0 THEN 800.0 - 37 * ((k * 5 + doc_id) % 20) END AS y1, CASE WHEN k = 1 THEN 'title' END AS role, CASE WHEN type = 'heading' THEN 10.0 + (doc_id + k) % 12 END AS size FROM t)"""


def _blocks(spark, d):
    """Documents' lines as blocks, seven to a page: some without what their kind needs, some out of order."""
    k, n = F.col("k"), F.col("doc_id") + F.col("k")
    kind, page = pick(KINDS, k), (1 + F.floor(k / 7)).cast("long")
    return lines(spark, d).select(
        "doc_id", k.alias("ord"), F.concat(F.lit("b"), k.cast("string")).alias("id"), kind.alias("type"), F.when(n % 61 == 0, 0).otherwise(page).cast("long").alias("source_page"), F.when(n % 5 != 0, "x").alias("image_asset"), F.when(n % 3 != 0, "x").alias("table_structure"),
        F.when((kind == "page_marker") & (F.col("doc_id") % 4 != 0), page).alias("page_marker"), F.when(n % 9 != 0, 800.0 - 37 * ((k * 5 + F.col("doc_id")) % 20)).alias("y1"), F.when(k == 1, "title").alias("role"), F.when(kind == "heading", (10 + n % 12).cast("double")).alias("size"))


@query(f"""WITH {_BLOCKS}, x AS (SELECT *, CASE WHEN source_page < 1 THEN 'source_page' WHEN type = 'image' AND NOT has_asset THEN 'image_asset' WHEN type = 'table' AND NOT has_table THEN 'table_structure' WHEN type = 'page_marker' AND page_marker IS NULL THEN 'page_marker' END AS problem FROM b)
SELECT doc_id, arg_min(id, ord) AS block_id, arg_min(problem, ord) AS problem FROM x WHERE problem IS NOT NULL GROUP BY doc_id""")
def validate_ir(spark, d):
    return P.first_violation(_blocks(spark, d))


@query(f"""WITH {_BLOCKS}, c AS (SELECT * FROM b WHERE type <> 'page_marker'), w AS (SELECT *, lag(source_page) OVER w AS p, lag(y1) OVER w AS y, row_number() OVER w AS n FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY ord))
SELECT doc_id, coalesce(round_even(avg(CASE WHEN n > 1 THEN CASE WHEN source_page > p OR (source_page = p AND (y IS NULL OR y1 IS NULL OR y1 <= y + 1)) THEN 1.0 ELSE 0.0 END END), 3), 1.0) AS score FROM w GROUP BY doc_id""")
def reading_plausibility(spark, d):
    return M.plausibility(_blocks(spark, d))


@query(f"""WITH {_BLOCKS} SELECT doc_id, id, CAST(CASE WHEN size IS NULL THEN NULL WHEN role = 'title' OR size >= 1.7 * 11.0 THEN 1 WHEN size >= 1.2 * 11.0 THEN 2 ELSE 3 END AS INTEGER) AS level FROM b""")
def heading_levels(spark, d):
    b = _blocks(spark, d).withColumn("level", F.lit(None).cast("int"))
    sizes = b.filter("size is not null").select("doc_id", "id", "size")
    body = t(spark, d, "documents").select("doc_id").distinct().withColumn("body", F.lit(11.0))
    return P.heading_levels(b, sizes, body).select("doc_id", "id", "level")


@query(f"""WITH {_BLOCKS}, p AS (SELECT DISTINCT doc_id, source_page AS n FROM b), m AS (SELECT DISTINCT doc_id, page_marker AS n FROM b WHERE type = 'page_marker')
SELECT p.doc_id, round_even(CAST(count(m.n) AS DOUBLE) / count(*), 3) AS score FROM p LEFT JOIN m ON p.doc_id = m.doc_id AND p.n = m.n GROUP BY p.doc_id""")
def anchor_fidelity(spark, d):
    b = _blocks(spark, d)
    return M.anchor_fidelity(b.select("doc_id", F.col("source_page").alias("page_number")).distinct(), b)


@query("""
WITH e AS (SELECT l_suppkey AS doc_id, l_returnflag AS digest, count(*) AS e FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL), f AS (SELECT l_suppkey AS doc_id, l_returnflag AS digest, count(*) AS f FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)
SELECT doc_id, CAST(sum(e) AS BIGINT) AS expected, CAST(sum(least(e, coalesce(f, 0))) AS BIGINT) AS retained FROM e LEFT JOIN f USING (doc_id, digest) GROUP BY doc_id
""")
def image_multiset(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_returnflag").alias("digest"), "l_linestatus")
    return M.retained(x.filter("l_linestatus = 'O'"), x.filter("l_linestatus = 'F'"))


_PAGE = "CASE WHEN n > 0 AND bad / n > 0.15 THEN 'broken_digital' WHEN blank THEN 'scanned' WHEN raster > 0.60 THEN 'mixed' ELSE 'native' END"


@query("""
SELECT source, CASE WHEN trim(text) = '' THEN 'scanned' WHEN (doc_id % 10) / 10.0 > 0.60 THEN 'mixed' ELSE 'native' END AS classification, count(*) AS n_pages FROM documents GROUP BY ALL
""")
def classification_hist(spark, d):
    x = t(spark, d, "documents").withColumn("c", P.classify(F.col("text"), (F.col("doc_id") % 10) / 10.0, F.lit(1)))
    return P.histogram(x.select(F.col("source").alias("doc_id"), F.col("c.classification").alias("classification"))).withColumnRenamed("doc_id", "source")


@query("""
SELECT doc_id, CASE WHEN doc_id % 7 > 0.15 * n_chars THEN 'broken_digital' WHEN n_chars < CASE WHEN (doc_id % 10) / 10.0 > 0.5 THEN 40 ELSE 1 END THEN 'scanned' WHEN (doc_id % 10) / 10.0 > 0.60 THEN 'mixed' ELSE 'native' END AS route FROM documents
""")
def routing(spark, d):
    x = t(spark, d, "documents")
    return x.select("doc_id", P.route(F.col("n_chars"), F.col("doc_id") % 7, (F.col("doc_id") % 10) / 10.0).alias("route"))


def _words(spark, d):
    """Words as boxes from line items: an order is a page, a line item a word.  Line numbers repeat within an order, so words are numbered."""
    x = t(spark, d, "lineitem").withColumn("_word", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")))
    x0, y0 = (F.col("l_partkey") % 500).cast("double"), (F.col("l_suppkey") % 700).cast("double")
    return x.select(F.lit("d").alias("doc_id"), F.col("l_orderkey").alias("page_number"), F.col("_word").alias("word_id"), x0.alias("x0"), y0.alias("y0"), (x0 + 40).alias("x1"), (y0 + 12).alias("y1"), F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("text"), F.lit(10.0).alias("size"), F.lit(False).alias("blank"), F.lit(1.0).alias("confidence"))


def _regions(spark, d):
    """Four regions a page, overlapping at the middle."""
    o = t(spark, d, "orders")
    k = o.select(F.lit("d").alias("doc_id"), F.col("o_orderkey").alias("page_number"), F.explode(F.array(*map(F.lit, range(4)))).alias("region_id"))
    x0, y0 = (F.col("region_id") % 2 * 260).cast("double"), (F.floor(F.col("region_id") / 2) * 340).cast("double")
    return k.select("*", x0.alias("x0"), y0.alias("y0"), (x0 + 300).alias("x1"), (y0 + 380).alias("y1"), F.when(F.col("region_id") == 3, "figure").otherwise("text").alias("kind"), F.lit(False).alias("decorative"))


_ASSIGN = """
WITH w AS (SELECT l_orderkey AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS INTEGER) AS word, CAST(l_partkey % 500 AS DOUBLE) AS x0, CAST(l_suppkey % 700 AS DOUBLE) AS y0 FROM lineitem),
r AS (SELECT o_orderkey AS page, k AS region, CAST(k % 2 * 260 AS DOUBLE) AS x0, CAST(k // 2 * 340 AS DOUBLE) AS y0 FROM orders, (SELECT unnest([0, 1, 2, 3]) AS k)),
s AS (SELECT w.page, w.word, r.region, greatest(0, least(w.x0 + 40, r.x0 + 300) - greatest(w.x0, r.x0)) * greatest(0, least(w.y0 + 12, r.y0 + 380) - greatest(w.y0, r.y0)) / (40.0 * 12.0) AS share FROM w JOIN r USING (page)),
b AS (SELECT *, row_number() OVER (PARTITION BY page, word ORDER BY share DESC, region) AS n FROM s WHERE share > 0.5)
"""


@query(_ASSIGN + "SELECT w.page, w.word, b.region FROM w LEFT JOIN b ON w.page = b.page AND w.word = b.word AND b.n = 1")
def word_region_assign(spark, d):
    return L.assign_words(_words(spark, d), _regions(spark, d)).select(F.col("page_number").alias("page"), F.col("word_id").alias("word"), F.col("region_id").alias("region"))


@query(_ASSIGN + "SELECT w.page, w.word FROM w ANTI JOIN b ON w.page = b.page AND w.word = b.word")
def orphans(spark, d):
    return L.orphans(_words(spark, d), _regions(spark, d)).select(F.col("page_number").alias("page"), F.col("word_id").alias("word"))


@query(_ASSIGN + "SELECT r.page, r.region FROM r ANTI JOIN (SELECT DISTINCT page, region FROM s WHERE share > 0.5) b ON r.page = b.page AND r.region = b.region")
def empty_regions(spark, d):
    return L.empty_regions(_regions(spark, d), _words(spark, d)).select(F.col("page_number").alias("page"), F.col("region_id").alias("region"))


@query("""
WITH w AS (SELECT l_orderkey AS page, l_linenumber AS word, CAST(l_partkey % 500 AS DOUBLE) AS x0 FROM lineitem),
s AS (SELECT *, max(x0 + 40) OVER (PARTITION BY page ORDER BY x0, x0 + 40 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w)
SELECT page, CAST(count(*) FILTER (reach IS NULL OR x0 > reach + 6) AS BIGINT) AS n_groups FROM s GROUP BY page
""")
def interval_groups(spark, d):
    return L.interval_groups(_words(spark, d), L.PAGE, "x0", "x1", 6.0).groupBy(F.col("page_number").alias("page")).agg((F.max("grp") + 1).cast("long").alias("n_groups"))


@query("""
SELECT l_orderkey AS page, median(CAST(l_quantity AS DOUBLE)) AS size, sum(CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END) * 2 > sum(2) AS bold, min(CAST(l_suppkey % 700 AS DOUBLE)) AS y0, max(CAST(l_partkey % 500 AS DOUBLE) + 40) AS x1 FROM lineitem GROUP BY 1
""")
def line_aggregates(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_number"), F.lit("d").alias("doc_id"), (F.col("l_partkey") % 500).cast("double").alias("x0"), (F.col("l_suppkey") % 700).cast("double").alias("y0"), F.col("l_quantity").alias("size"), (F.col("l_returnflag") == "R").alias("bold"), F.lit(False).alias("blank"), F.lit("xx").alias("text"), F.lit(1.0).alias("confidence"))
    x = x.withColumns({"x1": F.col("x0") + 40, "y1": F.col("y0") + 12})
    return L.line_aggregates(x, L.PAGE).select(F.col("page_number").alias("page"), "size", "bold", "y0", "x1")


@query("""
SELECT p_partkey, least(a, b, c, e) AS scale FROM (SELECT p_partkey, 150.0 / 72 AS a, 9999 / (p_size * 30.0) AS b, 9999 / (p_size * 42.0) AS c, 0.99 * sqrt(16000000 / (p_size * 30.0 * (p_size * 42.0))) AS e FROM part)
""")
def render_scale(spark, d):
    return t(spark, d, "part").select("p_partkey", G.render_scale(F.col("p_size") * 30.0, F.col("p_size") * 42.0, F.lit(150.0)).alias("scale"))


@query("SELECT l_orderkey, l_linenumber, CAST(greatest(0, least(4, ceil((l_quantity - 5) / greatest(1.0, 1.4 * l_tax * 100) - 0.35))) AS INTEGER) AS indent FROM lineitem")
def indent_levels(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", G.indent_level(F.col("l_quantity"), F.lit(5), F.col("l_tax") * 100).alias("indent"))


@query()
def html_blocks(spark, d):
    return H.read_html(t(spark, d, "pages"))



def _set(words, x0, y0, width, **more):
    """Words (doc_id, page_number, word_id, text) set on a page as boxes of 12 points' height, and a word's other properties."""
    box = {"x0": x0.cast("double"), "y0": y0.cast("double"), "x1": (x0 + width).cast("double"), "y1": (y0 + 12).cast("double")}
    rest = {"size": F.lit(10.0), **{f: F.lit(False) for f in ("bold", "italic", "underline", "blank", "visual_order")}, "confidence": F.lit(1.0)}
    return words.withColumns(box | rest | more)


def _item_words(spark, d):
    x = t(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("doc_id"), F.lit(1).alias("page_number"), F.posexplode(F.split("text", r"\s+")).alias("word_id", "text"))
    return x.filter("text <> ''")


_ITEM_WORDS = r"""w AS (SELECT * FROM (SELECT CAST(item_id AS VARCHAR) AS doc_id, unnest(string_split_regex(text, '\s+')) AS text, unnest(range(len(string_split_regex(text, '\s+')))) AS k FROM benchmark) WHERE text <> '')"""


def _in_lines(spark, d):
    k = F.col("word_id")
    return _set(_item_words(spark, d), 72 + 60 * (k % 7), 90 + 14 * F.floor(k / 7) + k % 3, 55)


@query(f"WITH {_ITEM_WORDS} SELECT doc_id, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY k // 7) AS INTEGER) AS line, string_agg(text, ' ' ORDER BY k) AS text FROM w GROUP BY doc_id, k // 7")
def page_lines(spark, d):
    """Lines found among words that stand up to two points off their line, against the lines they were set in."""
    key = ["doc_id", "page_number"]
    w = W.line_facts(W.lines(W.with_rows(_in_lines(spark, d), key), key, 9.0), key)
    return w.filter("at = 1").select("doc_id", "line", F.col("l_text").alias("text"))


@query(f"""
WITH {_ITEM_WORDS}, s AS (SELECT doc_id, k, text, CASE WHEN k % 8 >= 4 THEN 1 ELSE 0 END AS side, 40 + 290 * CASE WHEN k % 8 >= 4 THEN 1 ELSE 0 END + 50 * (k % 4) AS x0 FROM w),
g AS (SELECT doc_id, side, sum(length(text)) AS chars, max(x0 + 45) - min(x0) AS width, min(x0) AS a, max(x0 + 45) AS b, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT doc_id, sum(n) AS n, bool_and(chars >= 0.2 * total AND width >= 0.2 * span) AND count(*) = 2 AND sum(n) >= 6 AS parted FROM (SELECT *, greatest(1, sum(chars) OVER (PARTITION BY doc_id)) AS total, max(b) OVER (PARTITION BY doc_id) - min(a) OVER (PARTITION BY doc_id) AS span FROM g) GROUP BY doc_id)
SELECT doc_id, CAST(k AS INTEGER) AS word_id, CAST(CASE WHEN parted THEN side ELSE 0 END AS INTEGER) AS col FROM s JOIN p USING (doc_id)
""")
def page_columns(spark, d):
    """Columns found among words, against the two columns they were set in."""
    k = F.col("word_id")
    w = _set(_item_words(spark, d), 40 + 290 * (k % 8 >= 4).cast("int") + 50 * (k % 4), 90 + 14 * F.floor(k / 8), 45)
    return W.columns(w, ["doc_id", "page_number"]).select("doc_id", "word_id", "col")


@query("""
WITH c AS (SELECT c_nationkey AS k, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS n FROM customer)
SELECT k AS n_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY k ORDER BY n % 3, n) - 1 AS INTEGER) AS place FROM c
""")
def boxes_in_order(spark, d):
    """Places in reading order of boxes set in three columns, their rows at different heights."""
    n = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    c = t(spark, d, "customer").select("c_nationkey", "c_custkey", n.alias("n"))
    x0, y0 = 40 + 180 * (F.col("n") % 3), 30 * F.floor(F.col("n") / 3) + 7 * (F.col("n") % 3)
    box = F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + 150).cast("double").alias("x1"), (y0 + 24).cast("double").alias("y1"))
    page = c.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", box.alias("box")))).alias("b")).withColumn("read", B.order_of(F.col("b")["box"], F.lit(False)))
    return page.select(F.col("c_nationkey").alias("n_nationkey"), F.posexplode(F.transform("read", lambda i: F.get("b", i)["c_custkey"])).alias("place", "c_custkey")).select("n_nationkey", "c_custkey", "place")


@query("""
WITH c AS (SELECT c_nationkey AS k, c_custkey, c_name, c_mktsegment FROM customer)
SELECT k AS n_nationkey, 'Key | Name | Segment' || chr(10) || string_agg(c_custkey || ' | ' || c_name || ' | ' || c_mktsegment, chr(10) ORDER BY c_custkey) AS grid, TRUE AS has_header, CAST(0.8 AS DOUBLE) AS confidence FROM c GROUP BY k
""")
def build_table(spark, d):
    """Grids found among words without rules, against the tables that were set: one for each nation, a customer to a row."""
    c = t(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey", F.array(F.col("c_custkey").cast("string"), "c_name", "c_mktsegment").alias("row"))
    head = t(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey")).distinct().select("n_nationkey", F.lit(-1).cast(c.schema["c_custkey"].dataType).alias("c_custkey"), F.array(*map(F.lit, ("Key", "Name", "Segment"))).alias("row"))
    r = F.row_number().over(Window.partitionBy("n_nationkey").orderBy("c_custkey")) - 1
    w = c.union(head).withColumn("r", r).select("n_nationkey", "r", F.posexplode("row").alias("c", "text")).withColumn("word_id", (F.col("r") * 3 + F.col("c")).cast("int"))
    x0 = F.element_at(F.array(F.lit(60), F.lit(200), F.lit(400)), F.col("c") + 1)
    w = _set(w, x0, 100 + 20 * F.col("r"), 6 * F.length("text"), bold=F.col("r") == 0)
    page = w.groupBy("n_nationkey").agg(F.collect_list(F.struct("word_id", "text", "x0", "y0", "x1", "y1", "size", "bold", "confidence")).alias("words"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    none = F.struct(F.array().cast("array<double>").alias("vx"), F.array().cast("array<double>").alias("hy"))
    g = T.built(page.withColumn("ruling", none))
    return g.select("n_nationkey", F.array_join(F.transform("grid.rows", lambda x: F.array_join(F.transform(x, lambda c: c["text"]), " | ")), "\n").alias("grid"), "grid.has_header", "grid.confidence")


@query(f"WITH {_ITEM_WORDS} SELECT doc_id, string_agg(text, '' ORDER BY k) AS letters FROM w GROUP BY doc_id")
def assemble_pages(spark, d):
    """Whole pages, each an item's words in lines, with a region around the first half and a rule far below: every word comes back once,
    in order."""
    w = _in_lines(spark, d)
    pages = w.groupBy("doc_id", "page_number").agg(F.lit(595.0).alias("width"), (F.max("y1") + 100).alias("height"), F.max("y1").alias("_last"))
    top = (90 + (F.col("_last") - 90) / 2 - 1).alias("y1")
    regions = pages.select("doc_id", "page_number", F.lit(0).alias("region_id"), F.lit("text").alias("kind"), F.lit(60.0).alias("x0"), F.lit(80.0).alias("y0"), F.lit(560.0).alias("x1"), top, F.lit(0.9).alias("score"), F.lit(0.0).alias("ord"), F.lit("text").alias("label"), F.lit(False).alias("decorative"))
    rules = pages.select("doc_id", "page_number", F.lit(0).alias("rule_id"), F.lit(72.0).alias("x0"), (F.col("_last") + 60).alias("y0"), F.lit(172.0).alias("x1"), (F.col("_last") + 61).alias("y1"), F.lit(False).alias("vertical"))
    b = C.assemble_pages(w, regions, rules, pages.drop("_last"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "")
    return b.groupBy("doc_id").agg(F.regexp_replace(said, r"\s", "").alias("letters"))
