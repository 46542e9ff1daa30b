"""Queries on reviewing, figures, recognised words, sizes and assets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G, text as X
from ..operators import layout as L, metrics as M, pages as P, review as V
from ..sources import sinks
from .page_queries import _regions, _words
from .text_queries import ARABIC, LATIN, pick, pick_sql, t

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _talk(spark, d):
    """Conversations as documents: a turn is a block, its number the page."""
    return t(spark, d, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.concat_ws("_", "conv_id", "turn").alias("id"), F.when(F.col("role") == "system", "page_marker").otherwise("paragraph").alias("type"),
        "text", (F.col("turn") + 1).alias("source_page"), (1 - F.col("turn") / 10).alias("confidence"), F.col("turn").alias("page_marker"))


_TALK = "WITH b AS (SELECT conv_id, turn, conv_id || '_' || turn AS id, CASE WHEN role = 'system' THEN 'page_marker' ELSE 'paragraph' END AS type, text, turn + 1 AS page, 1 - turn / 10 AS confidence FROM conversations)"


@query(_TALK + " SELECT p.conv_id, p.page, b.id AS block_id, coalesce(md5(b.text), 'none') AS digest, coalesce(b.confidence, 0.0) AS confidence FROM b p LEFT JOIN b ON p.conv_id = b.conv_id AND p.page = b.page AND b.type <> 'page_marker' AND b.text <> ''")
def flagged_blocks(spark, d):
    b = _talk(spark, d)
    p = b.select("doc_id", F.col("source_page").alias("page_number"), F.lit("look").alias("reason"), F.lit(None).cast("string").alias("converted_text"), F.lit(0.0).alias("confidence"))
    f = V.flagged(p, b)
    return f.select(F.col("doc_id").alias("conv_id"), F.col("page_number").alias("page"), "block_id", F.coalesce(F.md5("converted_text"), F.lit("none")).alias("digest"), "confidence")


@query("SELECT conv_id, turn, md5(CASE WHEN turn % 3 = 1 AND role <> 'system' THEN 'edited ' || turn ELSE text END) AS digest FROM conversations")
def edits_overlay(spark, d):
    b = _talk(spark, d)
    e = b.filter("ord % 3 = 1 and type <> 'page_marker'").select("doc_id", "id", F.concat(F.lit("edited "), "ord").alias("text"))
    return V.with_edits(b, e).select(F.col("doc_id").alias("conv_id"), F.col("ord").alias("turn"), F.md5("text").alias("digest"))


@query("""
WITH w AS (SELECT conv_id, turn, unnest([role || ' said this', 'seen']) AS warning, unnest([0, 1]) AS i FROM conversations), f AS (SELECT conv_id, warning, min(turn * 2 + i) AS k FROM w GROUP BY ALL)
SELECT conv_id, string_agg(warning, '; ' ORDER BY k) AS warnings FROM f GROUP BY conv_id
""")
def warning_union(spark, d):
    b = t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.array(F.concat("role", F.lit(" said this")), F.lit("seen")).alias("warnings"))
    return V.warnings_in_order(b).select(F.col("doc_id").alias("conv_id"), F.array_join("warnings", "; ").alias("warnings"))


@query(_TALK + " SELECT conv_id, page, min(confidence) AS confidence, CAST(length(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (text <> '')) AS BIGINT) AS n_chars FROM b GROUP BY ALL")
def retried_pages(spark, d):
    b = _talk(spark, d).withColumn("warnings", F.array().cast("array<string>"))
    return V.retried(b).select(F.col("doc_id").alias("conv_id"), F.col("source_page").alias("page"), "confidence", F.length("text").cast("long").alias("n_chars"))


@query("SELECT conv_id, min(turn + 1) AS first, max(turn + 1) AS last FROM conversations GROUP BY 1")
def source_range(spark, d):
    return V.source_range(_talk(spark, d)).select(F.col("doc_id").alias("conv_id"), "first", "last")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_tax < 0.04 AND l_discount < 0.05 THEN 'keep_page' WHEN l_returnflag = 'R' THEN 'none' WHEN l_discount * 10 < 0.7 THEN 'crop' WHEN l_discount * 10 < 0.75 THEN 'note' ELSE 'none' END AS action FROM lineitem
""")
def review_actions(spark, d):
    x = t(spark, d, "lineitem")
    page = F.when((F.col("l_tax") < 0.04) & (F.col("l_discount") < 0.05), 0.4).otherwise(0.9)
    return x.select("l_orderkey", "l_linenumber", M.review_action(page, F.col("l_discount") * 10, F.when(F.col("l_returnflag") == "R", "running_text")).alias("action"))


@query("""
WITH w AS (SELECT l_orderkey AS page, least(avg(1 - l_discount), min(1 - l_discount) + 0.2) AS confidence FROM lineitem GROUP BY 1) SELECT page, round(confidence, 9) AS confidence FROM w
""")
def block_confidence(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), (1 - F.col("l_discount")).alias("confidence"))
    return M.block_confidence(x, ["page"]).withColumn("confidence", F.round("confidence", 9))


_FIGURES = """
WITH r AS (SELECT o_orderkey AS page, CAST(o_custkey % 60 AS DOUBLE) AS w, CAST(o_orderkey % 80 AS DOUBLE) AS h FROM orders), f AS (SELECT *, w * h < 0.002 * 300 * 400 AND greatest(w, h) < 36 AS tiny FROM r WHERE w >= 6 AND h >= 6)
"""


def _figures(spark, d):
    o = t(spark, d, "orders")
    r = o.select(F.lit("d").alias("doc_id"), F.col("o_orderkey").alias("page_number"), F.lit(0).alias("region_id"), F.lit("figure").alias("kind"), F.lit(False).alias("decorative"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("o_custkey") % 60).cast("double").alias("x1"), (F.col("o_orderkey") % 80).cast("double").alias("y1"))
    return L.figures(r, r.select("doc_id", "page_number", F.lit(300.0).alias("width"), F.lit(400.0).alias("height")))


@query(_FIGURES + "SELECT page FROM f WHERE NOT tiny")
def shown_figures(spark, d):
    return _figures(spark, d)[0].select(F.col("page_number").alias("page"))


@query(_FIGURES + "SELECT page, CAST(count(*) FILTER (tiny) AS BIGINT) AS tiny FROM f GROUP BY page")
def tiny_figures(spark, d):
    return _figures(spark, d)[1].select(F.col("page_number").alias("page"), "tiny")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents), w AS (SELECT doc_id, k, length(array_to_string(regexp_extract_all(line, '[^\\s]+'), ' ')) AS n, unnest(regexp_extract_all(line, '[^\\s]+')) AS word, unnest(range(1, len(regexp_extract_all(line, '[^\\s]+')) + 1)) AS j FROM l WHERE trim(line) <> ''),
s AS (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id, k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM w)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_words, round(max((gone + length(word)) * (500.0 / n)), 6) AS reach FROM s GROUP BY doc_id
""")
def recognised_words(spark, d):
    """Documents' lines as recognised lines 500 points wide, split into words."""
    x = t(spark, d, "documents").select(F.col("doc_id"), F.lit(1).alias("page_number"), F.posexplode(F.split("text", "\n")).alias("line_id", "text"))
    x = x.select("*", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(500.0).alias("x1"), F.lit(12.0).alias("y1"), F.lit(0.9).alias("confidence"))
    return L.ocr_words(x).groupBy("doc_id").agg(F.count("*").alias("n_words"), F.round(F.max("x1"), 6).alias("reach"))


@query("""
WITH w AS (SELECT l_orderkey AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS INTEGER) AS word, CAST(l_partkey % 500 AS DOUBLE) AS x0, CAST(l_suppkey % 700 AS DOUBLE) AS y0 FROM lineitem),
h AS (SELECT o_orderkey AS page, CAST(k % 2 * 260 AS DOUBLE) AS x0, CAST(k // 2 * 340 AS DOUBLE) AS y0, k AS region FROM orders, (SELECT unnest([0, 1, 2]) AS k))
SELECT w.page, w.word, min(h.region) AS region FROM w JOIN h ON w.page = h.page AND w.y0 + 6 BETWEEN h.y0 - 4 AND h.y0 + 384 AND h.x0 - (w.x0 + 40) >= 0 AND h.x0 - (w.x0 + 40) < 90 GROUP BY ALL
""")
def margin_headings(spark, d):
    r = _regions(spark, d).withColumn("kind", F.when(F.col("kind") == "text", "heading").otherwise(F.col("kind")))
    return L.margin_headings(_words(spark, d), r).select(F.col("page_number").alias("page"), F.col("word_id").alias("word"), F.col("region_id").alias("region"))


@query("""
WITH w AS (SELECT l_orderkey AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS INTEGER) AS word, CAST(l_partkey % 500 AS DOUBLE) AS x0, CAST(l_suppkey % 700 AS DOUBLE) + 12 AS y1 FROM lineitem),
u AS (SELECT o_orderkey AS page, CAST(o_custkey % 400 AS DOUBLE) AS a, CAST(o_custkey % 400 AS DOUBLE) + 60 AS b, CAST(o_orderkey % 100 AS DOUBLE) AS y FROM orders),
h AS (SELECT w.*, u.a, u.b, least(b, x0 + 40) - greatest(a, x0) AS over FROM w JOIN u USING (page) WHERE least(b, x0 + 40) - greatest(a, x0) > 24 AND y + 0.25 >= y1 - 12 - 1 AND y + 0.25 <= y1 + 4.5),
g AS (SELECT page FROM h GROUP BY page HAVING 60 <= max(x0 + 40) - min(x0) + 25 AND sum(over) > 15)
SELECT h.page, h.word FROM h JOIN g USING (page)
""")
def underlined_words(spark, d):
    x = (F.col("o_custkey") % 400).cast("double")
    y = (F.col("o_orderkey") % 100).cast("double")
    r = t(spark, d, "orders").select(F.lit("d").alias("doc_id"), F.col("o_orderkey").alias("page_number"), F.lit(0).alias("rule_id"), x.alias("x0"), y.alias("y0"), (x + 60).alias("x1"), (y + 0.5).alias("y1"), F.lit(False).alias("vertical"))
    return L.underlined(_words(spark, d), r).select(F.col("page_number").alias("page"), F.col("word_id").alias("word"))


@query("""
WITH s AS (SELECT p_partkey, p_size * 10.0 AS w, p_size * 12.0 AS h, p_retailprice / 10 AS src FROM part),
a AS (SELECT *, least(greatest(least(src * (20 / 10.5), w * 72 / 150 * 2.2), least(480 * 0.35, src)), 480) AS x FROM s)
SELECT p_partkey, round(CASE WHEN x * h / w > 700 * 0.86 THEN 700 * 0.86 / (h / w) ELSE x END, 6) AS width FROM a
""")
def picture_sizes(spark, d):
    p = t(spark, d, "part")
    s = G.picture_size(F.col("p_size") * 10.0, F.col("p_size") * 12.0, F.col("p_retailprice") / 10, 480.0, 700.0, 20.0, F.lit(False))
    return p.select("p_partkey", F.round(s["width"], 6).alias("width"))


PRESETS = ["Large", "Comfortable", "Very Large", "Custom", "Custom", "Extra Large"]
_PRESETS = f"v AS (SELECT c_custkey, {pick_sql(PRESETS, 'c_custkey')} AS name, CASE WHEN c_custkey % 6 = 3 THEN 18.0 + c_custkey % 20 END AS body, CASE WHEN c_custkey % 6 = 4 THEN 1.25 + c_custkey % 4 / 4.0 END AS spacing FROM customer)"


@query(f"""WITH {_PRESETS} SELECT c_custkey, CAST(coalesce(CASE WHEN v.name = 'Custom' THEN v.body END, p.pt) AS DOUBLE) AS body_pt, CAST(coalesce(CASE WHEN v.name = 'Custom' THEN v.spacing END, p.gap) AS DOUBLE) AS line_spacing
FROM v JOIN (VALUES ('Comfortable', 18.0, 1.4), ('Large', 20.0, 1.5), ('Extra Large', 24.0, 1.5), ('Very Large', 28.0, 1.55)) AS p(name, pt, gap) ON p.name = CASE WHEN v.name = 'Custom' THEN 'Large' ELSE v.name END""")
def export_presets(spark, d):
    """What customers' presets come to, some with a size or spacing of their own."""
    k = F.col("c_custkey")
    x = G.preset(pick(PRESETS, k), F.when(k % 6 == 3, 18.0 + k % 20), F.when(k % 6 == 4, 1.25 + k % 4 / 4))
    return t(spark, d, "customer").select("c_custkey", x["body"].alias("body_pt"), x["spacing"].alias("line_spacing"))


@query("SELECT doc_id, sha256(text) = sha256(CASE WHEN doc_id % 3 = 0 THEN 'other' ELSE text END) AS ready FROM documents")
def verified_assets(spark, d):
    x = t(spark, d, "documents")
    files = x.select(F.col("doc_id").alias("name"), F.col("text").cast("binary").alias("content"))
    wanted = x.select(F.col("doc_id").alias("name"), F.octet_length("text").alias("size"), F.sha2(F.when(F.col("doc_id") % 3 == 0, F.lit("other")).otherwise(F.col("text")), 256).alias("sha256"))
    return V.verified_assets(files, wanted).select(F.col("name").alias("doc_id"), "ready")


@query("""
WITH c AS (SELECT user_id, event_type, min(event_id) AS first FROM events WHERE value > 5 GROUP BY ALL) SELECT user_id, arg_min(event_type, first) AS event_type FROM c GROUP BY user_id
""")
def first_available(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("path"), F.col("event_id").alias("priority"), (F.col("value") > 5).alias("present"))
    return V.first_available(e).select(F.col("key").alias("user_id"), F.col("path").alias("event_type"))


@query("""
WITH e AS (SELECT conv_id, generate_series AS page FROM (SELECT conv_id, unnest(range(0, max(turn) + 2)) AS generate_series FROM conversations GROUP BY conv_id)), p AS (SELECT conv_id, turn AS page, role FROM conversations)
SELECT e.conv_id, CAST(count(p.page) AS BIGINT) AS imported, CAST(count(*) AS BIGINT) AS expected, CAST(count(*) FILTER (p.role IS NULL OR p.role <> 'system') AS BIGINT) AS missing_anchors FROM e LEFT JOIN p ON e.conv_id = p.conv_id AND e.page = p.page GROUP BY e.conv_id
""")
def acceptance_report(spark, d):
    b = _talk(spark, d)
    pages = b.select("doc_id", F.col("ord").alias("page_number"), F.lit(595.0).alias("width"), F.lit(842.0).alias("height"))
    want = b.groupBy("doc_id").agg(F.max("ord").alias("n")).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") + 1)).alias("page_number"), F.lit(595.0).alias("want_width"), F.lit(842.5).alias("want_height"))
    return V.acceptance(want, pages, b).select(F.col("doc_id").alias("conv_id"), "imported", "expected", "missing_anchors")


@query("SELECT conv_id, max(turn) > 0 AS turned, CAST(count(*) FILTER (role = 'user') AS BIGINT) AS n FROM conversations GROUP BY conv_id")
def ui_types(spark, d):
    b = t(spark, d, "conversations").withColumn("k", X.ui_type(F.when(F.col("role") == "user", "list").otherwise("image")))
    return b.groupBy("conv_id").agg((F.max("turn") > 0).alias("turned"), F.count_if(F.col("k") == "list_item").alias("n"))


@query("""
SELECT doc_id, CAST(length(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS BIGINT) AS n FROM documents
""")
def html_escaped(spark, d):
    return t(spark, d, "documents").select("doc_id", F.length(X.html_escape(F.col("text"))).cast("long").alias("n"))


@query()
def reader_pages(spark, d):
    b = _talk(spark, d).select("*", F.lit(None).cast("int").alias("level"), F.lit("en").alias("language"), F.lit("ltr").alias("text_direction"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("array<array<struct<text:string,row_span:int,col_span:int,is_header:boolean>>>").alias("rows"), F.lit(None).cast("string").alias("caption"), F.lit(None).cast("string").alias("note"))
    docs = b.select("doc_id").distinct().withColumn("title", F.concat(F.lit("Talk "), "doc_id"))
    pages = b.select("doc_id", F.col("ord").alias("page_number"), F.lit(None).cast("string").alias("printed_page"))
    return sinks.reader_html(b, docs, pages).select(F.col("doc_id").alias("conv_id"), "html")


@query(f"""
WITH x AS (SELECT doc_id, source || '_' || lang AS stem, CASE WHEN doc_id % 3 = 0 THEN translate(left(text, doc_id % 90), '{LATIN}', '{ARABIC}') ELSE text END AS sample FROM documents)
SELECT doc_id, CASE WHEN contains(lower(stem), 'arabic') OR len(regexp_extract_all(stem || ' ' || sample, '[{X.ARABIC}]')) >= {P.ARABIC_NAME} THEN 'ar' ELSE 'en' END AS hint FROM x
""")
def language_hint(spark, d):
    """Documents with their source as file name; the beginnings of some are in Arabic letters."""
    sample = F.when(F.col("doc_id") % 3 == 0, F.translate(F.expr("left(text, doc_id % 90)"), LATIN, ARABIC)).otherwise(F.col("text"))
    return t(spark, d, "documents").select("doc_id", P.language_hint(F.concat_ws("_", "source", "lang"), sample).alias("hint"))


@query("""
SELECT conv_id, turn, CASE WHEN turn = 1 THEN 'again: ' || text ELSE text END AS text FROM conversations
""")
def retry_page(spark, d):
    """The second page of every conversation read again, and marked so, in place of the first reading."""
    b = _talk(spark, d).select("doc_id", "ord", "id", "type", "text", "source_page")
    pages = b.select("doc_id", F.col("source_page").alias("page_number")).distinct()
    wanted = pages.filter("page_number = 2")
    again, _ = V.page_of(b.withColumn("text", F.concat(F.lit("again: "), "text")), pages, wanted)
    return V.with_retried(b, again, wanted).select(F.col("doc_id").alias("conv_id"), F.col("ord").alias("turn"), "text")


@query("SELECT r_regionkey, (r_regionkey % 3) / 2.0 AS score FROM region")
def table_accuracy(spark, d):
    """Two reference tables a region, of which as many are found as its key's remainder of 3."""
    n = t(spark, d, "nation").groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.array(F.col("n_nationkey").cast("string"), "n_name"))).alias("rows"))
    refs = n.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "rows")
    return M.table_accuracy(refs, refs.filter(F.col("k") < F.col("doc_id") % 3)).select(F.col("doc_id").alias("r_regionkey"), "score")


@query("SELECT p_partkey, sha256('RGB:' || p_size || 'x' || (p_size + 1) || ':' || p_name) AS digest FROM part")
def pixel_digests(spark, d):
    return t(spark, d, "part").select("p_partkey", M.pixel_digest(F.col("p_size"), F.col("p_size") + 1, F.col("p_name").cast("binary")).alias("digest"))


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 500 AS DOUBLE) AS x0, CAST(l_suppkey % 700 AS DOUBLE) AS y0, l_quantity AS w FROM lineitem),
c AS (SELECT l_orderkey, l_linenumber, greatest(0, CAST(trunc((x0 - 4) * 2) AS INTEGER)) AS l, greatest(0, CAST(trunc((800 - y0 - 12 - 4) * 2) AS INTEGER)) AS t, least(900, CAST(trunc((x0 + w + 4) * 2) AS INTEGER)) AS r, least(1600, CAST(trunc((800 - y0 + 4) * 2) AS INTEGER)) AS b FROM b)
SELECT l_orderkey, l_linenumber, l AS "left", t AS top, r AS "right", b AS bottom FROM c WHERE r - l >= 8 AND b - t >= 8
""")
def crop_boxes(spark, d):
    """Crops of words on pictures of pages that are narrower than the pages."""
    x0, y0 = (F.col("l_partkey") % 500).cast("double"), (F.col("l_suppkey") % 700).cast("double")
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.struct(x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity")).alias("x1"), (y0 + 12).alias("y1")).alias("b"))
    return x.select("l_orderkey", "l_linenumber", G.crop_box(F.col("b"), F.lit(800.0), F.lit(2.0), F.lit(900), F.lit(1600)).alias("c")).filter("c is not null").select("l_orderkey", "l_linenumber", "c.*")


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber, l_linenumber % 4 AS q, CAST(l_partkey % 500 AS DOUBLE) AS x0, CAST(l_suppkey % 700 AS DOUBLE) AS y0 FROM lineitem), p AS (SELECT *, x0 + 40 AS x1, y0 + 12.5 AS y1 FROM b)
SELECT l_orderkey, l_linenumber, CASE q WHEN 1 THEN y0 WHEN 2 THEN 600 - x1 WHEN 3 THEN 800 - y1 ELSE x0 END AS x0, CASE q WHEN 1 THEN x0 WHEN 2 THEN y0 WHEN 3 THEN 600 - x1 ELSE 800 - y1 END AS y0,
       CASE q WHEN 1 THEN y1 WHEN 2 THEN 600 - x0 WHEN 3 THEN 800 - y0 ELSE x1 END AS x1, CASE q WHEN 1 THEN x1 WHEN 2 THEN y1 WHEN 3 THEN 600 - x0 ELSE 800 - y0 END AS y1 FROM p
""")
def upright_boxes(spark, d):
    """Words in document points as they lie on pages turned by quarters."""
    x0, y0 = (F.col("l_partkey") % 500).cast("double"), (F.col("l_suppkey") % 700).cast("double")
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.struct(x0.alias("x0"), y0.alias("y0"), (x0 + 40).alias("x1"), (y0 + 12.5).alias("y1")).alias("b"))
    return x.select("l_orderkey", "l_linenumber", G.upright(F.col("b"), F.lit(600.0), F.lit(800.0), F.col("l_linenumber") % 4).alias("u")).select("l_orderkey", "l_linenumber", "u.*")


@query("SELECT p_partkey, regexp_full_match(replace(p_name, ' ', '-'), '[A-Za-z0-9][A-Za-z0-9_-]{0,127}') AS plain, regexp_full_match(p_name || ' x', '[A-Za-z0-9][A-Za-z0-9_-]{0,127}') AS spaced FROM part")
def job_ids(spark, d):
    return t(spark, d, "part").select("p_partkey", X.is_job_id(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("plain"), X.is_job_id(F.concat("p_name", F.lit(" x"))).alias("spaced"))


@query("""
SELECT '| Case | Pages | CER | Speed |' || chr(10) || '|---|---|---|---|' || chr(10) || string_agg('| ' || n_name || ' | ' || n_regionkey || ' | ' || CASE WHEN n_nationkey % 2 = 0 THEN printf('%.3f', n_nationkey / 40.0) ELSE 'N/A' END || ' | ' || printf('%.2f', n_nationkey / 8.0) || ' |', chr(10) ORDER BY n_name) AS markdown FROM nation
""")
def benchmark_table(spark, d):
    n = t(spark, d, "nation").select(F.col("n_name").alias("case"), F.col("n_regionkey").alias("pages"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") / 40.0).alias("cer"), (F.col("n_nationkey") / 8.0).alias("speed"))
    return M.benchmark_table(n, [("Case", "case", None), ("Pages", "pages", None), ("CER", "cer", 3), ("Speed", "speed", 2)], "case")
