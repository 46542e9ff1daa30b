"""Queries on tables: cells, Markdown, listings, widths, fits, splits, scores; reports and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables as B
from ..operators import metrics as M
from .text_queries import pick, pick_sql, t

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _cell(v, head=False):
    return F.struct(v.cast("string").alias("text"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.lit(head).alias("is_header"))


def _grids(spark, d):
    """A table for each nation: its customers' keys, names and segments under a header."""
    c = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    row = F.array(_cell(F.col("c_custkey")), _cell(F.col("c_name")), _cell(F.col("c_mktsegment")))
    g = c.groupBy("n_nationkey", "n_name").agg(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("row")))).alias("x"))
    head = F.array(*[_cell(F.lit(h), True) for h in ("Key", "Name", "Segment")])
    return g.select("n_nationkey", "n_name", F.concat(F.array(head), F.transform("x", lambda r: r["row"])).alias("rows"))


@query("""
SELECT n_nationkey, '**' || n_name || '**' || chr(10) || chr(10) || '| Key | Name | Segment |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || c_custkey || ' | ' || c_name || ' | ' || c_mktsegment || ' |', chr(10) ORDER BY c_custkey) AS markdown
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name
""")
def table_markdown(spark, d):
    return _grids(spark, d).select("n_nationkey", B.markdown(F.col("rows"), F.col("n_name")).alias("markdown"))


@query("""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer)
SELECT n_nationkey, '[Table: ' || n_name || ']' || chr(10) || string_agg('• Row ' || k || ':' || chr(10) || '   - Key: ' || c_custkey || chr(10) || '   - Name: ' || c_name || chr(10) || '   - Segment: ' || c_mktsegment, chr(10) ORDER BY k) AS listing
FROM c JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name
""")
def table_linearized(spark, d):
    return _grids(spark, d).select("n_nationkey", B.linearized(F.col("rows"), F.lit(True), F.col("n_name")).alias("listing"))


@query("SELECT n_nationkey, CAST(c_custkey AS VARCHAR) AS lead, 'Name: ' || c_name || '; Segment: ' || c_mktsegment AS details FROM customer JOIN nation ON c_nationkey = n_nationkey")
def table_entries(spark, d):
    e = _grids(spark, d).select("n_nationkey", F.explode(B.entries(F.col("rows"), F.lit(True))).alias("e"))
    return e.select("n_nationkey", "e.lead", F.array_join(F.transform("e.details", lambda x: F.concat(x["label"], F.lit(": "), x["value"])), "; ").alias("details"))


@query("""
SELECT n_nationkey, 0 AS r, c, text FROM nation, (SELECT unnest([0, 1, 2]) AS c, unnest(['Key', 'Name', 'Segment']) AS text) WHERE n_nationkey IN (SELECT c_nationkey FROM customer)
UNION ALL
SELECT c_nationkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER), unnest([0, 1, 2]), unnest([CAST(c_custkey AS VARCHAR), c_name, c_mktsegment]) FROM customer
""")
def table_cells(spark, d):
    x = _grids(spark, d).select("n_nationkey", F.posexplode("rows").alias("r", "row"))
    return x.select("n_nationkey", "r", F.posexplode("row").alias("c", "cell")).select("n_nationkey", "r", "c", "cell.text")


_MEASURES = """
WITH x AS (SELECT c_nationkey AS k, unnest([0, 1, 2]) AS c, unnest([CAST(c_custkey AS VARCHAR), c_name, c_mktsegment]) AS v FROM customer UNION ALL
           SELECT DISTINCT c_nationkey, unnest([0, 1, 2]), unnest(['Key', 'Name', 'Segment']) FROM customer),
m AS (SELECT k, c, max(length(v)) AS line, max(list_max(list_transform(string_split(v, ' '), lambda w: length(w)))) AS word, CAST(sum(length(v)) AS BIGINT) AS volume FROM x GROUP BY ALL)
"""


@query(_MEASURES + "SELECT k AS n_nationkey, c, CAST(round_even(greatest(60.0, word * 11.0 + 16, least(line, 20) * 11.0 + 16), 2) AS DOUBLE) AS width FROM m")
def column_widths(spark, d):
    w = B.estimated_widths(B.measures(F.col("rows")), F.lit(20.0))
    return _grids(spark, d).select("n_nationkey", F.posexplode(w).alias("c", "width"))


_WRAP = _MEASURES + """, w AS (SELECT *, CAST(greatest(word * 12 * 0.56, 12 * 2.2) + 14 AS DOUBLE) AS low, sqrt(CAST(greatest(1, volume) AS DOUBLE)) AS weight FROM m),
s AS (SELECT k, sum(low ORDER BY c) AS total, sum(weight ORDER BY c) AS weights FROM w GROUP BY k)
"""


@query(_WRAP + "SELECT k AS n_nationkey, c, round(round_even(low + (470 - total) * weight / weights, 2), 0) AS width FROM w JOIN s USING (k) WHERE total <= 470 AND 470 / 3.0 >= 4.5 * 12")
def wrapped_widths(spark, d):
    w = B.wrapped_widths(B.measures(F.col("rows")), F.lit(12.0), F.lit(470.0))
    return _grids(spark, d).select("n_nationkey", F.posexplode(w).alias("c", "width")).withColumn("width", F.round("width", 0))


def _wide(spark, d):
    """A table of six columns and a header for each part brand."""
    row = F.array(_cell(F.col("p_partkey")), _cell(F.col("p_name")), _cell(F.col("p_brand")), _cell(F.col("p_type")), _cell(F.col("p_size")), _cell(F.col("p_brand")))
    g = t(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("row")))).alias("x"))
    return g.select("p_brand", F.transform("x", lambda r: r["row"]).alias("rows"))


@query()
def table_fit(spark, d):
    """Which way each table fits frames of three widths."""
    g = _wide(spark, d).withColumn("m", B.measures(F.col("rows"))).select("p_brand", "rows", "m", F.explode(F.array(F.lit(150.0), F.lit(350.0), F.lit(900.0))).alias("frame"))
    f = B.fit(F.col("rows"), F.col("m"), F.col("frame"), F.lit(20.0))
    return g.select("p_brand", "frame", f["tier"].alias("tier"), f["warned"].alias("warned"))


@query("""
SELECT p_brand, CAST(part AS INTEGER) AS part, 'Parts (Part ' || (part + 1) || ' of 3)' AS caption, count(*) AS n_rows, min(CASE part WHEN 0 THEN p_partkey || '/' || p_name || '/' || p_brand WHEN 1 THEN p_partkey || '/' || p_type || '/' || p_size ELSE p_partkey || '/' || p_brand END) AS least
FROM part, (SELECT unnest([0, 1, 2]) AS part) GROUP BY p_brand, part
""")
def split_columns(spark, d):
    x = _wide(spark, d).select("p_brand", F.posexplode(B.split_parts(F.col("rows"), F.lit("Parts"))).alias("part", "x"))
    line = F.transform("x.rows", lambda r: F.array_join(F.transform(r, lambda c: c["text"]), "/"))
    return x.select("p_brand", "part", "x.caption", F.size("x.rows").cast("long").alias("n_rows"), F.array_min(line).alias("least"))


@query("""
WITH n AS (SELECT r_regionkey AS k, count(*) AS n, count(*) FILTER (n_nationkey % 3 <> 0) AS same FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT k AS r_regionkey, round_even(0.3 + 0.3 + 0.4 * ((n + same) / CAST(2 * n AS DOUBLE)), 3) AS score FROM n
""")
def table_score(spark, d):
    """Grids of nations by region against themselves with the names of every third key changed."""
    n = t(spark, d, "nation").orderBy("n_nationkey")
    changed = F.when(F.col("n_nationkey") % 3 == 0, F.concat("n_name", F.lit("!"))).otherwise(F.col("n_name"))
    g = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), "n_name").alias("a"), F.array(F.col("n_nationkey").cast("string"), changed).alias("b")))).alias("x"))
    return g.select(F.col("n_regionkey").alias("r_regionkey"), B.structure_score(F.transform("x", lambda v: v["a"]), F.transform("x", lambda v: v["b"])).alias("score"))


@query("""
SELECT n_nationkey, CAST(0.4 + 0.4 + 0.2 AS DOUBLE) AS score FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)
""")
def table_quality(spark, d):
    return _grids(spark, d).select("n_nationkey", B.quality(F.col("rows"), F.lit(True)).alias("score"))


WANTED = ["the,ZZZ", "the", "ch,de", ""]
_RESULTS = f"""r AS (SELECT doc_id, text, doc_id % 7 <> 0 AS passed, doc_id % 11 <> 0 AS converted, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 13 / 16.0 END AS cer, CASE WHEN doc_id % 3 <> 1 THEN doc_id % 5 / 8.0 END AS wer, doc_id % 9 / 4.0 + 0.25 AS seconds_per_page,
    doc_id % 10 = 0 AS rejected, doc_id % 4 AS page_count, doc_id % 2 / 1.0 AS table_score, CASE WHEN doc_id % 5 = 0 THEN 0.0 ELSE 1.0 END AS image_retention FROM documents),
e AS (SELECT doc_id, doc_id // 2 % 4 AS page_count, {pick_sql(WANTED, 'doc_id')} AS keywords, doc_id % 3 = 0 AS has_table, doc_id % 4 = 0 AS has_images, doc_id % 15 = 0 AS rejected FROM documents)"""


def _results(spark, d):
    """Documents as cases of an acceptance run, with what came of them."""
    k = F.col("doc_id")
    return t(spark, d, "documents").select(
        k.alias("case"), "text", (k % 7 != 0).alias("passed"), (k % 11 != 0).alias("converted"), F.when(k % 3 != 0, k % 13 / 16).alias("cer"), F.when(k % 3 != 1, k % 5 / 8).alias("wer"), (k % 9 / 4 + 0.25).alias("seconds_per_page"),
        (k % 10 == 0).alias("rejected"), (k % 4).alias("page_count"), (k % 2).cast("double").alias("table_score"), F.when(k % 5 == 0, 0.0).otherwise(1.0).alias("image_retention"))


@query(f"""WITH {_RESULTS} SELECT count(*) AS total_cases, count(*) FILTER (passed) AS passed_cases, count(*) FILTER (NOT passed) AS failed_cases,
round_even(avg(cer), 4) AS average_cer, round_even(avg(wer), 4) AS average_wer, round_even(avg(seconds_per_page) FILTER (converted), 3) AS average_speed FROM r""")
def report_rollup(spark, d):
    return M.report(_results(spark, d))


@query(f"""WITH {_RESULTS}, m AS (SELECT r.doc_id, e.rejected AS unwanted, r.rejected, r.page_count <> e.page_count AS pages, list_filter(string_split(e.keywords, ','), lambda k: k <> '' AND NOT contains(lower(r.text), lower(k))) AS missing,
    e.has_table AND r.table_score <= 0 AS tables, e.has_images AND r.image_retention <= 0 AS images, NOT e.rejected AND NOT r.rejected AS served FROM r JOIN e ON r.doc_id = e.doc_id)
SELECT doc_id AS "case", concat_ws('; ', CASE WHEN unwanted AND NOT rejected THEN 'not rejected' END, CASE WHEN NOT unwanted AND rejected THEN 'rejected' END, CASE WHEN served AND pages THEN 'page count' END,
    CASE WHEN served AND len(missing) > 0 THEN 'missing: ' || array_to_string(missing, ', ') END, CASE WHEN served AND tables THEN 'table' END, CASE WHEN served AND images THEN 'images' END) AS mismatches FROM m""")
def expectation_gate(spark, d):
    k = F.col("doc_id")
    e = t(spark, d, "documents").select(k.alias("case"), (F.floor(k / 2) % 4).alias("page_count"), F.filter(F.split(pick(WANTED, k), ","), lambda w: w != "").alias("keywords"), (k % 3 == 0).alias("has_table"), (k % 4 == 0).alias("has_images"), (k % 15 == 0).alias("rejected"))
    return M.expectation_gate(_results(spark, d), e).select("case", F.array_join("mismatches", "; ").alias("mismatches"))


@query("""
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'pdf' WHEN 3 THEN 'docx' WHEN 4 THEN 'doc' ELSE CASE WHEN doc_id % 7 <> 5 AND contains(left(CASE WHEN doc_id % 7 = 2 THEN repeat('x', 1200) || text ELSE text END, 1024), '%PDF-') THEN 'pdf' END END AS type FROM documents
""")
def file_sniff(spark, d):
    """Types of files by their content: documents behind heads of all kinds, late heads, none, and as office files."""
    from ..sources import docx, sniff

    x, k, raw = t(spark, d, "documents"), F.col("doc_id") % 7, F.col("text").cast("binary")
    head = lambda text: F.concat(F.lit(text).cast("binary"), raw)
    ole = F.concat(F.unhex(F.lit(sniff.OLE)), F.encode(F.lit("WordDocument"), "UTF-16LE"), raw)
    plain = x.filter(k != 3).select("doc_id", F.when(k == 0, head("%PDF-1.7")).when(k == 1, head("\0" * 100 + "%PDF-")).when(k == 2, head("x" * 1200 + "%PDF-")).when(k == 4, ole).when(k == 5, F.lit("").cast("binary")).otherwise(raw).alias("content"))
    none = {"level": "int", "text_direction": "string", "indent_level": "int", "page_marker": "int", "styles": "array<struct<start:int,end:int,bold:boolean,italic:boolean,underline:boolean>>", "rows": "array<array<struct<text:string,row_span:int,col_span:int,is_header:boolean>>>"}
    blocks = x.filter(k == 3).select("doc_id", F.lit(0).alias("ord"), F.lit("paragraph").alias("type"), "text", *(F.lit(None).cast(v).alias(n) for n, v in none.items()))
    return plain.unionByName(docx.large_print(blocks)).select("doc_id", sniff.detect(F.col("content")).alias("type"))
