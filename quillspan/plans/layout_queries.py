"""Queries on recognised tokens, painted text and sheets of large print, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fonts as N
from ..operators import characters as H, layout as L, paging as S
from .text_queries import t

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents),
s AS (SELECT doc_id, k, line, regexp_extract_all(line, '\S+') AS words, regexp_extract_all(line, '\S+(?: \S+)?') AS pairs FROM l WHERE regexp_matches(line, '\S')),
apart AS (SELECT doc_id, k, unnest(words) AS text, unnest(range(len(words))) AS j FROM s WHERE k % 3 = 0),
parts AS (SELECT *, sum((length(text) + 3) // 4) OVER (PARTITION BY doc_id, k ORDER BY j) AS upto FROM apart),
paired AS (SELECT doc_id, k, unnest(pairs) AS text, unnest(range(len(pairs))) AS j FROM s WHERE k % 3 = 1),
shared AS (SELECT doc_id, k, unnest(words) AS text, unnest(range(len(words))) AS j, length(array_to_string(words, ' ')) AS n FROM s WHERE k % 3 = 2),
placed AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM shared),
u AS (
    SELECT doc_id, k, j, text, 10.0 * (upto - (length(text) + 3) // 4) AS x0, 10.0 * upto - 1 AS x1 FROM parts
    UNION ALL SELECT doc_id, k, j, text, 10.0 * j, 10.0 * j + 9 FROM paired
    UNION ALL SELECT doc_id, k, j, text, gone * (500.0 / n), (gone + length(text)) * (500.0 / n) FROM placed)
SELECT doc_id, CAST(k AS INTEGER) AS line, CAST(j AS INTEGER) AS word, text, round(CAST(x0 AS DOUBLE), 6) AS x0, round(CAST(x1 AS DOUBLE), 6) AS x1 FROM u
""")
def token_words(spark, d):
    """Documents' lines as a recogniser's, aligned with tokens: split words on every first line of three, joined pairs on every second,
    and on every third a letter too many, so that the line's width is shared out."""
    x = t(spark, d, "documents").select("doc_id", F.lit(1).alias("page_number"), F.posexplode(F.split("text", "\n")).alias("line_id", "text"))
    part = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    said = F.when(F.col("line_id") % 3 == 0, part(r"\S{1,4}")).when(F.col("line_id") % 3 == 1, part(r"\S+(?: \S+)?")).otherwise(F.transform(part(r"\S+"), lambda w, i: F.when(i == 0, F.concat(w, F.lit("+"))).otherwise(w)))
    tokens = F.transform(said, lambda w, i: F.struct(w.alias("text"), (i * 10).cast("double").alias("x0"), (i * 10 + 9).cast("double").alias("x1")))
    x = x.select("*", tokens.alias("tokens"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(500.0).alias("x1"), F.lit(12.0).alias("y1"), F.lit(0.9).alias("confidence"))
    return L.ocr_words(x).select("doc_id", F.col("line_id").alias("line"), F.col("k").alias("word"), "text", F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"))


@query("""
WITH o AS (SELECT l_orderkey AS page, l_linenumber AS object, min(l_partkey) AS draw, min(l_suppkey) % 4 = 0 AS image, min(l_suppkey) % 8 AS mode, max(l_quantity) * 12.0 * 800 AS area FROM lineitem GROUP BY ALL),
c AS (SELECT page, max(draw) AS cover FROM o WHERE image AND area >= 0.85 * 600 * 800 GROUP BY page),
h AS (SELECT o.page, o.object FROM o LEFT JOIN c USING (page) WHERE NOT image AND (mode IN (3, 7) OR coalesce(draw < cover, FALSE))),
x AS (SELECT l_orderkey AS page, CASE WHEN l_tax = 0.08 THEN chr(65533) WHEN l_tax = 0.07 THEN ' ' ELSE l_returnflag END AS ch, h.object IS NOT NULL AS hidden FROM lineitem LEFT JOIN h ON l_orderkey = h.page AND l_linenumber = h.object)
SELECT page, count(*) FILTER (ch <> ' ' AND NOT hidden) AS visible, count(*) FILTER (ch = chr(65533)) AS broken, count(*) FILTER (ch <> ' ' AND hidden) AS hidden FROM x GROUP BY page
""")
def hidden_text(spark, d):
    """Characters of pages that nobody sees: orders as pages, line items as characters of painted objects, some of them pictures over the page."""
    x = t(spark, d, "lineitem").select(F.lit("d").alias("doc_id"), F.col("l_orderkey").alias("page_number"), F.col("l_linenumber").alias("object_id"), "l_partkey", "l_suppkey", "l_quantity",
        F.when(F.col("l_tax") == 0.08, "�").when(F.col("l_tax") == 0.07, " ").otherwise(F.col("l_returnflag")).alias("ch"))
    o = x.groupBy("doc_id", "page_number", "object_id").agg(F.min("l_partkey").alias("draw"), F.min("l_suppkey").alias("s"), F.max("l_quantity").cast("double").alias("q"))
    o = o.select("doc_id", "page_number", "object_id", "draw", F.when(F.col("s") % 4 == 0, "image").otherwise("text").alias("kind"), (F.col("s") % 8).alias("render_mode"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("q") * 12).alias("x1"), F.lit(800.0).alias("y1"))
    pages = x.select("doc_id", "page_number").distinct().withColumns({"width": F.lit(600.0), "height": F.lit(800.0)})
    return H.page_text_counts(x, o, pages).select(F.col("page_number").alias("page"), "visible", "broken", "hidden")


_SHEET = S.frame("A4")
_KINDS = S.kinds(20.0, 1.5)


def _of(kind: str) -> str:
    return f"[{', '.join(str(int(v)) for v in _KINDS[kind])}]"


@query(f"""
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents),
t AS (SELECT doc_id, k, text, 1 + k // 12 AS page, CASE WHEN k % 9 IN (1, 2) THEN {_of("h2")} WHEN k % 9 = 5 THEN {_of("picture")} WHEN k % 3 = 0 THEN {_of("list")} ELSE {_of("body")} END AS f, k % 9 IN (1, 2) AS heading, k % 9 = 5 AS picture FROM l),
m AS (SELECT *, CASE WHEN picture THEN 1 ELSE greatest(1, (length(text) * f[1] * 55 + {100 * _SHEET[0] - 1}) // {100 * _SHEET[0]}) END AS n, CASE WHEN picture THEN least({_SHEET[1]}, 2000 + 20 * (doc_id % 700)) ELSE f[2] END AS lead, f[3] AS before, f[4] AS after,
    heading AND lead(k) OVER (PARTITION BY doc_id ORDER BY k) IS NOT NULL AS keep FROM t),
a AS (SELECT *, before + least(n, 2) * lead AS first, before + n * lead + after AS own FROM m),
r AS (SELECT *, sum(CASE WHEN coalesce(before_keeps, FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM (SELECT *, lag(keep) OVER (PARTITION BY doc_id ORDER BY k) AS before_keeps FROM a)),
need AS (SELECT *, least({_SHEET[1]}, greatest(first, sum(CASE WHEN keep THEN own ELSE first END) OVER (PARTITION BY doc_id, run ORDER BY k DESC))) AS need FROM r),
walk AS (
    SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST(1 AS BIGINT) AS first_sheet, CAST(1 AS BIGINT) AS sheet, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS page FROM documents
    UNION ALL
    SELECT doc_id, k, CAST(begun AS BIGINT), CAST(begun + more AS BIGINT), CAST(least({_SHEET[1]}, CASE WHEN more > 0 THEN (remaining - (more - 1) * each_) * lead ELSE least({_SHEET[1]}, start + here * lead) END + after) AS BIGINT), page
    FROM (SELECT *, CAST(ceil(remaining / each_) AS BIGINT) AS more FROM (
        SELECT *, n - here AS remaining, greatest(1, {_SHEET[1]} // lead) AS each_ FROM (
            SELECT *, greatest(1, least(n, ({_SHEET[1]} - start) // lead)) AS here FROM (
                SELECT *, room + CASE WHEN room > 0 THEN before ELSE 0 END AS start FROM (
                    SELECT need.*, sheet + CASE WHEN used > 0 AND used + need > {_SHEET[1]} THEN 1 ELSE 0 END AS begun, CASE WHEN used > 0 AND used + need > {_SHEET[1]} THEN 0 ELSE used END AS room
                    FROM walk JOIN need ON need.doc_id = walk.doc_id AND need.k = walk.k + 1)))))),
s AS (SELECT doc_id, page, unnest(range(first_sheet, sheet + 1)) AS sheet FROM walk WHERE k > 0),
g AS (SELECT doc_id, sheet, min(page) AS a, max(page) AS b FROM s GROUP BY ALL)
SELECT doc_id, sheet, a AS first_source, b AS last_source, CASE WHEN a = b THEN 'Original page ' || a ELSE 'Original pages ' || a || '–' || b END AS source_label, 'Page ' || sheet || ' of ' || max(sheet) OVER (PARTITION BY doc_id) AS sheet_label FROM g
""")
def output_sheets(spark, d):
    """Documents in large print: each line a block, the sheets they fill, and the source pages that each sheet shows."""
    x = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text")).withColumn("ord", F.col("at") + 1)
    k = F.col("ord")
    kind = F.when((k % 9).isin(1, 2), "heading").when(k % 9 == 5, "diagram").when(k % 3 == 0, "list").otherwise("paragraph")
    b = x.select("doc_id", "ord", kind.alias("type"), F.lit(2).alias("level"), "text", (1 + F.floor(k / 12)).cast("long").alias("source_page"), F.when(k % 9 == 5, (100 + F.col("doc_id") % 700).cast("double")).alias("points"))
    return S.sheets(S.on_sheets(S.measured(b)))


#: What two fonts cover: the main one has the letters of English, the other those of the tables' other languages.
MAIN_FONT, OTHER_FONT = [(0x20, 0x7E), (0xA0, 0xE0)], [(0x20, 0x17F)]


@query(rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents),
r AS (SELECT doc_id, k, unnest(regexp_extract_all(line, '[\x{{E1}}-\x{{17F}}]+|[^\x{{E1}}-\x{{17F}}]+')) AS text, unnest(range(len(regexp_extract_all(line, '[\x{{E1}}-\x{{17F}}]+|[^\x{{E1}}-\x{{17F}}]+')))) AS run FROM l)
SELECT doc_id, CAST(k AS INTEGER) AS k, CAST(run AS INTEGER) AS run, text, regexp_matches(text, '^[\x{{E1}}-\x{{17F}}]') AS fallback FROM r
""")
def font_runs(spark, d):
    """Documents' lines cut where a fallback font has to show what the main one lacks."""
    x = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    return x.select("doc_id", "k", F.posexplode(N.runs(F.col("line"), N.lacking(MAIN_FONT, OTHER_FONT))).alias("run", "r")).select("doc_id", "k", "run", "r.text", "r.fallback")
