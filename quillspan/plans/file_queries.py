"""Queries that write files of whole tables by executors and read them again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import docx, folders, office, sinks
from .text_queries import t

QUERIES: dict = {}
SQL: dict = {}
BLANK_SQL = r"[\s\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _lines(spark, d):
    """Each line of a document as a block: headings, quotes, list items and paragraphs by turns."""
    x = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "lang", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    kind = F.element_at(F.array(*map(F.lit, ("heading", "quote", "list", "paragraph"))), F.col("ord") % 4 + 1)
    none = lambda k: F.lit(None).cast(k)
    return x.withColumns({
        "type": kind, "level": F.when(kind == "heading", 2), "language": F.col("lang"), "text_direction": F.lit("ltr"), "indent_level": F.lit(0), "page_marker": none("int"), "role": none("string"), "caption": none("string"), "note": none("string"),
        "styles": none("array<struct<start:int,end:int,bold:boolean,italic:boolean,underline:boolean>>"), "rows": none("array<array<struct<text:string,row_span:int,col_span:int,is_header:boolean>>>")})


@query(rf"""
WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents),
s AS (SELECT doc_id, k, k % 4 AS q, regexp_replace(regexp_replace(text, '^{BLANK_SQL}+', ''), '{BLANK_SQL}+$', '') AS text FROM l),
b AS (SELECT doc_id, k, q, text, q = 2 OR regexp_matches(text, '^[•*-]') AS listed FROM s WHERE text <> ''),
n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS ord, CASE WHEN q = 0 THEN 'heading' WHEN listed THEN 'list' WHEN q = 1 THEN 'quote' WHEN regexp_matches(text, '{X.DOCX_CAPTION}') THEN 'caption' ELSE 'paragraph' END AS type,
    CASE WHEN q = 0 THEN 2 END AS level, CASE WHEN q <> 0 AND listed AND regexp_replace(text, '^[•* \t-]+', '') <> '' THEN regexp_replace(text, '^[•* \t-]+', '') ELSE text END AS text FROM b)
SELECT doc_id, CAST(ord AS INTEGER) AS ord, type, CAST(level AS INTEGER) AS level, text FROM n UNION ALL SELECT CAST(doc_id AS VARCHAR), 0, 'page_marker', NULL, NULL FROM documents
""")
def office_round_trip(spark, d):
    """All documents as large-print office files, written by the tasks and read again as blocks."""
    path = folders.scratch(spark, "office")
    folders.write_files(docx.large_print(_lines(spark, d)), path, ".docx")
    return office.blocks_of(folders.read_files(spark, path, "docx")).select("doc_id", "ord", "type", "level", "text")


_HTML = lambda c: f"replace(replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), '______', '<span class=\"blank\" aria-label=\"blank\">______</span>')"


@query(rf"""
WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents),
b AS (SELECT doc_id, any_value(lang) AS lang, replace(any_value(source), '&', '&amp;') AS title,
    string_agg(CASE k % 4 WHEN 0 THEN '<h2>' || {_HTML('text')} || '</h2>' WHEN 1 THEN '<blockquote>' || {_HTML('text')} || '</blockquote>' WHEN 2 THEN '<li>' || {_HTML('text')} || '</li>' ELSE '<p>' || {_HTML('text')} || '</p>' END, chr(10) ORDER BY k) AS body FROM l GROUP BY doc_id)
SELECT doc_id, '<!DOCTYPE html><html lang="' || lang || '"><head><meta charset="utf-8"><title>' || title || '</title></head><body><h1>' || title || '</h1><p>{sinks.REMINDER}</p>' || chr(10) || body || '</body></html>' AS html FROM b
""")
def reader_files(spark, d):
    """All documents as reader pages, a file each, written by the tasks and read again."""
    path = folders.scratch(spark, "reader")
    titles = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("title"))
    b = _lines(spark, d)
    pages = b.select("doc_id", F.lit(0).alias("page_number"), F.lit(None).cast("string").alias("printed_page")).limit(0)
    folders.write_files(sinks.reader_html(b, titles, pages).withColumnRenamed("html", "content"), path, ".html")
    return folders.read_files(spark, path, "text", "doc_id string, value string").withColumnRenamed("value", "html")
