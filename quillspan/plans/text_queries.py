"""Queries on text: scripts, markers, titles, labels, metrics, over whole tables; what these lack is put before their lines by turns."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

from ..functions import bidi, glyphs, text as X
from ..operators import metrics as M, pages as P, review as V

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


_R = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{0870}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}\x{0590}-\x{05FF}\x{0700}-\x{074F}\x{0780}-\x{085F}\x{0860}-\x{086F}\x{FB1D}-\x{FB4F}"
#: Letters of texts are exchanged for these, to have right-to-left lines and numbers from the tables.
LATIN, ARABIC, HEBREW = "etaoinshrdlu", "ابتثجحخدذرزس", "אבגדהוזחטיכל"


def pick(values: list, k) -> Column:
    """The value at k, counted round."""
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def pick_sql(values: list, k: str) -> str:
    said = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{said}])[CAST({k} AS BIGINT) % {len(values)} + 1]"


LINES_SQL = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents)"


def lines(spark, d, *more):
    """(doc_id, k, line): documents' lines, numbered from 0."""
    return t(spark, d, "documents").select("doc_id", *more, F.posexplode(F.split("text", "\n")).alias("k", "line"))


def _scripts(df, key):
    c = X.script_counts(F.col("text"))
    return df.select(*key.split(", "), c["rtl"].cast("long").alias("rtl"), c["ltr"].cast("long").alias("ltr"), X.direction(c).alias("direction"), X.language(c).alias("language"), X.is_bidi(c).alias("bidi"))


def _scripts_sql(key, source):
    return f"""SELECT {key}, CAST(rtl AS BIGINT) AS rtl, CAST(ltr AS BIGINT) AS ltr,
  CASE WHEN rtl + ltr > 0 AND (rtl >= ltr OR rtl / (rtl + ltr) >= 0.30) THEN 'rtl' ELSE 'ltr' END AS direction,
  CASE WHEN rtl + ltr > 0 AND (rtl > ltr OR rtl / (rtl + ltr) >= 0.40) THEN 'ar' ELSE 'en' END AS language, rtl >= 2 AND ltr >= 3 AS bidi
FROM (SELECT {key}, len(regexp_extract_all(text, '[{_R}]')) AS rtl, len(regexp_extract_all(regexp_replace(text, '[{_R}]', '', 'g'), '\\p{{L}}')) AS ltr FROM {source})"""


@query(_scripts_sql("doc_id", "documents"))
def script_counts(spark, d):
    return _scripts(t(spark, d, "documents"), "doc_id")


_MIXED = f"""WITH v AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN translate(text, '{LATIN}', '{ARABIC}') WHEN 1 THEN substr(translate(text, '{LATIN}', '{ARABIC}'), 1, 40) || text
    WHEN 2 THEN translate(text, '{LATIN}', '{HEBREW}') WHEN 3 THEN regexp_replace(text, '[^ .,]', '1', 'g') ELSE text END AS text FROM conversations) """


@query(_MIXED + _scripts_sql("conv_id, turn", "v"))
def text_direction(spark, d):
    """Turns of conversations with letters exchanged: Arabic, Arabic before Latin, Hebrew, numbers, and as they are."""
    k, x = F.col("turn") % 5, F.col("text")
    arabic = F.translate(x, LATIN, ARABIC)
    mixed = F.when(k == 0, arabic).when(k == 1, F.concat(F.substring(arabic, 1, 40), x)).when(k == 2, F.translate(x, LATIN, HEBREW)).when(k == 3, F.regexp_replace(x, "[^ .,]", "1")).otherwise(x)
    return _scripts(t(spark, d, "conversations").withColumn("text", mixed), "conv_id, turn")


@query()
def exact_script_counts(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", bidi.exact_counts("text").alias("c")).select("conv_id", "turn", "c.*")


@query("""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) - 1 AS ord FROM documents)
SELECT doc_id, CAST(ord AS BIGINT) AS ord, line AS text, CAST(length(line) AS BIGINT) AS n_chars FROM l WHERE trim(line) <> ''
""")
def blocks_from_lines(spark, d):
    lines = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return lines.filter(F.trim("text") != "").select("doc_id", F.col("ord").cast("long").alias("ord"), "text", F.length("text").cast("long").alias("n_chars"))


def _line_blocks(spark, d):
    """Documents' lines as running text of a book (the source), each document a page."""
    return t(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("source_page"), F.posexplode(F.split("text", "\n")).alias("ord", "text")).withColumn("role", F.lit("running_text"))


_FURNITURE = """
WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) - 1 AS ord FROM documents),
k AS (SELECT *, trim(regexp_replace(lower(line), '[^\\p{L}\\p{M}\\p{Nl}\\p{No}]+', ' ', 'g')) AS key FROM l WHERE line <> ''),
n AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
c AS (SELECT source, key, count(DISTINCT doc_id) AS repeats FROM k WHERE key <> '' GROUP BY ALL),
x AS (SELECT k.source, k.doc_id, k.ord, k.line, k.key = '' OR coalesce(c.repeats, 0) >= CASE WHEN n.pages <= 6 THEN 2 ELSE 3 END AS moved
      FROM k JOIN n USING (source) LEFT JOIN c ON k.source = c.source AND k.key = c.key)
"""


@query(_FURNITURE + "SELECT source, doc_id, count(*) FILTER (moved) AS moved, count(*) FILTER (NOT moved) AS kept FROM x GROUP BY ALL")
def furniture_lines(spark, d):
    b = _line_blocks(spark, d).filter("text <> ''")
    pages = t(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_number"))
    kept, details = P.settle_furniture(b, pages)
    k = kept.groupBy("doc_id", F.col("source_page").alias("page_number")).agg(F.count("*").alias("kept"))
    m = details.select("doc_id", "page_number", F.size("running_text").cast("long").alias("moved"))
    out = k.join(m, ["doc_id", "page_number"], "full")
    return out.select(F.col("doc_id").alias("source"), F.col("page_number").alias("doc_id"), F.coalesce("moved", F.lit(0)).cast("long").alias("moved"), F.coalesce("kept", F.lit(0)).cast("long").alias("kept"))


@query(_FURNITURE + "SELECT source, doc_id, CAST(ord AS BIGINT) AS ord, line AS text FROM x WHERE NOT moved")
def page_notes_kept(spark, d):
    b = _line_blocks(spark, d).filter("text <> ''")
    pages = t(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_number"))
    kept, _ = P.settle_furniture(b, pages)
    return kept.select(F.col("doc_id").alias("source"), F.col("source_page").alias("doc_id"), F.col("ord").cast("long").alias("ord"), "text")


@query("""
WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL)
SELECT source, lang, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, first) AS r FROM c) WHERE r = 1
""")
def dominant_language(spark, d):
    return V.dominant(t(spark, d, "documents"), ["source"], "lang", "doc_id").select("source", "lang", "n")


BEGINNINGS = ["• ", "1.2) ", "3 ", "2Anna: ", "a. ", "(iv) ", "Bob: ", "", "– ", "(12) ", "3.14159 ", "12", "*", "x. ", "Extraordinarily: ", "☐ "]
_MARKER_SQL = r"""CASE WHEN regexp_matches(text, '^[•●○◦▪▫■□☐☑☒❑❒❏❐◆◇►▶➢➤→➔✓✔✗✘☆★\-–—*](\s|$)') THEN substr(text, 1, 1)
  WHEN regexp_matches(text, '^\(?\d{1,3}(\.\d{1,3})*[.)]?\s') THEN regexp_extract(text, '^(\(?\d{1,3}(?:\.\d{1,3})*[.)]?)\s', 1)
  WHEN regexp_matches(text, '^\d{1,3}[A-Z][a-z]{0,11}:\s') THEN regexp_extract(text, '^(\d{1,3})[A-Z]', 1)
  WHEN regexp_matches(text, '^\(?[a-hA-H][.)]\s') THEN regexp_extract(text, '^(\(?[a-hA-H][.)])', 1)
  WHEN regexp_matches(text, '^\([ivx]{1,4}\)\s') THEN regexp_extract(text, '^(\([ivx]{1,4}\))', 1)
  WHEN regexp_matches(text, '^[A-Z][a-z]{0,11}:\s') THEN regexp_extract(text, '^([A-Z][a-z]{0,11}:)', 1) END"""


@query(f"WITH {LINES_SQL}, v AS (SELECT doc_id, k, {pick_sql(BEGINNINGS, 'k')} || line AS text FROM l) SELECT doc_id, CAST(k AS INTEGER) AS k, {_MARKER_SQL} AS marker FROM v")
def list_markers(spark, d):
    """Documents' lines behind beginnings of all kinds."""
    return lines(spark, d).select("doc_id", "k", X.list_marker(F.concat(pick(BEGINNINGS, F.col("k")), "line")).alias("marker"))


_TURNS = "SELECT conv_id, turn, upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || text AS text FROM conversations"


@query(f"SELECT conv_id, turn, {_MARKER_SQL} AS marker, regexp_matches(text, '^[A-Z][a-z]{{0,11}}:\\s') AS dialogue, length(text) - length({_MARKER_SQL}) - 1 AS rest FROM ({_TURNS})")
def dialogue_lines(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn", F.concat(F.initcap("role"), F.lit(": "), "text").alias("text")).withColumn("m", X.list_marker(F.col("text")))
    s = X.split_marker(F.col("text"), F.col("m"))
    return c.select("conv_id", "turn", F.col("m").alias("marker"), X.is_dialogue(F.col("text")).alias("dialogue"), F.length(s["rest"]).cast("long").alias("rest"))


_STEMS = "CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '_') || '_[www.site.org]_-_' || p_size WHEN 1 THEN '[' || p_brand || ']' WHEN 2 THEN ' - ' || p_name || '   ' || p_type || ' - ' ELSE p_name END"


@query(f"""WITH v AS (SELECT p_partkey, {_STEMS} AS stem FROM part), s AS (SELECT p_partkey, stem, trim(regexp_replace(replace(regexp_replace(stem, '\\[[^\\]]*\\]', ' ', 'g'), '_', ' '), '\\s+', ' ', 'g'), ' -') AS x FROM v)
SELECT p_partkey, CASE WHEN x = '' THEN stem ELSE x END AS title FROM s""")
def readable_title(spark, d):
    """File names made of parts."""
    return t(spark, d, "part").select("p_partkey", X.readable_title(F.expr(_STEMS)).alias("title"))


_PRINTED = "CASE conv_id % 6 WHEN 0 THEN NULL WHEN 1 THEN CAST(turn + 1 AS VARCHAR(20)) WHEN 2 THEN ' ' || (turn + 39) || ' ' WHEN 3 THEN role || role WHEN 4 THEN '' ELSE 'ii' END"


@query(f"""WITH v AS (SELECT conv_id, turn + 1 AS page, {_PRINTED} AS printed FROM conversations)
SELECT conv_id, page, 'Original page ' || page || CASE WHEN trim(coalesce(printed, '')) NOT IN ('', CAST(page AS VARCHAR)) AND length(trim(printed)) <= 8 THEN ' (printed ' || trim(printed) || ')' ELSE '' END AS label FROM v""")
def page_labels(spark, d):
    """Conversations as documents, turns as pages, with printed numbers that differ, agree, are too long or are missing."""
    page = F.col("turn") + 1
    return t(spark, d, "conversations").select("conv_id", page.alias("page"), X.page_label(page, F.expr(_PRINTED)).alias("label"))


CAPTIONS = ["Figure 4.1: ", "Figure 2 shows ", "fig. 3 - ", "Table IV. ", "Mapping ", "Photo 1 of ", "1. ", "[12] ", "12 ", "3. Anna: ", ""]


@query(f"""WITH {LINES_SQL}, v AS (SELECT doc_id, k, {pick_sql(CAPTIONS, 'k')} || line AS text FROM l) SELECT doc_id, CAST(k AS INTEGER) AS k, regexp_matches(text, '(?i)^(figure|fig\\.|table|chart|diagram|map|plate|photo)\\s*[\\dIVXivx]+[\\w.\\-]*\\s*[:.\\-–]?\\s') AS caption,
  regexp_matches(text, '^(?:\\d{{1,3}}[.)]?\\s|[*†‡¹²³]|\\[\\d{{1,3}}\\])') AS footnote, nullif(regexp_extract(text, '^\\d{{1,3}}[.)]?\\s+([A-Z][a-z]{{0,11}}:)\\s', 1), '') AS speaker FROM v""")
def caption_lines(spark, d):
    x = F.concat(pick(CAPTIONS, F.col("k")), "line")
    return lines(spark, d).select("doc_id", "k", X.is_caption(x).alias("caption"), X.starts_footnote(x).alias("footnote"), X.speaker_after_number(x).alias("speaker"))


STYLES = ["Heading 2", "heading 9", "Title", "Subtitle", "List Bullet", "Normal", "Intense Quote", "Caption", "footnote text", None, "Heading0", "Normal", "Normal"]
STARTS = ["", "• ", "", "- ", "Table 3 ", "", "figure: "]


@query(f"""WITH {LINES_SQL}, v AS (SELECT doc_id, k, {pick_sql(STYLES, 'k')} AS style, {pick_sql(STARTS, 'k')} || line AS text, k % 11 = 5 AS numbered FROM l), s AS (SELECT *, lower(coalesce(style, '')) AS s FROM v), h AS (SELECT *, regexp_extract(s, 'heading\\s*(\\d+)', 1) AS h FROM s),
b AS (SELECT *, CASE WHEN h <> '' OR contains(s, 'title') THEN 'heading' WHEN contains(s, 'list') OR numbered OR regexp_matches(text, '^[•\\-*]') THEN 'list' WHEN contains(s, 'quote') THEN 'quote'
  WHEN contains(s, 'caption') OR regexp_matches(text, '(?i)^(figure|table|جدول|شكل)\\s*[:\\d]') THEN 'caption' WHEN contains(s, 'footnote') THEN 'footnote' ELSE 'paragraph' END AS type, regexp_replace(text, '^[•\\-* \\t]+', '') AS bare FROM h)
SELECT doc_id, CAST(k AS INTEGER) AS k, type, CASE WHEN h <> '' THEN least(6, greatest(1, CAST(h AS INTEGER))) WHEN contains(s, 'title') THEN 1 END AS level, CASE WHEN type = 'list' AND bare <> '' THEN bare ELSE text END AS text FROM b""")
def docx_styles(spark, d):
    """Documents' lines as paragraphs of an office file with styles of all kinds."""
    k = F.col("k")
    b = X.docx_block(pick(STYLES, k), F.concat(pick(STARTS, k), "line"), k % 11 == 5)
    return lines(spark, d).select("doc_id", "k", b["type"].alias("type"), b["level"].alias("level"), b["text"].alias("text"))


FONTS = ["Wingdings", "Wingdings-Regular", "ABCDEF+Webdings", "ZapfDingbats", "ITC Dingbats", "ABC+Symbol", "Symbol", "Symbola Serif", "Arial", None]
_MEANT = ", ".join(f"('{family}', {code}, '{glyph}')" for family, of in glyphs.FAMILIES.items() for code, glyph in of.items())


@query(f"""WITH m(family, low, glyph) AS (VALUES {_MEANT}), v AS (SELECT DISTINCT l_partkey % 256 + CASE l_linenumber % 4 WHEN 1 THEN 61440 WHEN 2 THEN 57344 WHEN 3 THEN 65000 ELSE 0 END AS code, {pick_sql(FONTS, 'l_suppkey')} AS font FROM lineitem),
f AS (SELECT *, lower(coalesce(font, '')) AS n, CASE WHEN code BETWEEN 61440 AND 61695 THEN code - 61440 ELSE code END AS low FROM v),
g AS (SELECT *, CASE WHEN contains(n, 'wingding') OR contains(n, 'webding') THEN 'wingdings' WHEN contains(n, 'zapf') OR contains(n, 'dingbat') THEN 'zapf' WHEN suffix(n, 'symbol') OR contains(n, '+symbol') THEN 'symbol' END AS family FROM f)
SELECT code, font, CASE WHEN g.family IN ('wingdings', 'zapf') THEN coalesce(m.glyph, CASE WHEN code >= 57344 THEN '•' END) WHEN g.family = 'symbol' THEN CASE WHEN code BETWEEN 61440 AND 61695 THEN m.glyph END WHEN code BETWEEN 57344 AND 63743 THEN '•' END AS glyph
FROM g LEFT JOIN m ON m.family = g.family AND m.low = g.low""")
def symbol_glyphs(spark, d):
    """Codes of line items, some in the private area, in fonts of all families."""
    base = F.element_at(F.array(*map(F.lit, (0, 61440, 57344, 65000))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    v = t(spark, d, "lineitem").select((F.col("l_partkey") % 256 + base).alias("code"), pick(FONTS, F.col("l_suppkey")).alias("font")).distinct()
    return v.select("code", "font", glyphs.mapped(F.col("code"), F.col("font")).alias("glyph"))


@query("""
WITH c AS (SELECT conv_id, string_agg(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ' ORDER BY turn) FILTER (trim(text) <> '') AS x FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(length(x) AS BIGINT) AS n_chars, md5(x) AS digest FROM c
""")
def transcript(spark, d):
    b = t(spark, d, "conversations").withColumn("ord", F.col("turn"))
    x = M.transcripts(b, X.squeeze(F.col("text")), ["conv_id"])
    return x.select("conv_id", F.length("transcript").cast("long").alias("n_chars"), F.md5("transcript").alias("digest"))


_OUTLINE = "WITH p AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<h1>(.*?)</h1>', 1)) AS h FROM pages)"


@query()
def outline(spark, d):
    from ..sources.html import read_html

    return V.outline(read_html(t(spark, d, "pages")).withColumn("source_page", F.lit(1))).select("page_id", "ord", "level", "text")


@query("SELECT conv_id, turn + 1 AS page, role FROM conversations WHERE contains(lower(text), 'the')")
def search_blocks(spark, d):
    b = t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("source_page"), "role", "text", F.lit(None).cast("string").alias("caption"))
    return V.search(b, " The ").select(F.col("doc_id").alias("conv_id"), F.col("source_page").alias("page"), "role")


@query("""
SELECT p.page_id, p.m AS mutated, CASE WHEN a = '' AND b = '' THEN 0.0 WHEN a = '' THEN 1.0 ELSE levenshtein(a, b) / length(a) END AS cer
FROM (SELECT page_id, 'x' AS m, regexp_replace(url, '[^a-z]', '', 'g') AS a, regexp_replace(replace(url, 'th', 'ht'), '[^a-z]', '', 'g') AS b FROM pages) p
""")
def character_error_rate(spark, d):
    u = t(spark, d, "pages").select("page_id", F.lit("x").alias("mutated"), F.regexp_replace("url", "[^a-z]", "").alias("a"), F.regexp_replace(F.replace("url", F.lit("th"), F.lit("ht")), "[^a-z]", "").alias("b"))
    return u.select("page_id", "mutated", M.cer(F.col("a"), F.col("b")).alias("cer"))


@query("SELECT item_id, (len(string_split(text, ' ')) // 3) / CAST(len(regexp_extract_all(text, '\\S+')) AS DOUBLE) AS wer FROM benchmark")
def word_error_rate(spark, d):
    """Benchmark items against themselves with every third word changed."""
    w = F.split("text", " ")
    b = t(spark, d, "benchmark").select("item_id", "text", F.array_join(F.transform(w, lambda x, i: F.when(i % 3 == 2, F.concat(x, F.lit("x"))).otherwise(x)), " ").alias("h"))
    return b.select("item_id", M.wer(F.col("text"), F.col("h")).alias("wer"))


@query()
def reading_order(spark, d):
    """Units of a benchmark item (its words two by two) looked up in the item with its halves exchanged."""
    b = t(spark, d, "benchmark").withColumn("w", F.split("text", r"\s+"))
    half = (F.size("w") / 2).cast("int")
    turned = F.array_join(F.concat(F.slice("w", half + 1, F.size("w")), F.slice("w", F.lit(1), half)), " ")
    starts = F.filter(F.transform("w", lambda _, i: i), lambda i: i % 2 == 0)
    b = b.select("item_id", F.transform(starts, lambda i: F.array_join(F.slice("w", i + 1, F.lit(2)), " ")).alias("units"), turned.alias("said"))
    return b.select("item_id", M.order_accuracy(F.transform("units", lambda _, i: i), M.unit_order("said", "units")).alias("accuracy"))


@query("""
WITH n AS (SELECT event_id, user_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS total FROM events)
SELECT event_id, round_even(CASE WHEN event_type = 'error' THEN 95.0 ELSE least(90.0, CAST(k AS DOUBLE) / greatest(1, total) * 90) END, 1) AS percent FROM n
""")
def job_progress(spark, d):
    e = t(spark, d, "events")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    n = F.count("*").over(Window.partitionBy("user_id"))
    stage = F.when(F.col("event_type") == "error", "exporting").otherwise("reading")
    return e.withColumns({"k": k, "n": n}).select("event_id", X.progress_percent(stage, F.col("k"), F.col("n")).alias("percent"))


@query("""
WITH j AS (SELECT user_id AS job_id, max(ts) AS m FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY m DESC, job_id) AS k FROM j)
SELECT job_id FROM r WHERE k > 50 OR m < (SELECT max(ts) FROM events) - INTERVAL 14 DAY
""")
def prune_jobs(spark, d):
    e = t(spark, d, "events")
    j = e.groupBy(F.col("user_id").alias("job_id")).agg(F.max("ts").alias("modified"))
    now = e.agg(F.max("ts").alias("_now"))  # one row
    return V.stale_assets(j.crossJoin(now), F.col("_now")).select("job_id")


KINDS = ["ValueError", "SecurityError", "FileNotFoundError", "PermissionError", "TimeoutError", "RuntimeError", "UnicodeDecodeError", "X"]
MESSAGES = ["bad", "File exceeds maximum allowed size (9)", "x", "File format not recognized.", "again"]


@query(f"""WITH v AS (SELECT event_id, {pick_sql(KINDS, 'event_id')} AS kind, {pick_sql(MESSAGES, 'event_id')} AS message FROM events) SELECT event_id, CASE WHEN contains(message, 'File format not recognized') THEN 'UNSUPPORTED_FORMAT' WHEN contains(message, 'exceeds maximum allowed size') THEN 'FILE_TOO_LARGE' WHEN contains(kind, 'FileNotFound') THEN 'FILE_NOT_FOUND' WHEN contains(kind, 'Permission') THEN 'PERMISSION_DENIED'
WHEN contains(kind, 'Timeout') THEN 'TIMEOUT' WHEN kind IN ('ValueError', 'UnicodeDecodeError', 'UnicodeEncodeError', 'JSONDecodeError', 'ValidationError') THEN 'INVALID_INPUT' ELSE 'CONVERSION_ERROR' END AS code FROM v""")
def error_codes(spark, d):
    k = F.col("event_id")
    return t(spark, d, "events").select("event_id", X.error_code(pick(KINDS, k), pick(MESSAGES, k)).alias("code"))


@query("""
WITH s AS (SELECT item_id, text, unnest([0, 1, 2, 3, 4]) AS k FROM benchmark)
SELECT item_id, CAST(k AS INTEGER) AS k, CASE k WHEN 0 THEN substr(text, 1, 2) WHEN 1 THEN substr(text, 3, 2) WHEN 2 THEN substr(text, 5, 2) WHEN 3 THEN substr(text, 7, 3) ELSE substr(text, 10) END AS text,
       CASE k WHEN 1 THEN 'b' WHEN 2 THEN 'bi' WHEN 3 THEN 'i' ELSE '' END AS tags FROM s
""")
def styled_segments(spark, d):
    s = F.array(F.struct(F.lit(2).alias("start"), F.lit(6).alias("end"), F.lit(True).alias("bold"), F.lit(False).alias("italic"), F.lit(False).alias("underline")), F.struct(F.lit(4).alias("start"), F.lit(9).alias("end"), F.lit(False).alias("bold"), F.lit(True).alias("italic"), F.lit(False).alias("underline")))
    x = t(spark, d, "benchmark").select("item_id", F.posexplode(X.styled_segments(F.col("text"), s)).alias("k", "seg"))
    return x.select("item_id", "k", "seg.text", F.array_join("seg.tags", "").alias("tags"))


_FACED = "()[]{}<>«»‹›"


@query(f"""
WITH m AS (SELECT conv_id, turn, CASE turn % 2 WHEN 0 THEN translate(text, '{LATIN}', '{ARABIC}') ELSE '(' || substr(translate(text, '{LATIN}', '{ARABIC}'), 1, 40) || ') ' || text END AS text FROM conversations),
x AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM m),
c AS (SELECT conv_id, turn, k, unnest(string_split(line, '')) AS ch, unnest(range(len(string_split(line, '')))) AS i FROM x WHERE trim(line) <> ''),
d AS (SELECT *, CASE WHEN regexp_matches(ch, '[{_R}]') THEN 'rtl' WHEN regexp_matches(ch, '[\\p{{L}}0-9]') THEN 'ltr' WHEN ch = ' ' THEN 'space' ELSE 'none' END AS side FROM c),
r AS (SELECT *, sum(CASE WHEN side = before THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn, k ORDER BY i) AS run FROM (SELECT *, lag(side) OVER (PARTITION BY conv_id, turn, k ORDER BY i) AS before FROM d)),
u AS (SELECT conv_id, turn, k, run, any_value(side) AS side, string_agg(ch, '' ORDER BY i) AS said FROM r GROUP BY ALL),
n AS (SELECT *, lag(side) OVER w AS before, lead(side) OVER w AS after FROM u WINDOW w AS (PARTITION BY conv_id, turn, k ORDER BY run)),
f AS (SELECT *, CASE WHEN side IN ('rtl', 'ltr') THEN side WHEN before = after AND before IN ('rtl', 'ltr') THEN before ELSE 'rtl' END AS way FROM n),
j AS (SELECT *, sum(CASE WHEN way = last THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn, k ORDER BY run) AS part FROM (SELECT *, lag(way) OVER (PARTITION BY conv_id, turn, k ORDER BY run) AS last FROM f)),
p AS (SELECT conv_id, turn, k, part, any_value(way) AS way, string_agg(said, '' ORDER BY run) AS said FROM j GROUP BY ALL),
o AS (SELECT conv_id, turn, k, string_agg(CASE WHEN way = 'rtl' THEN translate(array_to_string(list_reverse(string_split(said, '')), ''), '{_FACED}', ')(][}}{{><»«›‹') ELSE said END, '' ORDER BY part DESC) AS painted FROM p GROUP BY ALL)
SELECT x.conv_id, x.turn, CAST(x.k AS INTEGER) AS k, coalesce(painted, line) AS painted FROM x LEFT JOIN o ON x.conv_id = o.conv_id AND x.turn = o.turn AND x.k = o.k
""")
def painted_lines(spark, d):
    """Lines of conversations in Arabic letters, alone or in brackets before the line, in painting order."""
    arabic = F.translate("text", LATIN, ARABIC)
    mixed = F.when(F.col("turn") % 2 == 0, arabic).otherwise(F.concat(F.lit("("), F.substring(arabic, 1, 40), F.lit(") "), "text"))
    c = t(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split(mixed, "\n")).alias("k", "line"))
    return c.select("conv_id", "turn", "k", bidi.paint(F.col("line")).alias("painted"))
