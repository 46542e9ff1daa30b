"""Line deduplication with a log-template tree.

The tree has fixed depth: lines part by token count, then by their leading
tokens, where a token with a digit is a variable field `<*>`.  In a leaf that
enough documents reach, a token becomes variable at its position unless enough
distinct lines or documents of the leaf have it there; what remains is the line's
template.  Templates with enough fixed tokens that occur in at least
MIN_DOCUMENTS documents are boilerplate, and their lines are dropped from all.

All steps are DataFrame operations.  Lines are counted as distinct lines with
their numbers of documents, so a line that a third of all documents hold is
aggregated before it is shuffled.

Edge cases: null text stays null, empty text empty, with no lines dropped; lines
without tokens are kept and never counted; lines shorter than MIN_TOKENS tokens
are kept; a line repeated within a document counts once; identical rows are
different documents, also where their doc_id is the same; a template that exactly MIN_DOCUMENTS documents hold is boilerplate; very long texts are cut
in time in proportion to their lines; an empty table gives an empty result.  Other columns are
carried along by `dedup`; names beginning with `_ld` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import discard, stored, table

MIN_DOCUMENTS, MIN_TOKENS, LEADING = 5, 3, 3
#: Least share of fixed tokens in a template, in percent.
MIN_FIXED = 60
#: Bits of the map of busy leaves that is broadcast before the exact join; a fixed size, whatever the data.
MAP_BITS = 1 << 22


def _tokens(line: Column) -> Column:
    """Tokens of a line, split at ASCII white space."""
    return F.array_remove(F.split(line, r"[\x20\x09-\x0D]+"), "")


def _masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit("<*>")).otherwise(token)


def _hash(line: Column) -> Column:
    return F.xxhash64(line)


def _leaf(tokens: Column) -> Column:
    return F.xxhash64(F.size(tokens), F.transform(F.slice(tokens, 1, LEADING), _masked))


def _text_key() -> Column:
    return F.xxhash64(F.col("text"), F.length("text"))


def _lines(docs: DataFrame, *extra: Column) -> DataFrame:
    """Each document's distinct lines that are long enough for the least number of tokens."""
    k = docs.select(*extra, F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    return k.filter(F.octet_length("line") >= 2 * MIN_TOKENS - 1)


def _bit(h: Column) -> tuple[Column, Column]:
    at = F.pmod(h, F.lit(MAP_BITS))
    return F.shiftright(at, 6), F.pmod(at, F.lit(64)).cast("int")


def _bits(hashes: DataFrame, column: str) -> DataFrame:
    """A map of bits (w, b) of the hashes in a column, at most MAP_BITS / 64 rows."""
    word, bit = _bit(F.col(column))
    return hashes.select(word.alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))


def line_table(docs: DataFrame) -> DataFrame:
    """(_ld_doc, line, leaf): hashes of each document's lines and their leaves; lines of too few tokens are out."""
    k = _lines(docs, F.monotonically_increasing_id().alias("_ld_doc")).withColumn("tokens", _tokens(F.col("line")))
    k = k.filter(F.size("tokens") >= MIN_TOKENS)
    return stored(k.select("_ld_doc", _hash(F.col("line")).alias("line"), _leaf(F.col("tokens")).alias("leaf")), "lines")


def boilerplate(docs: DataFrame, lines: DataFrame) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """(_ld_line, _ld_template): hashes of the lines to drop, and their templates; and the tables that this is read from."""
    vocab = stored(lines.groupBy("line", "leaf").agg(F.count("*").alias("n")), "vocabulary")
    busy = vocab.groupBy("leaf").agg(F.sum("n").alias("reach")).filter(F.col("reach") >= MIN_DOCUMENTS).select("leaf")
    asked = stored(vocab.join(busy, "leaf", "left_semi"), "busy-lines")
    # a map of bits first, so that only lines that may be in a busy leaf are split and shuffled
    bits = _bits(asked, "line")
    said = _lines(docs).select("line", _hash(F.col("line")).alias("h"))
    word, bit = _bit(F.col("h"))
    said = said.withColumns({"w": word, "k": bit}).join(F.broadcast(bits), "w").filter(F.getbit("b", F.col("k")) == 1)
    said = said.groupBy("h").agg(F.first("line").alias("said"))
    inside = asked.join(said, asked["line"] == said["h"]).select("leaf", asked["line"], "n", F.transform(_tokens(F.col("said")), _masked).alias("tokens"))
    inside = stored(inside, "inside")
    spots = inside.select("leaf", "n", F.posexplode("tokens").alias("pos", "token")).groupBy("leaf", "pos", "token").agg(F.sum("n").alias("seen"))
    fixed = spots.filter(F.col("seen") >= MIN_DOCUMENTS).select("leaf", "pos", "token", F.lit(True).alias("fixed"))
    spelled = inside.select("leaf", "line", "n", F.posexplode("tokens").alias("pos", "token")).join(fixed, ["leaf", "pos", "token"], "left")
    is_fixed = F.coalesce("fixed", F.lit(False)) & (F.col("token") != "<*>")
    spelled = spelled.withColumn("part", F.when(is_fixed, F.col("token")).otherwise(F.lit("<*>")))
    template = spelled.groupBy("leaf", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), " ").alias("template"),
        F.sum(is_fixed.cast("int")).alias("fixed"), F.count("*").alias("size"), F.first("n").alias("n"),
    )
    template = stored(template.filter(F.col("fixed") * 100 >= F.col("size") * MIN_FIXED), "templates")
    # several lines of one document may share a template: those count by documents, others by their own numbers
    per = template.groupBy("leaf", "template").agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    sure = per.filter(F.col("most") >= MIN_DOCUMENTS).select("leaf", "template")
    open_ = per.filter((F.col("most") < MIN_DOCUMENTS) & (F.col("total") >= MIN_DOCUMENTS)).select("leaf", "template")
    maybe = template.join(open_, ["leaf", "template"]).select("leaf", "template", "line")
    by_doc = lines.select("_ld_doc", "line").join(maybe, "line").select("leaf", "template", "_ld_doc").distinct()
    found = by_doc.groupBy("leaf", "template").agg(F.count("*").alias("k")).filter(F.col("k") >= MIN_DOCUMENTS).select("leaf", "template")
    out = template.join(sure.union(found), ["leaf", "template"]).select(F.col("line").alias("_ld_line"), F.col("template").alias("_ld_template"))
    return out, (vocab, asked, inside, template)


def dedup(docs: DataFrame) -> DataFrame:
    """docs with boilerplate lines cut from text, and _ld_lines and _ld_dropped, the numbers of lines and of dropped ones."""
    held = line_table(docs)
    found, parts = boilerplate(docs, held)
    drop = stored(found.select("_ld_line").distinct(), "boilerplate")
    discard(held, *parts)
    # numbers of the lines to cut, by text and not by row: copies within a task are one before they are shuffled
    word, bit = _bit(F.col("_ld_line"))
    # the text's key is made beneath the explode: above it, it would be worked out for each line
    spots = docs.select(_text_key().alias("_ld_k"), F.transform(F.split("text", "\n"), _hash).alias("_ld_all"))
    spots = spots.select("_ld_k", F.posexplode("_ld_all").alias("_ld_at", "_ld_line"))
    spots = spots.withColumns({"w": word, "k": bit}).join(F.broadcast(_bits(drop, "_ld_line")), "w").filter(F.getbit("b", F.col("k")) == 1)
    spots = spots.select("_ld_k", "_ld_at", "_ld_line").distinct().join(drop, "_ld_line")
    cuts = stored(spots.groupBy("_ld_k").agg(F.collect_list(F.col("_ld_at") + 1).alias("_ld_cut")), "cuts")
    discard(drop)
    d = docs.withColumn("_ld_key", _text_key())
    # texts are dealt by their key at any size; of a text with many copies the rows may be dealt anew
    d = d.join(cuts.hint("merge"), d["_ld_key"] == cuts["_ld_k"], "left").drop("_ld_k", "_ld_key")
    # split once a row (as one element of an array, whose function gets it worked out); the lines that stay by a set difference of
    # numbers, which takes time in proportion to them
    def without(x: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(1), F.size(x["said"])), x["cut"])
        return F.struct(F.array_join(F.transform(stay, lambda i: F.get(x["said"], i - 1)), "\n").alias("text"), F.size(x["said"]).alias("n"))

    split = F.struct(F.split("text", "\n").alias("said"), F.col("_ld_cut").alias("cut"))
    d = d.withColumn("_ld_done", F.when(F.col("_ld_cut").isNotNull(), F.get(F.transform(F.array(split), without), F.lit(0))))
    whole = F.col("_ld_cut").isNull()
    text = F.when(whole, F.col("text")).otherwise(F.col("_ld_done.text"))
    n = F.when(F.col("text").isNull(), 0).when(whole, F.size(F.split("text", "\n"))).otherwise(F.col("_ld_done.n"))
    dropped = F.when(whole, 0).otherwise(F.size(F.array_distinct("_ld_cut")))
    return d.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns], n.alias("_ld_lines"), dropped.alias("_ld_dropped"))


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_ld_lines").cast("long").alias("n_lines"), F.col("_ld_dropped").cast("long").alias("n_dropped"), "text")


SQL = rf"""
WITH l AS (
  SELECT doc_id, line, list_transform(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda y: y <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS tokens
  FROM (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
  WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= {MIN_TOKENS}
), v AS (
  SELECT line, any_value(tokens) AS tokens, count(*) AS n FROM l GROUP BY line
), b AS (
  SELECT len(tokens) AS size, tokens[1:{LEADING}] AS lead FROM v GROUP BY ALL HAVING sum(n) >= {MIN_DOCUMENTS}
), i AS (
  SELECT v.* FROM v JOIN b ON len(v.tokens) = b.size AND v.tokens[1:{LEADING}] = b.lead
), s AS (
  SELECT line, n, len(tokens) AS size, tokens[1:{LEADING}] AS lead, unnest(tokens) AS token, unnest(range(1, len(tokens) + 1)) AS pos FROM i
), f AS (
  SELECT size, lead, pos, token FROM s GROUP BY ALL HAVING sum(n) >= {MIN_DOCUMENTS}
), t AS (
  SELECT s.line, s.size, s.lead, string_agg(CASE WHEN f.token IS NOT NULL THEN s.token ELSE '<*>' END, ' ' ORDER BY s.pos) AS template,
         count(*) FILTER (f.token IS NOT NULL AND s.token <> '<*>') AS fixed
  FROM s LEFT JOIN f ON s.size = f.size AND s.lead = f.lead AND s.pos = f.pos AND s.token = f.token
  GROUP BY s.line, s.size, s.lead
), c AS (
  SELECT * FROM t WHERE fixed * 100 >= size * {MIN_FIXED}
), r AS (
  SELECT c.size, c.lead, c.template FROM c JOIN l ON c.line = l.line GROUP BY ALL HAVING count(DISTINCT l.doc_id) >= {MIN_DOCUMENTS}
), dropped AS (
  SELECT DISTINCT c.line FROM c JOIN r ON c.size = r.size AND c.lead = r.lead AND c.template = r.template
), x AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents
)
SELECT x.doc_id, count(*) AS n_lines, count(dropped.line) AS n_dropped,
       coalesce(string_agg(x.line, chr(10) ORDER BY x.pos) FILTER (dropped.line IS NULL), '') AS text
FROM x LEFT JOIN dropped ON x.line = dropped.line
GROUP BY x.doc_id
"""
