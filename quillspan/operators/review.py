"""Reading and reviewing: search, outline, flagged blocks, edits, warnings, languages, jobs and their assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X

# Fixed values.
READABLE = ("heading", "paragraph", "quote", "list_item", "footnote")
LEAST_QUERY = 2
KEEP_JOBS, KEEP_DAYS = 50, 14


def outline(blocks: DataFrame) -> DataFrame:
    """Headings with text, and page markers, in order."""
    return blocks.filter(((F.col("type") == "heading") & (X.strip(F.coalesce("text", F.lit(""))) != "")) | (F.col("type") == "page_marker"))


def page_list(blocks: DataFrame) -> DataFrame:
    return blocks.select("doc_id", "source_page").distinct()


def readable(blocks: DataFrame) -> DataFrame:
    return blocks.filter(X.ui_type(F.col("type")).isin(*READABLE) & (F.coalesce("text", F.lit("")) != ""))


def search(blocks: DataFrame, query: str, page: int | None = None, caption: str = "caption") -> DataFrame:
    """Blocks whose text or caption holds the query, whatever the case; queries of one character find nothing."""
    q = query.strip().lower()
    if len(q) < LEAST_QUERY:
        return blocks.limit(0)
    b = blocks if page is None else blocks.filter(F.col("source_page") == page)
    return b.filter(F.lower(F.coalesce("text", F.lit(""))).contains(q) | F.lower(F.coalesce(caption, F.lit(""))).contains(q))


def step(current: int, by: int, total: int) -> int:
    """The next hit, going round at either end."""
    return (current + by) % total if total else 0


def flagged(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each flagged page with its blocks of text; a page without any once, with its own reading."""
    b = blocks.filter((F.col("type") != "page_marker") & (F.coalesce("text", F.lit("")) != "")).select("doc_id", F.col("source_page").alias("page_number"), F.col("id").alias("block_id"), F.col("text").alias("_t"), F.col("confidence").alias("_c"))
    p = pages.join(b, ["doc_id", "page_number"], "left")
    return p.select("doc_id", "page_number", "reason", "block_id", F.coalesce("_t", "converted_text").alias("converted_text"), F.coalesce("_c", "confidence").alias("confidence"))


def retried(blocks: DataFrame) -> DataFrame:
    """(doc_id, source_page, reason, confidence, text) of pages that were read again."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col(c).alias("v")))), lambda x: x["v"])
    return blocks.groupBy("doc_id", "source_page").agg(
        F.array_join(F.flatten(ordered("warnings")), " ").alias("reason"), F.coalesce(F.min("confidence"), F.lit(0.0)).alias("confidence"),
        F.array_join(F.filter(ordered("text"), lambda t: F.coalesce(t, F.lit("")) != ""), "\n\n").alias("text"))


def page_of(blocks: DataFrame, pages: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks and pages of the pages (doc_id, page_number) that were read again."""
    b = blocks.join(wanted.select("doc_id", F.col("page_number").alias("source_page")), ["doc_id", "source_page"], "left_semi")
    return b, pages.join(wanted, ["doc_id", "page_number"], "left_semi")


def with_retried(blocks: DataFrame, again: DataFrame, wanted: DataFrame) -> DataFrame:
    """blocks with those of the wanted pages exchanged for the second reading's; a page's blocks keep its place."""
    first = blocks.join(wanted.select("doc_id", F.col("page_number").alias("source_page")), ["doc_id", "source_page"], "left_anti")
    return first.select(*blocks.columns).unionByName(again.join(wanted.select("doc_id", F.col("page_number").alias("source_page")), ["doc_id", "source_page"], "left_semi").select(*blocks.columns))


def with_edits(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    e = edits.select("doc_id", "id", F.col("text").alias("_edit"))
    return blocks.join(e, ["doc_id", "id"], "left").withColumn("text", X.apply_edit(F.col("_edit"), F.col("type"), F.col("text"))).select(*blocks.columns)


def warnings_in_order(blocks: DataFrame) -> DataFrame:
    """(doc_id, warnings): each distinct warning once, by where it first occurs."""
    w = blocks.select("doc_id", "ord", F.posexplode("warnings").alias("i", "warning")).groupBy("doc_id", "warning").agg(F.min(F.struct("ord", "i")).alias("at"))
    return w.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "warning"))), lambda x: x["warning"]).alias("warnings"))


def dominant(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Most frequent value of each group; of equally frequent ones the first met."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return n.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value), F.max("n").alias("n"))


def source_range(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc_id").agg(F.coalesce(F.min("source_page"), F.lit(0)).alias("first"), F.coalesce(F.max("source_page"), F.lit(0)).alias("last"))


def stale_assets(jobs: DataFrame, now: Column, current: str | None = None) -> DataFrame:
    """Jobs whose assets go: older than 14 days or beyond the 50 newest, never the current one."""
    w = Window.orderBy(F.col("modified").desc(), "job_id")
    newest = jobs.orderBy(F.col("modified").desc(), "job_id").limit(KEEP_JOBS).withColumn("rank", F.row_number().over(w)).select("job_id", "rank")
    old = F.col("modified") < now - F.expr(f"interval {KEEP_DAYS} days")
    j = jobs.join(F.broadcast(newest), "job_id", "left").filter(F.col("rank").isNull() | old)  # at most 50 rows are broadcast
    return j.drop("rank") if current is None else j.drop("rank").filter(F.col("job_id") != current)


def acceptance(expected: DataFrame, pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per document: imported against expected pages, missing markers, pages whose size is off by more than a point."""
    got = pages.join(expected, ["doc_id", "page_number"], "full")
    marks = blocks.filter(F.col("type") == "page_marker").select("doc_id", F.col("page_marker").alias("page_number")).distinct().withColumn("m", F.lit(1))
    g = got.join(marks, ["doc_id", "page_number"], "left")
    off = (F.abs(F.col("width") - F.col("want_width")) > 1) | (F.abs(F.col("height") - F.col("want_height")) > 1)
    return g.groupBy("doc_id").agg(F.count("width").alias("imported"), F.count("want_width").alias("expected"), F.count_if(F.col("want_width").isNotNull() & F.col("m").isNull()).alias("missing_anchors"), F.count_if(off).alias("geometry"))


def verified_assets(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (name, content) against a manifest of sizes and digests: which are whole."""
    f = files.select("name", F.length("content").alias("size"), F.sha2("content", 256).alias("sha256"))
    m = manifest.select("name", F.col("size").alias("_size"), F.col("sha256").alias("_sha"))
    return m.join(f, "name", "left").select("name", F.coalesce((F.col("size") == F.col("_size")) & (F.col("sha256") == F.col("_sha")), F.lit(False)).alias("ready"))


def first_available(candidates: DataFrame) -> DataFrame:
    """Of each key's candidate places the first one that exists."""
    return candidates.filter("present").groupBy("key").agg(F.min_by("path", "priority").alias("path"))
