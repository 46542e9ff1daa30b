"""Writers: document JSON, reader HTML, Markdown reports, and single files put in place at once."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import tables as B, text as X

# Fixed values.
ASSET_LIMIT = 8 * 1024 * 1024
REMINDER = "To keep the text this size, print at 100% (actual size), not “fit to page”."


def data_url(mime: Column, content: Column) -> Column:
    """A picture inlined for display; null where it is missing or larger than 8 MB."""
    return F.when(F.length(content) <= ASSET_LIMIT, F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content)))


def _tag(name: str, inner: Column, attrs: Column | str = "") -> Column:
    return F.concat(F.lit(f"<{name}"), F.lit(attrs) if isinstance(attrs, str) else attrs, F.lit(">"), inner, F.lit(f"</{name}>"))


def grid_html(rows: Column, caption: Column) -> Column:
    cell = lambda c: F.concat(
        F.when(c["is_header"], "<th").otherwise("<td"), F.when(c["rs"] > 1, F.concat(F.lit(' rowspan="'), c["rs"].cast("string"), F.lit('"'))).otherwise(""),
        F.when(c["cs"] > 1, F.concat(F.lit(' colspan="'), c["cs"].cast("string"), F.lit('"'))).otherwise(""), F.lit(">"), X.html_text(F.coalesce(c["text"], F.lit(""))), F.when(c["is_header"], "</th>").otherwise("</td>"))
    seen = B.visible_cells(rows)
    full = F.transform(seen, lambda v: F.struct(v["r"].alias("r"), v["text"].alias("text"), v["rs"].alias("rs"), v["cs"].alias("cs"), F.coalesce(F.get(F.get(rows, v["r"]), v["c"])["is_header"], F.lit(False)).alias("is_header")))
    n = F.sequence(F.lit(0), F.greatest(F.size(rows) - 1, F.lit(0)))
    line = lambda full, r: F.concat(F.lit("<tr>"), F.array_join(F.transform(F.filter(full, lambda v: v["r"] == r), cell), ""), F.lit("</tr>"))
    body = F.get(F.transform(F.array(full), lambda full: F.array_join(F.transform(n, lambda r: line(full, r)), "")), F.lit(0))
    return F.concat(F.lit("<table>"), F.when(F.length(caption) > 0, _tag("caption", X.html_escape(caption))).otherwise(""), body, F.lit("</table>"))


def block_html(printed: Column) -> Column:
    """A block as HTML, from its columns type, text, level, text_direction, page_marker, role, list_marker, rows, caption, note."""
    t = X.html_text(F.coalesce("text", F.lit("")))
    turn = F.when(F.col("text_direction") == "rtl", ' dir="rtl"').otherwise("")
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(2)))).cast("string")
    body = (
        F.when(F.col("type") == "page_marker", F.concat(F.lit('<div class="page" id="page-'), F.col("page_marker").cast("string"), F.lit('">'), X.html_escape(X.page_label(F.col("page_marker"), printed)), F.lit("</div>")))
        .when(F.col("type").isin("heading", "title"), F.concat(F.lit("<h"), level, turn, F.lit(">"), t, F.lit("</h"), level, F.lit(">")))
        .when(F.col("type") == "list", _tag("li", t, turn)).when(F.col("type") == "quote", _tag("blockquote", t, turn))
        .when((F.col("type") == "table") & F.col("rows").isNotNull(), grid_html(F.col("rows"), F.col("caption")))
        .when(F.col("type") == "image", F.concat(F.lit('<figure><img alt="'), t, F.lit('"></figure>')))
        .when(F.col("type") == "caption", F.concat(F.lit('<p class="caption"'), turn, F.lit(">"), X.html_escape(F.coalesce(X.caption_label(F.col("role")), F.lit(""))), t, F.lit("</p>")))
        .when(F.col("type").isin("footnote", "aside"), _tag("aside", t, turn)).otherwise(_tag("p", t, turn))
    )
    return F.concat(body, F.when(F.col("note").isNotNull(), _tag("p", X.html_escape(F.col("note")), ' class="note"')).otherwise(""))


def reader_html(blocks: DataFrame, documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, html): one accessible page for each document, its language the most frequent one of its blocks."""
    p = pages.select("doc_id", F.col("page_number").alias("page_marker"), "printed_page")
    b = blocks.join(p, ["doc_id", "page_marker"], "left").withColumn("_html", block_html(F.col("printed_page")))
    from ..operators.review import dominant

    lang = dominant(b.filter(F.col("language").isNotNull()), ["doc_id"], "language", "ord")
    body = b.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "_html"))), lambda x: x["_html"]), "\n").alias("body"))
    d = documents.join(body, "doc_id").join(lang, "doc_id", "left")
    title = X.html_escape(F.coalesce("title", F.lit("Document")))
    code = F.coalesce("language", F.lit("en"))
    return d.select("doc_id", F.concat(F.lit('<!DOCTYPE html><html lang="'), code, F.when(code == "ar", '" dir="rtl">').otherwise('">'), F.lit('<head><meta charset="utf-8"><title>'), title, F.lit("</title></head><body><h1>"), title, F.lit(f"</h1><p>{REMINDER}</p>\n"), F.col("body"), F.lit("</body></html>")).alias("html"))


def layout_plan(blocks: DataFrame, frame_width: float, body_points: float) -> DataFrame:
    """How each table block would be shown in a frame: fit tier, widths, warning."""
    m = B.measures(F.col("rows"))
    t = blocks.filter(F.col("rows").isNotNull()).withColumn("_m", m)
    return t.withColumn("fit", B.fit(F.col("rows"), F.col("_m"), F.lit(frame_width), F.lit(body_points))).drop("_m")


def put_file(path: str, data: bytes) -> None:
    """Write one file in place at once: a temporary neighbour, checked to hold something, then renamed."""
    target = Path(path)
    fd, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
        if not os.path.getsize(name):
            raise ValueError("nothing was written")
        os.replace(name, target)
    finally:
        if os.path.exists(name):
            os.unlink(name)
