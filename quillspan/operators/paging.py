"""Blocks on sheets of large print: which sheet each block stands on, and which source pages a sheet shows.

Sizes are in twentieths of a point, so that sums are exact.  What a block needs to begin on a sheet comes from windows over its
document: a heading needs itself, the headings after it, and the first lines of what follows, so no heading is the last of its
sheet.  Filling the sheets is a running sum that begins anew where a block doesn't fit; it is taken over the sorted rows of a
document as they stream by, with two numbers in memory.

Edge cases: blocks without text take a line; a block taller than a sheet goes on over the next ones; a picture or fixed height beyond
the sheet's is the sheet's; null kinds are paragraphs; documents without blocks have no sheets; a doc_id may be null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import tables as B

# Paper (width, height, margin, room for the footer) in points; for each kind its type size, leading, space before and
# space after in parts of the body, and whether it stays with what follows.
SHEETS = {"A4": (595.276, 841.89, 51.024, 22.677), "A3": (841.89, 1190.551, 62.362, 22.677)}
SMALL, SMALLEST, MARKER_LEAST = 0.82, 14.0, 12.0
WIDOW = 2
MARKER_ROOM, FIGURE_ROOM, FIGURE_LINES = 6, 8, 2


def kinds(body: float, spacing: float) -> dict[str, tuple[int, int, int, int, bool]]:
    """kind -> (type size, leading, before, after, stays with the next), in twentieths of a point."""
    small, mark = max(SMALLEST, SMALL * body), max(MARKER_LEAST, 0.65 * body)
    caption = max(small, 0.9 * body)
    points = {
        "h1": (1.55 * body, 1.9 * body, body, 0.45 * body, True), "h2": (1.3 * body, 1.62 * body, 0.9 * body, 0.4 * body, True), "h3": (1.1 * body, 1.42 * body, 0.75 * body, 0.35 * body, True),
        "body": (body, body * spacing, 0, 0.6 * body, False), "list": (body, body * spacing, 0, 0.35 * body, False), "caption": (caption, caption * 1.35, 0.2 * body, 0.7 * body, False),
        "footnote": (small, small * 1.4, 0, 0.35 * body, False), "marker": (mark, mark * 1.3, 1.05 * body, 0.5 * body, True), "picture": (body, body, 0, 0.6 * body, False),
    }
    return {k: (*(round(20 * x) for x in v[:4]), v[4]) for k, v in points.items()}


def _kind(following: Column) -> Column:
    t, level = F.coalesce("type", F.lit("paragraph")), F.greatest(F.lit(1), F.least(F.lit(3), F.coalesce("level", F.lit(2))))
    plain = {"list": "list", "caption": "caption", "footnote": "footnote", "page_marker": "marker"}
    out = F.when(t == "title", "h1").when(t == "heading", F.concat(F.lit("h"), level.cast("string"))).when(F.col("points").isNotNull(), "picture")
    for name, kind in plain.items():
        out = out.when(t == name, kind)
    return out.otherwise("body")


def measured(blocks: DataFrame, body: float = 20.0, spacing: float = 1.5, paper: str = "A4", sheet_per_page: bool = False) -> DataFrame:
    """blocks with n (lines), lead, before, after (twentieths), need (room that a block asks for where it begins) and fresh (begins a sheet).

    blocks(doc_id, ord, type, level, text, source_page, points): points is a picture's or table's height, null for text.
    """
    width, height = frame(paper)
    of = kinds(body, spacing)
    look = F.create_map(*(x for k, v in of.items() for x in (F.lit(k), F.struct(*(F.lit(a).alias(n) for a, n in zip(v, ("size", "lead", "before", "after", "keep")))))))
    w = Window.partitionBy("doc_id").orderBy("ord")
    x = blocks.withColumns({"_next": F.lead("type").over(w)}).withColumn("_k", _kind(F.col("_next")))
    x = x.withColumn("_f", F.element_at(look, F.col("_k")))
    per_line = F.lit(100 * width)
    lines = F.aggregate(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(0).cast("long"), lambda a, t: a + F.greatest(F.lit(1).cast("long"), F.ceil(F.length(t) * F.col("_f.size") * round(100 * B.CHAR_WIDTH) / per_line)))
    tall = F.least(F.lit(height), F.ceil(20 * F.col("points")))
    x = x.withColumns({"n": F.when(F.col("_k") == "picture", 1).otherwise(lines).cast("long"), "lead": F.when(F.col("_k") == "picture", tall).otherwise(F.col("_f.lead")).cast("long"), "before": F.col("_f.before").cast("long"), "after": F.col("_f.after").cast("long")})
    # a heading before a picture or table asks for room, but doesn't draw it along
    free = F.col("_k").isin("h1", "h2", "h3") & F.coalesce(F.col("_next").isin("table", "image"), F.lit(False))
    x = x.withColumn("_keep", F.col("_f.keep") & ~free & F.col("_next").isNotNull())
    first = F.col("before") + F.least("n", F.lit(WIDOW)) * F.col("lead")
    own = F.col("before") + F.col("n") * F.col("lead") + F.col("after")
    asked = F.when(F.col("_k") == "marker", F.greatest(first, F.lit(round(20 * body) * MARKER_ROOM))).when(free, F.col("before") + FIGURE_LINES * F.col("lead") + round(20 * body) * FIGURE_ROOM).otherwise(first)
    # runs of blocks that stay together: each asks for the rest of its run and the first lines after it
    x = x.withColumns({"_own": F.when(F.col("_keep"), own).otherwise(0), "_first": F.when(F.col("_keep"), 0).otherwise(asked)})
    x = x.withColumn("_run", F.sum((~F.coalesce(F.lag("_keep").over(w), F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rest = Window.partitionBy("doc_id", "_run").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, 0)
    need = F.greatest(asked, F.sum(F.col("_own") + F.col("_first")).over(rest))
    fresh = (F.col("_k") == "marker") & (F.coalesce("page_marker", F.lit(1)) > 1) if sheet_per_page else F.lit(False)
    return x.withColumns({"need": F.least(need, F.lit(height)).cast("long"), "fresh": fresh}).drop("_next", "_k", "_f", "_keep", "_own", "_first", "_run")


def frame(paper: str) -> tuple[int, int]:
    """Width and height of a sheet's text area."""
    w, h, margin, footer = SHEETS[paper]
    return round(20 * (w - 2 * margin)), round(20 * (h - 2 * margin - footer))


def fill(rows: Iterator[tuple], height: int) -> Iterator[tuple[int, int]]:
    """(first, last) sheet of each block (n, lead, before, after, need, fresh) of a document."""
    sheet, used = 1, 0
    for n, lead, before, after, need, fresh in rows:
        if used and (fresh or used + need > height):
            sheet, used = sheet + 1, 0
        space = before if used else 0
        here = max(1, min(n, (height - used - space) // max(1, lead)))
        first, left = sheet, n - here
        used = min(height, used + space + here * lead)
        if left:
            each = max(1, height // max(1, lead))
            more = -(-left // each)
            sheet, used = sheet + more, (left - (more - 1) * each) * lead
        used = min(height, used + after)
        yield first, sheet


def on_sheets(blocks: DataFrame, paper: str = "A4") -> DataFrame:
    """(doc_id, ord, source_page, first_sheet, last_sheet) of measured blocks."""
    height = frame(paper)[1]
    cols = ("doc_id", "ord", "source_page", "n", "lead", "before", "after", "need", "fresh")
    x = blocks.select(*cols).withColumns({c: F.col(c).cast("long") for c in cols[1:-1]}).repartition("doc_id").sortWithinPartitions("doc_id", "ord")
    out = ("doc_id", "ord", "source_page", "first_sheet", "last_sheet")
    types = [dict(x.dtypes)["doc_id"], *["long"] * 4]

    def run(batches):
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in cols)))
        part: list = []
        for _, doc in groupby(rows, lambda r: r[0]):
            heads: list = []
            for placed in fill(_noted(doc, heads), height):
                part.append((*heads.pop(), *placed))
                if len(part) == 10_000:
                    yield _batch(part, out)
                    part = []
        if part:
            yield _batch(part, out)

    return x.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in zip(out, types)))


def _noted(rows, heads: list):
    for r in rows:
        heads.append(r[:3])
        yield r[3:]


def _batch(rows: list, columns: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(columns, map(list, zip(*rows)))))


def sheets(placed: DataFrame) -> DataFrame:
    """(doc_id, sheet, first_source, last_source, source_label, sheet_label): the footers of a document's sheets."""
    s = placed.select("doc_id", "source_page", F.explode(F.sequence("first_sheet", "last_sheet")).alias("sheet"))
    g = s.groupBy("doc_id", "sheet").agg(F.min("source_page").alias("first_source"), F.max("source_page").alias("last_source"))
    total = F.max("sheet").over(Window.partitionBy("doc_id"))
    one = F.concat(F.lit("Original page "), F.col("first_source").cast("string"))
    label = F.when(F.col("first_source").isNull(), "").when(F.col("first_source") == F.col("last_source"), one).otherwise(F.concat(F.lit("Original pages "), F.col("first_source").cast("string"), F.lit("–"), F.col("last_source").cast("string")))
    return g.select("doc_id", "sheet", "first_source", "last_source", label.alias("source_label"), F.concat(F.lit("Page "), F.col("sheet").cast("string"), F.lit(" of "), total.cast("string")).alias("sheet_label"))
