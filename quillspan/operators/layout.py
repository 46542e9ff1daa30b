"""Spatial joins of words, regions and rules.  All are equi-joins on (doc_id, page_number) with box conditions on top."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as G, text as X

# Fixed values.
PAGE = ["doc_id", "page_number"]
LABEL_KINDS = {
    "doc_title": "title", "paragraph_title": "heading", "text": "text", "abstract": "text", "vertical_text": "text", "reference": "text",
    "reference_content": "text", "algorithm": "text", "content": "contents", "table": "table", "image": "figure", "chart": "figure", "seal": "figure",
    "header_image": "figure", "footer_image": "figure", "figure_title": "caption", "vision_footnote": "caption", "table_title": "caption",
    "footnote": "footnote", "aside_text": "aside", "header": "header", "footer": "footer", "number": "page_number", "display_formula": "formula",
    "inline_formula": "formula", "formula_number": "text",
}
TEXT_KINDS = ("title", "heading", "text", "list", "caption", "footnote", "aside", "contents")
LEAST_SHARE, LEAST_SCORE = 0.5, 0.40
TINY_SHARE, TINY_SIDE, LEAST_SIDE = 0.002, 36.0, 6.0
EMPTY_AREA, EMPTY_PICTURE = 200.0, 2500.0
PICTURE_CONFIDENCE, PICTURE_LETTERS = 0.85, 2
LEAST_TYPE, TYPE_SHARE = 4.0, 0.78
LINES_AT_ONCE = 1000


def box(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in ("x0", "y0", "x1", "y1")])


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*PAGE, *[F.col(c).alias(prefix + c) for c in df.columns if c not in PAGE])


def detected(regions: DataFrame) -> DataFrame:
    """Detector output as regions: known labels with a good score, in the detector's order."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in LABEL_KINDS.items() for x in kv]), F.col("label"))
    return regions.withColumn("kind", kind).filter(F.col("kind").isNotNull() & (F.col("score") >= LEAST_SCORE))


def assign_words(words: DataFrame, regions: DataFrame) -> DataFrame:
    """words with region_id: the region that covers most of the word, more than half of it; of equal ones the smaller."""
    shown = regions.filter(~((F.col("kind") == "figure") & F.coalesce("decorative", F.lit(False))))
    # a page has few regions: they come to each of its words as one array, so that words are shuffled once and no pair becomes a row
    of_page = shown.groupBy(*PAGE).agg(F.collect_list(F.struct("region_id", "x0", "y0", "x1", "y1")).alias("_regions"))
    share = lambda r: F.struct(G.coverage(box(), r).alias("share"), (-G.area(r)).alias("a"), (-r["region_id"]).alias("k"))
    best = F.array_max(F.filter(F.transform("_regions", share), lambda s: s["share"] > LEAST_SHARE))
    found = words.join(of_page, PAGE, "left").select(*words.columns, best.alias("_best"))
    return found.select(*words.columns, (-F.col("_best.k")).alias("region_id"), F.col("_best.share").alias("share"))


def orphans(words: DataFrame, regions: DataFrame) -> DataFrame:
    return assign_words(words, regions).filter(F.col("region_id").isNull()).select(*words.columns)


def margin_headings(words: DataFrame, regions: DataFrame) -> DataFrame:
    """Short words left of a heading on its line: (word_id, region_id of the first such heading)."""
    h = _prefixed(regions.filter(F.col("kind").isin("heading", "title")), "r_")
    cy = (F.col("y0") + F.col("y1")) / 2
    j = words.filter(F.length("text") <= 3).join(h, PAGE).filter(cy.between(F.col("r_y0") - 4, F.col("r_y1") + 4) & (F.col("r_x0") - F.col("x1") >= 0) & (F.col("r_x0") - F.col("x1") < 90))
    return j.groupBy(*PAGE, "word_id").agg(F.min("r_region_id").alias("region_id"))


def lone_punctuation(regions: DataFrame, held: DataFrame) -> DataFrame:
    """Text regions without a letter or digit, and the nearest text region above that they belong to.

    held: (page, region_id, letters, size) - letters and digits in the region's words, and their largest size.
    """
    t = regions.filter(F.col("kind").isin("text", "list"))
    alone = t.join(held.filter("letters = 0"), [*PAGE, "region_id"])
    a = _prefixed(t, "a_")
    gap = F.col("y0") - F.col("a_y1")
    side = F.least("a_x1", "x1") > F.greatest("a_x0", "x0") - 2 * F.col("size")
    j = alone.join(a, PAGE).filter((F.col("a_region_id") != F.col("region_id")) & gap.between(-F.col("size"), 2 * F.col("size")) & side)
    return j.groupBy(*PAGE, "region_id").agg(F.min(F.struct(gap.alias("gap"), "a_region_id")).alias("m")).select(*PAGE, "region_id", F.col("m.a_region_id").alias("above"))


def underlined(words: DataFrame, rules: DataFrame) -> DataFrame:
    """(page, word_id, rule_id): words that a level rule lies right under; box edges and answer lines don't count."""
    lettered = words.filter(F.col("text").rlike(r"[\p{L}\p{N}]"))
    r = _prefixed(rules.filter(~F.col("vertical")), "r_")
    y = (F.col("r_y0") + F.col("r_y1")) / 2
    over = F.least("r_x1", "x1") - F.greatest("r_x0", "x0")
    hit = lettered.join(r, PAGE).filter((over > 0.6 * F.greatest(F.lit(1.0), F.col("x1") - F.col("x0"))) & (y >= F.col("y0") - 0.1 * F.col("size")) & (y <= F.col("y1") + 0.45 * F.col("size")))
    hit = hit.withColumn("over", over)
    rule = hit.groupBy(*PAGE, "r_rule_id").agg(F.sum("over").alias("covered"), (F.max("x1") - F.min("x0")).alias("extent"), F.max("size").alias("s"), F.first(F.col("r_x1") - F.col("r_x0")).alias("length"))
    good = rule.filter((F.col("length") <= F.col("extent") + 2.5 * F.col("s")) & (F.col("covered") > 0.25 * F.col("length"))).select(*PAGE, "r_rule_id")
    return hit.join(good, [*PAGE, "r_rule_id"]).select(*PAGE, "word_id", F.col("r_rule_id").alias("rule_id"))


def empty_regions(regions: DataFrame, words: DataFrame) -> DataFrame:
    """Text, table and picture regions that no word covers by more than half: what recognition still has to read."""
    readable = F.col("kind").isin(*TEXT_KINDS, "table") & (G.area(box()) > EMPTY_AREA) | (F.col("kind") == "figure") & (G.area(box()) > EMPTY_PICTURE)
    r = regions.filter(readable)
    w = _prefixed(words, "w_")
    held = r.join(w, PAGE).filter(G.coverage(box("w_"), box()) > LEAST_SHARE).select(*PAGE, "region_id").distinct()
    return r.join(held, [*PAGE, "region_id"], "left_anti")


def figures(regions: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(figures to show, count of tiny ones by page): decorative ones and slivers go, tiny ones are counted."""
    f = regions.filter((F.col("kind") == "figure") & ~F.coalesce("decorative", F.lit(False))).join(pages.select(*PAGE, F.col("width").alias("_w"), F.col("height").alias("_h")), PAGE)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    f = f.filter((w >= LEAST_SIDE) & (h >= LEAST_SIDE))
    tiny = (w * h < TINY_SHARE * F.col("_w") * F.col("_h")) & (F.greatest(w, h) < TINY_SIDE)
    return f.filter(~tiny).drop("_w", "_h"), f.groupBy(*PAGE).agg(F.count_if(tiny).alias("tiny"))


def picture_words(words: DataFrame) -> DataFrame:
    return words.filter((F.col("confidence") >= PICTURE_CONFIDENCE) & (F.regexp_count("text", F.lit(r"\p{L}")) >= PICTURE_LETTERS))


def embedded_original(figures_: DataFrame, images: DataFrame) -> DataFrame:
    """(region_id, image_id): figures that are one embedded image and no other."""
    i = _prefixed(images, "i_")
    a, b = G.coverage(box(), box("i_")), G.coverage(box("i_"), box())
    j = figures_.join(i, PAGE).withColumns({"both": F.least(a, b), "any": F.greatest(a, b)})
    n = j.groupBy(*PAGE, "region_id").agg(F.count_if(F.col("both") >= 0.85).alias("same"), F.count_if((F.col("both") < 0.85) & (F.col("any") > 0.2)).alias("other"), F.max(F.when(F.col("both") >= 0.85, F.col("i_image_id"))).alias("image_id"))
    return n.filter("same = 1 and other = 0").select(*PAGE, "region_id", "image_id")


def edge_slivers(regions: DataFrame, words: DataFrame, pages: DataFrame) -> DataFrame:
    """Narrow regions at a scanned page's edge with broken or doubtful words."""
    p = pages.filter("classification <> 'native'").select(*PAGE, F.col("width").alias("_w"))
    r = regions.filter(F.col("kind").isin("aside", "text")).join(p, PAGE).filter(((F.col("x0") < 0.05 * F.col("_w")) | (F.col("x1") > 0.95 * F.col("_w"))) & (F.col("x1") - F.col("x0") < 0.2 * F.col("_w")))
    a = assign_words(words, regions).filter(F.col("region_id").isNotNull() & ~F.coalesce("blank", F.lit(False)))
    s = a.groupBy(*PAGE, "region_id").agg(F.avg(F.length("text")).alias("l"), F.avg("confidence").alias("c")).filter("l < 3.5 or c < 0.8")
    return r.join(s, [*PAGE, "region_id"], "left_semi").drop("_w")


def interval_groups(spans: DataFrame, keys: list[str], low: str, high: str, slack: float | Column) -> DataFrame:
    """spans with `grp`: a new group starts where a span begins more than `slack` beyond all before it."""
    w = Window.partitionBy(*keys).orderBy(low, high)
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = spans.withColumn("_new", F.coalesce((F.col(low) > reach + slack).cast("int"), F.lit(0)))
    return s.withColumn("grp", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def line_aggregates(words: DataFrame, keys: list[str]) -> DataFrame:
    """Size (median), boldness (by characters), confidence (least) and box of each line."""
    real = ~F.coalesce("blank", F.lit(False))
    chars = F.when(real, F.length("text")).otherwise(0)
    return words.groupBy(*keys).agg(
        F.coalesce(F.median(F.when(real, F.col("size"))), F.first("size")).alias("size"), (F.sum(F.when(F.col("bold"), chars).otherwise(0)) * 2 > F.sum(chars)).alias("bold"),
        F.min("confidence").alias("confidence"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def _recognised(lines: DataFrame, *more: str) -> DataFrame:
    size = F.greatest(F.lit(LEAST_TYPE), (F.col("y1") - F.col("y0")) * TYPE_SHARE)
    return lines.withColumns({"text": X.strip(F.col("text")), "size": size}).filter("text <> ''").select(*PAGE, "line_id", "text", "x0", "y0", "x1", "y1", "size", "confidence", *more)


def _walked(text: str, tokens: list[dict | None]) -> list[tuple[str, float | None, float | None]] | None:
    """(text, x0, x1) of the words that a line's tokens spell; None where they don't spell it."""
    out: list[list] = []
    at = end = 0
    for t in tokens:
        said = ((t and t["text"]) or "").strip()
        if not said:
            continue
        while at < len(text) and text[at].isspace():
            at += 1
        if not text.startswith(said, at):
            return None
        if not out or at > end:
            out.append([])
        out[-1].append((said, t["x0"], t["x1"]))
        at = end = at + len(said)
    if not out or end < len(text):
        return None
    edge = lambda f, w, k: f((t[k] for t in w if t[k] is not None), default=None)
    return [w[0] if len(w) == 1 else ("".join(t[0] for t in w), edge(min, w, 1), edge(max, w, 2)) for w in out]


def _shared(text: str, x0: float, x1: float) -> list[tuple[str, float, float]]:
    """A line's words with its width shared by characters, a space between two words."""
    out, at, words = [], 0, text.split()
    unit = (x1 - x0) / (sum(map(len, words)) + len(words) - 1)
    for w in words:
        out.append((w, x0 + at * unit, x0 + (at + len(w)) * unit))
        at += len(w) + 1
    return out


def ocr_words(lines: DataFrame) -> DataFrame:
    """Recognised lines (text, box, confidence) as words: by their tokens where these spell the line, else by shares of its width.

    A column `tokens` (array<struct<text, x0, x1>>, in order) is aligned with the line's text in steps that never go back: a
    token's place is the count of characters other than spaces before it, so it stands where the text has its next such
    character.  A line is aligned if each token stands there letter by letter and all its characters are used up.  A word begins
    where a space was passed; tokens without a space between them make one word, a token with a space in it stays one word.  Lines whose tokens
    are missing, don't fit or cross a space are shared out.  Null and empty lines have no words; a line_id is unique on its page.

    Each line is worked out by itself in an Arrow function, some lines at a time; nothing is shuffled.  X.SPACE is what Python takes for space.
    """
    has = "tokens" in lines.columns
    x = _recognised(lines, *["tokens"] * has)
    x = x.select(*PAGE, "line_id", "y0", "y1", "size", "confidence", "text", F.col("x0").cast("double").alias("x0"), F.col("x1").cast("double").alias("x1"), *["tokens"] * has)
    kept = [*PAGE, "line_id", "y0", "y1", "size", "confidence"]

    def run(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, LINES_AT_ONCE):
                b = whole.slice(first, LINES_AT_ONCE)
                tokens = b.column("tokens").to_pylist() if has else [None] * b.num_rows
                found = [_walked(s, t or ()) or _shared(s, low, high) for s, t, low, high in zip(b.column("text").to_pylist(), tokens, b.column("x0").to_pylist(), b.column("x1").to_pylist())]
                of = np.repeat(np.arange(b.num_rows), [len(w) for w in found])
                k = np.concatenate([np.arange(len(w), dtype=np.int32) for w in found])
                text, low, high = zip(*(w for line in found for w in line))
                new = [pa.array(k), pa.array(text, pa.string()), pa.array(low, pa.float64()), pa.array(high, pa.float64())]
                yield pa.RecordBatch.from_arrays([*b.select(kept).take(pa.array(of)).columns, *new], names=[*kept, "k", "text", "x0", "x1"])

    key = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.select(*kept).schema.fields)
    words = x.mapInArrow(run, f"{key}, k int, text string, x0 double, x1 double")
    return words.select(*PAGE, "line_id", "k", "text", "x0", "y0", "x1", "y1", "size", "confidence")


def block_records(blocks: DataFrame, method: Column, page_height: Column) -> DataFrame:
    """Blocks with language, direction, box in document points, method, clamped confidence and page-wise ids."""
    counts = X.script_counts(F.col("text"))
    n = F.row_number().over(Window.partitionBy(*PAGE).orderBy("ord"))
    sure = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))), 3)
    return blocks.withColumns({
        "language": X.language(counts), "text_direction": X.direction(counts), "source_bounding_box": G.flipped(box(), page_height), "confidence": sure,
        "extraction_method": F.when((method == "native") & (F.coalesce("text", F.lit("")) != "") & (F.col("confidence") < 1), "ocr_fast").otherwise(method),
        "id": F.concat(F.lit("p"), F.col("page_number").cast("string"), F.lit("_b"), n.cast("string"))})
