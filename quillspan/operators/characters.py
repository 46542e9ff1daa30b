"""Characters and recogniser output as words and regions.  Window functions over the characters of a page, in stream order.

chars(doc_id, page_number, ord, ch, x0, y0, x1, y1, base, size, font, bold, italic, space_before)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import bidi, geometry as G, text as X
from .layout import PAGE, _prefixed, box

# Fixed values.
BASELINE, BACKSTEP, TRACKING, BREAK, FONT_GAP = 0.45, 0.25, 0.6, 0.2, 0.08
TURN_VOTES, TURN_SHARE, TURN_CHARS, STEP = 20, 0.6, 4000, (0.5, 40.0)
LOW_CONFIDENCE = 0.60
BACKGROUND, CONTAINED, LEAST_SIDE = 0.6, 0.85, 6.0
COVER, UNPAINTED = 0.85, (3, 7)


def _rtl(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")).rlike(f"[{X.RTL}]")


def _before(c: str, w) -> Column:
    return F.lag(c).over(w)


def words_from_chars(chars: DataFrame) -> DataFrame:
    """Words by gaps and islands: runs that share a baseline and advance, parted at spaces, wide gaps and changes of font."""
    w = Window.partitionBy(*PAGE).orderBy("ord")
    c = chars.withColumns({f"p_{k}": _before(k, w) for k in ("ch", "x0", "x1", "base", "size")})
    either = _rtl("ch") | _rtl("p_ch")
    back = either & (F.col("x1") <= F.col("p_x1") + BACKSTEP * F.col("p_size"))
    on = (F.abs(F.col("base") - F.col("p_base")) <= BASELINE * F.greatest("size", "p_size")) & ((F.col("x0") >= F.col("p_x0") - BACKSTEP * F.col("p_size")) | back)
    c = c.withColumn("run", F.sum(F.when(F.coalesce(on, F.lit(False)), 0).otherwise(1)).over(w))
    r = Window.partitionBy(*PAGE, "run").orderBy("ord")
    c = c.withColumns({f"q_{k}": _before(k, r) for k in ("ch", "x0", "x1", "size", "font")})
    both = _rtl("ch") | _rtl("q_ch")
    gap = F.when(both & (F.col("x1") <= F.col("q_x1") + BACKSTEP * F.col("q_size")), F.col("q_x0") - F.col("x1")).otherwise(F.col("x0") - F.col("q_x1"))
    c = c.withColumns({"gap": gap, "forward": F.when(_rtl("ch") & _rtl("q_ch"), (F.col("x0") > F.col("q_x0")).cast("int"))})
    whole = Window.partitionBy(*PAGE, "run")
    c = c.withColumn("s", F.median("size").over(whole))
    tight = F.when(~F.col("space_before") & (F.col("gap") < TRACKING * F.col("s")), F.col("gap"))
    c = c.withColumns({"limit": F.greatest(F.lit(0.0), F.coalesce(F.median(tight).over(whole), F.lit(0.0))) + BREAK * F.col("s"), "visual": F.coalesce(F.avg("forward").over(whole) > 0.5, F.lit(False))})
    new = F.col("space_before") | (F.col("gap") > F.col("limit")) | ((F.col("font") != F.col("q_font")) & (F.col("gap") > FONT_GAP * F.col("q_size")))
    c = c.withColumn("word", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(r))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "ch"))), lambda x: x["ch"]), "")
    return c.groupBy(*PAGE, "run", "word").agg(
        F.min("ord").alias("word_id"), text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.median("size").alias("size"),
        (F.avg(F.col("bold").cast("int")) >= 0.5).alias("bold"), (F.avg(F.col("italic").cast("int")) >= 0.5).alias("italic"), (F.max("visual") & F.max(_rtl("ch"))).alias("visual_order")).drop("run", "word")


def reading_quarter(chars: DataFrame) -> DataFrame:
    """(page, quarter): clockwise turns after which most Latin letters advance to the right; 0 without a clear majority."""
    w = Window.partitionBy(*PAGE).orderBy("ord")
    c = chars.select(*PAGE, "ord", "ch", "x0", "base").withColumn("k", F.row_number().over(w) - 1)
    return quarter_of_pairs(c.withColumns({f"p_{n}": _before(n, w) for n in ("ch", "x0", "base")}))


def quarter_of_pairs(pairs: DataFrame) -> DataFrame:
    """reading_quarter of characters that have the one before them at hand (p_ch, p_x0, p_base) and their number k on the page from 0.

    Votes are counted where the characters lie, so only a row a page travels.
    """
    letter = lambda c: F.coalesce(F.col(c).rlike(r"[\p{L}\p{N}]") & ~_rtl(c), F.lit(False))
    dx, dy = F.col("x0") - F.col("p_x0"), F.col("base") - F.col("p_base")
    far = F.abs(dx) + F.abs(dy)
    level = F.abs(dx) >= F.abs(dy)
    vote = F.when(level & (dx > 0), 0).when(level, 2).when(dy > 0, 3).otherwise(1)
    counts = (F.col("k") < TURN_CHARS) & (far > STEP[0]) & (far < STEP[1]) & letter("ch") & letter("p_ch")
    n = pairs.withColumn("_vote", F.when(counts, vote)).groupBy(*PAGE).agg(*(F.count_if(F.col("_vote") == q).alias(f"_{q}") for q in range(4)))
    total = sum((F.col(f"_{q}") for q in range(4)), F.lit(0))
    clear = [F.when((F.col(f"_{q}") >= TURN_VOTES) & (F.col(f"_{q}") > TURN_SHARE * total), q) for q in range(4)]
    return n.select(*PAGE, F.coalesce(*clear, F.lit(0)).alias("quarter"))


def hidden_objects(objects: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, object_id): text that no reader sees, by its render mode or because a picture over the whole page is painted later.

    objects(page, object_id, draw, kind, render_mode, box): what a page paints, in the order of draw.  A page's last covering picture
    is one row, so each page's objects meet one number; objects without a place in the order are painted first.
    """
    size = pages.select(*PAGE, (F.col("width") * F.col("height")).alias("_page"))
    cover = objects.filter("kind = 'image'").join(size, PAGE).filter(G.area(box()) >= COVER * F.col("_page")).groupBy(*PAGE).agg(F.max("draw").alias("_cover"))
    text = objects.filter("kind = 'text'").join(cover, PAGE, "left")
    unseen = F.col("render_mode").isin(*UNPAINTED) | (F.coalesce("draw", F.lit(-1)) < F.col("_cover"))
    return text.filter(F.coalesce(unseen, F.lit(False))).select(*PAGE, "object_id").distinct()


def painted_chars(chars: DataFrame, objects: DataFrame, pages: DataFrame) -> DataFrame:
    """The characters that are seen: not spaces, not of hidden text, of some size, and at least partly on the page.

    chars have object_id; characters without one are kept.
    """
    c = chars.filter(X.strip(F.col("ch")) != "").join(hidden_objects(objects, pages), [*PAGE, "object_id"], "left_anti")
    c = c.join(pages.select(*PAGE, F.col("width").alias("_w"), F.col("height").alias("_h")), PAGE)
    sized = (F.col("x1") > F.col("x0")) | (F.col("y1") > F.col("y0"))
    return c.filter(sized & (F.col("x1") > 0) & (F.col("x0") < F.col("_w")) & (F.col("y1") > 0) & (F.col("y0") < F.col("_h"))).drop("_w", "_h")


def page_text_counts(chars: DataFrame, objects: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """(page, visible, broken, hidden): what routing needs of a page's characters; replacement and private ones are broken.

    With objects and pages, hidden characters (hidden_objects) are counted apart from the visible ones; broken are counted among both.
    """
    bad = F.col("ch").rlike(rf"[{X.REPLACEMENT}\x{{E000}}-\x{{F8FF}}]")
    c = chars.filter(X.strip(F.col("ch")) != "").withColumn("_hidden", F.lit(False))
    if objects is not None:
        unseen = hidden_objects(objects, pages).withColumn("_unseen", F.lit(True))
        c = c.join(unseen, [*PAGE, "object_id"], "left").withColumn("_hidden", F.coalesce("_unseen", F.lit(False)))
    counted = c.groupBy(*PAGE).agg(F.count_if(~F.col("_hidden")).alias("visible"), F.count_if(bad).alias("broken"), F.count_if("_hidden").alias("hidden"))
    return chars.select(*PAGE).distinct().join(counted, PAGE, "left").fillna(0, ["visible", "broken", "hidden"])


def recognised_lines(lines: DataFrame, arabic: bool = False) -> DataFrame:
    """Recogniser lines (polygon array<struct<x,y>>, text, confidence) that are usable, normalised, with their box and doubt."""
    finite = lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))
    whole = (F.size("polygon") == 4) & F.forall("polygon", lambda p: finite(p["x"]) & finite(p["y"]))
    clean = X.strip(bidi.nfc("text"))
    x = lines.filter(whole).withColumn("text", clean).filter(F.col("text") != "")
    if arabic:
        x = x.withColumn("text", bidi.reading_order("text"))
    edge = lambda f, k: f(F.transform("polygon", lambda p: p[k]))
    x = x.withColumns({"x0": edge(F.array_min, "x"), "y0": edge(F.array_min, "y"), "x1": edge(F.array_max, "x"), "y1": edge(F.array_max, "y")})
    return x.withColumns({"doubtful": F.col("confidence") < LOW_CONFIDENCE, "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))})


def image_regions(images: DataFrame, words: DataFrame, pages: DataFrame) -> DataFrame:
    """Embedded pictures as figures in order, cut to the page; slivers, backgrounds under text and contained ones don't count."""
    i = images.join(pages.select(*PAGE, F.col("width").alias("_w"), F.col("height").alias("_h")), PAGE)
    i = i.withColumns({"x0": F.greatest(F.lit(0.0), "x0"), "y0": F.greatest(F.lit(0.0), "y0"), "x1": F.least("_w", "x1"), "y1": F.least("_h", "y1")})
    i = i.filter((F.col("x1") - F.col("x0") >= LEAST_SIDE) & (F.col("y1") - F.col("y0") >= LEAST_SIDE))
    under = i.join(_prefixed(words, "w_"), PAGE).filter(G.coverage(box("w_"), box()) > 0.5).select(*PAGE, "image_id").distinct().withColumn("_text", F.lit(True))
    i = i.join(under, [*PAGE, "image_id"], "left").filter(~((G.area(box()) > BACKGROUND * F.col("_w") * F.col("_h")) & F.coalesce("_text", F.lit(False))))
    # in order, page by page: an image goes if an earlier one that stays contains it
    of_page = i.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("image_id", "x0", "y0", "x1", "y1"))).alias("_all"))
    step = lambda kept, x: F.when(F.exists(kept, lambda k: G.coverage(x, k) > CONTAINED), kept).otherwise(F.concat(kept, F.array(x)))
    stay = of_page.select(*PAGE, F.explode(F.aggregate("_all", F.slice("_all", 1, 0), step)["image_id"]).alias("image_id"))
    kept = i.join(stay, [*PAGE, "image_id"], "left_semi").drop("_w", "_h", "_text")
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0", "x0", "image_id")) - 1
    return kept.withColumns({"kind": F.lit("figure"), "label": F.lit("embedded_image"), "score": F.lit(0.5), "ord": order.cast("double")})


def label_captions(blocks: DataFrame) -> DataFrame:
    """Short paragraphs that read like captions, right after a picture or right before a picture or table, become captions."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    near = (F.lag("type").over(w) == "image") | F.lead("type").over(w).isin("table", "image")
    fits = (F.col("type") == "paragraph") & (F.length("text") <= 200) & X.is_caption(F.col("text"))
    return blocks.withColumn("type", F.when(F.coalesce(near & fits, F.lit(False)), "caption").otherwise(F.col("type")))


def footnotes_last(blocks: DataFrame) -> DataFrame:
    """blocks with `ord` such that each page's footnotes follow its other blocks, order kept otherwise."""
    w = Window.partitionBy("doc_id").orderBy("source_page", (F.col("type") == "footnote").cast("int"), "ord")
    return blocks.withColumn("ord", F.row_number().over(w) - 1)
