"""Whole pages: words, regions and ruling lines become blocks in reading order.

A page's tables come together in one row of arrays, by one shuffle on (doc_id, page_number).  Decisions among its regions (which holds
a word, which belong together, in which order they are read) are expressions on these arrays; then words are rows again, and lines, items, tables
and text are windows and aggregations that keep the same partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as G, text as X
from . import boxes as B, flow as W, grids as T
from .layout import LEAST_SHARE, PAGE, TEXT_KINDS

# Fixed values.
DEFAULT_SIZE, NO_SPLIT, FLOW_GAP, FIGURE_SHARE = 11.0, 1e9, 8.0, 0.1
FOUND_IN_FILE = ("orphan", "embedded_image", "vector_artwork", "ruled_table")
BLANK_LENGTH, BLANK_KINDS, BLANK_LEVEL, BLANK_BESIDE, BLANK_CROSSED = (1.2, 0.62), ("text", "list", "aside", "contents"), 0.75, 2.5, 0.3
UNDER_SHARE, UNDER_RISE, UNDER_DROP, UNDER_SPARE, UNDER_COVERED = 0.6, 0.1, 0.45, 2.5, 0.25
LABEL_CHARS, LABEL_BAND, LABEL_REACH, LETTER_BAND = 3, 4.0, 90.0, 3.0
NOTE_FROM, NOTE_SIZE, NOTE_LENGTH, CAPTION_LENGTH, HEADING_LENGTH, TITLE_SIZE, NUMBER_SIZE = 0.72, 0.88, 25, 80, 160, 1.15, 1.15
GO_ON_INDENT, GO_ON_GAP = (3.0, 45.0), (-4.0, 20.0)
NO_GRID, OTHER_GRID = "The columns of this table could not be told apart.", "This table may differ from the original."

WORD = ("word_id", "text", "x0", "y0", "x1", "y1", "size", "bold", "italic", "underline", "blank", "visual_order", "confidence")
REGION = ("region_id", "kind", "x0", "y0", "x1", "y1", "score", "ord", "label")
RULE = ("rule_id", "x0", "y0", "x1", "y1", "vertical")
STYLES = "array<struct<start:int,end:int,bold:boolean,italic:boolean,underline:boolean>>"
BLOCK = ("type", "text", "level", "role", "list_marker", "indent_level", "confidence", "size", "x0", "y0", "x1", "y1", "styles", "rows", "has_header", "warnings")

_cy = lambda w: (w["y0"] + w["y1"]) / 2
_overlap = lambda a, b: F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])


def _with(s: Column, names: tuple[str, ...], **new: Column) -> Column:
    """A struct with some fields new."""
    return F.struct(*[(new[n] if n in new else s[n]).alias(n) for n in (*names, *(n for n in new if n not in names))])


def gathered(words: DataFrame, regions: DataFrame, rules: DataFrame, pages: DataFrame) -> DataFrame:
    """One row a page: width, height, and sorted arrays of its words, regions (no decoration) and rules."""
    no = lambda c: F.coalesce(c, F.lit(False))
    w = words.select(*PAGE, *[no(c).alias(c) if c in ("bold", "italic", "underline", "blank", "visual_order") else F.coalesce(c, F.lit(1.0)).alias(c) if c == "confidence" else F.col(c) for c in WORD])
    r = regions.filter(~((F.col("kind") == "figure") & no("decorative")))
    rows = lambda df, names, to: df.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*names))).alias(to))
    p = pages.select(*PAGE, F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"))
    for df, names, to in ((w, WORD, "words"), (r, REGION, "regions"), (rules, RULE, "rules")):
        made = rows(df, names, to)
        p = p.join(made, PAGE, "left").withColumn(to, F.coalesce(to, F.array().cast(made.schema[to].dataType)))
    return W.settled(p)


def _real(words: Column) -> Column:
    return F.filter(words, lambda w: ~w["blank"])


def with_ruled_tables(p: DataFrame) -> DataFrame:
    """Pages without detected regions get regions for the grids that their rules make."""
    detected = F.exists("regions", lambda r: ~F.coalesce(r["label"].isin(*FOUND_IN_FILE), F.lit(False)))
    new = F.filter(T.ruled_regions(F.col("rules"), F.col("words")), lambda b: ~F.exists("regions", lambda r: G.coverage(b, r) > LEAST_SHARE))
    last = F.coalesce(F.array_max(F.transform("regions", lambda r: r["region_id"])), F.lit(-1))
    as_region = F.transform(new, lambda b, i: F.struct((last + 1 + i).cast("int").alias("region_id"), F.lit("table").alias("kind"), *[b[s].alias(s) for s in B.SIDES], F.lit(T.RULED_SCORE).alias("score"), (last + 1 + i).cast("double").alias("ord"), F.lit("ruled_table").alias("label")))
    return W.settled(p.withColumn("detected", detected).withColumn("regions", F.when(F.col("detected"), F.col("regions")).otherwise(F.concat("regions", as_region))))


def underlined_by(rule: Column, words: Column) -> Column:
    """The numbers of the words that a level rule lies right under; none where it is longer than they are, or hardly covers them."""
    y = _cy(rule)
    lettered = lambda w: w["text"].rlike(r"[\p{L}\p{N}]") & (_overlap(rule, w) > UNDER_SHARE * F.greatest(F.lit(1.0), w["x1"] - w["x0"]))
    hit = F.filter(words, lambda w: lettered(w) & y.between(w["y0"] - UNDER_RISE * w["size"], w["y1"] + UNDER_DROP * w["size"]))
    length = rule["x1"] - rule["x0"]

    def checked(found: Column) -> Column:
        box = B.union(found)
        fits = (length <= box["x1"] - box["x0"] + UNDER_SPARE * F.array_max(F.transform(found, lambda w: w["size"]))) & (F.aggregate(found, F.lit(0.0), lambda s, w: s + _overlap(rule, w)) > UNDER_COVERED * length)
        return F.when(F.coalesce(fits, F.lit(False)), F.transform(found, lambda w: w["word_id"])).otherwise(F.array().cast("array<int>"))

    return W.let(hit, checked)


def with_blanks(p: DataFrame) -> DataFrame:
    """Words that rules lie under are marked underlined; rules beside words on their line are answer blanks, words with a fixed text."""
    real = _real(F.col("words"))
    body = W.middle(F.transform(real, lambda w: w["size"]))

    def judged(r: Column) -> Column:
        length, y = r["x1"] - r["x0"], _cy(r)
        thick = _with(r, ("x0", "y0", "x1", "y1"), y1=r["y1"] + 0.1)
        holder = F.get(F.filter("regions", lambda g: G.coverage(thick, g) > LEAST_SHARE), F.lit(0))
        usable = ~r["vertical"] & length.between(BLANK_LENGTH[0] * F.col("_body"), BLANK_LENGTH[1] * F.col("width")) & F.coalesce(holder["kind"].isin(*BLANK_KINDS), F.lit(True))
        lined = underlined_by(r, real)
        level = F.filter(real, lambda w: F.abs(w["y1"] - y) <= BLANK_LEVEL * w["size"])
        after = F.filter(level, lambda w: (w["x0"] >= r["x1"] - 2) & (w["x0"] - r["x1"] < BLANK_BESIDE * w["size"]))
        before = F.exists(level, lambda w: (w["x1"] <= r["x0"] + 2) & (r["x0"] - w["x1"] < BLANK_BESIDE * w["size"]))
        crossed = F.aggregate(level, F.lit(0.0), lambda s, w: s + F.greatest(F.lit(0.0), _overlap(r, w)))
        leader = F.coalesce((holder["kind"] == "contents") & F.get(after, F.lit(0))["text"].rlike(r"^\.*\d+\.*$"), F.lit(False))
        size, base = W.middle(F.transform(level, lambda w: w["size"])), W.middle(F.transform(level, lambda w: w["y1"]))
        blank = (F.size(lined) == 0) & ((F.size(after) > 0) | before) & ~leader & (crossed <= BLANK_CROSSED * length)
        word = F.struct(
            F.lit(0).alias("word_id"), F.lit(X.BLANK).alias("text"), r["x0"].alias("x0"), (base - 0.8 * size).alias("y0"), r["x1"].alias("x1"), base.alias("y1"), size.alias("size"),
            *[F.lit(f == "blank").alias(f) for f in WORD[7:12]], F.lit(1.0).alias("confidence"))
        return F.when(F.coalesce(usable, F.lit(False)), F.struct(lined.alias("lined"), F.when(blank, word).alias("word")))

    p = W.settled(p.withColumn("_body", body))
    p = W.settled(p.withColumn("_rules", F.filter(F.transform("rules", judged), lambda x: x.isNotNull())))
    last = F.coalesce(F.array_max(F.transform("words", lambda w: w["word_id"])), F.lit(-1))
    new = F.filter(F.transform("_rules", lambda x: x["word"]), lambda w: w.isNotNull())
    new = W.let(last, lambda n: F.transform(new, lambda w, i: _with(w, WORD, word_id=(n + 1 + i).cast("int"))))
    marked = F.transform("words", lambda w: _with(w, WORD, underline=w["underline"] | F.exists("_rules", lambda x: F.array_contains(x["lined"], w["word_id"]))))
    return W.settled(p.withColumn("words", F.concat(marked, new)).drop("_body", "_rules"))


def with_whole_fragments(p: DataFrame) -> DataFrame:
    """Text regions that continue each other on a line become one; `body` is the page's type size."""
    p = W.settled(p.withColumn("body", F.coalesce(W.middle(F.transform(_real(F.col("words")), lambda w: w["size"])), F.lit(DEFAULT_SIZE))))
    box = lambda x: F.struct(*[x[s].cast("double").alias(s) for s in B.SIDES])
    blanks = F.transform(F.filter("words", lambda w: w["blank"]), box)
    same = B.fragment_of(F.transform("regions", box), F.transform("regions", lambda r: r["kind"].isin("text", "list")), F.col("body"), blanks)
    p = W.settled(p.withColumn("_same", same))

    def merged(r: Column, i: Column) -> Column:
        mine = F.filter("regions", lambda x, k: F.get(F.col("_same"), k) == i)
        b = B.union(mine)
        return F.when(F.get(F.col("_same"), i) == i, _with(r, REGION, **{s: b[s] for s in B.SIDES}, ord=F.array_min(F.transform(mine, lambda x: x["ord"]))))

    return W.settled(p.withColumn("regions", F.filter(F.transform("regions", merged), lambda r: r.isNotNull())).drop("_same"))


def with_holders(p: DataFrame) -> DataFrame:
    """Words get `region`, the one that covers most of them; marginal labels go to their heading, lone punctuation to the text above."""

    def best(w: Column) -> Column:
        share = F.transform("regions", lambda r: F.struct(G.coverage(w, r).alias("share"), (-G.area(r)).alias("a"), (-r["region_id"]).alias("k")))
        return -F.array_max(F.filter(share, lambda s: s["share"] > LEAST_SHARE))["k"]

    held = (*WORD, "region")
    p = W.settled(p.withColumn("words", F.transform("words", lambda w: _with(w, WORD, region=best(w)))))

    def facts(r: Column) -> Column:
        mine = F.filter("words", lambda w: w["region"] == r["region_id"])
        return _with(
            r, REGION, chars=F.aggregate(mine, F.lit(0), lambda n, w: n + F.length(w["text"])), lettered=F.exists(mine, lambda w: w["text"].rlike(r"[\p{L}\p{N}]")), n_real=F.size(_real(mine)),
            largest=F.array_max(F.transform(mine, lambda w: w["size"])), capital=F.forall(mine, lambda w: w["text"].rlike(r"^\p{Lu}+$")))

    p = W.settled(p.withColumn("regions", F.transform("regions", facts)))
    known = (*REGION, "chars", "lettered", "n_real", "largest", "capital")
    p = W.settled(p.withColumn("_heads", F.filter("regions", lambda h: h["kind"].isin("heading", "title"))))
    heads = F.col("_heads")
    beside = lambda mid, x1: lambda h: mid.between(h["y0"] - LABEL_BAND, h["y1"] + LABEL_BAND) & (h["x0"] - x1 >= 0) & (h["x0"] - x1 < LABEL_REACH)
    first = lambda found: F.get(F.transform(found, lambda h: h["region_id"]), F.lit(0))

    def moved(r: Column) -> Column:
        label = r["kind"].isin(*TEXT_KINDS) & ~r["kind"].isin("heading", "title") & r["chars"].between(1, LABEL_CHARS)
        heading = F.when(label, first(F.filter(heads, beside(_cy(r), r["x1"]))))
        opened = F.filter("regions", lambda t: t["kind"].isin("text", "list") & (t["region_id"] != r["region_id"]) & _cy(r).between(t["y0"] - LABEL_BAND, t["y0"] + LETTER_BAND * r["largest"]) & (t["x0"] - r["x1"] >= 0) & (t["x0"] - r["x1"] < LABEL_REACH))
        opens = F.when(label & r["capital"] & heading.isNull(), F.get(opened, F.lit(0)))
        near = F.filter("regions", lambda a: a["kind"].isin("text", "list") & (a["region_id"] != r["region_id"]) & (r["y0"] - a["y1"]).between(-r["largest"], 2 * r["largest"]) & (_overlap(a, r) > -2 * r["largest"]))
        above = F.array_min(F.transform(near, lambda a: F.struct((r["y0"] - a["y1"]).alias("gap"), a["region_id"].alias("id"))))["id"]
        lone = F.when(r["kind"].isin("text", "list") & (r["chars"] > 0) & ~r["lettered"], above)
        return _with(r, known, kind=F.when(opens.isNotNull(), "heading").otherwise(r["kind"]), ord=F.coalesce(opens["ord"] - 0.5, r["ord"]), to=F.coalesce(heading, lone), lone=heading.isNull() & lone.isNotNull())

    p = W.settled(p.withColumn("_moved", F.transform("regions", moved)))
    of = lambda w: F.get(F.filter("_moved", lambda r: r["region_id"] == w["region"]), F.lit(0))
    stray = lambda w: F.when(F.length(w["text"]) <= LABEL_CHARS, first(F.filter(heads, beside(_cy(w), w["x1"]))))
    p = p.withColumn("words", F.transform("words", lambda w: _with(w, held, region=F.when(w["region"].isNull(), stray(w)).otherwise(F.coalesce(of(w)["to"], w["region"])))))
    p = W.settled(p)
    # a blank says nothing without words beside it
    empty = lambda w: F.exists("_moved", lambda r: (r["region_id"] == w["region"]) & (r["n_real"] == 0) & (r["chars"] > 0) & r["to"].isNull())
    p = p.withColumn("words", F.filter("words", lambda w: ~empty(w)))
    lower = lambda r: F.greatest(r["y1"], F.coalesce(F.array_max(F.transform(F.filter("_moved", lambda m: m["lone"] & (m["to"] == r["region_id"])), lambda m: m["y1"])), r["y1"]))
    return W.settled(p.withColumn("regions", F.transform(F.filter("_moved", lambda r: r["to"].isNull()), lambda r: _with(r, REGION, y1=lower(r)))).drop("_moved", "_heads"))


def with_strays(p: DataFrame) -> DataFrame:
    """Words that no region holds get regions of their own, from lines close to each other; these are `strays`."""
    p = W.settled(p.withColumn("_lines", F.array_sort(W.line_boxes(F.filter("words", lambda w: w["region"].isNull())))))
    p = W.settled(p.withColumn("_near", B.near_lines(F.col("_lines"))))
    group = F.transform("_near", lambda g: F.struct(g["box"].alias("box"), F.transform(g["of"], lambda k: F.get(F.col("_lines"), k)).alias("lines")))
    p = p.withColumn("_groups", F.filter(group, lambda g: F.exists(g["lines"], lambda x: ~x["blank"])))
    p = W.settled(p.withColumn("_last", F.coalesce(F.array_max(F.transform("regions", lambda r: r["region_id"])), F.lit(-1))))
    last = F.col("_last")
    strays = F.transform("_groups", lambda g, i: F.struct((last + 1 + i).cast("int").alias("region_id"), F.lit("text").alias("kind"), *[g["box"][s].alias(s) for s in B.SIDES], F.lit(0.0).alias("score"), F.lit(0.0).alias("ord"), F.lit("orphan").alias("label")))
    mine = lambda w: F.get(F.filter(F.transform("_groups", lambda g, i: F.when(F.exists(g["lines"], lambda x: F.array_contains(x["ids"], w["word_id"])), last + 1 + i)), lambda k: k.isNotNull()), F.lit(0))
    words = F.transform("words", lambda w: _with(w, (*WORD, "region"), region=F.coalesce(w["region"], mine(w).cast("int"))))
    return W.settled(p.withColumns({"strays": strays, "words": words}).drop("_lines", "_near", "_groups", "_last"))


def in_order(p: DataFrame, rtl: bool) -> DataFrame:
    """`regions` in reading order, strays among them.

    Where a detector gave an order, strays are put into it; pages written from the right, and pages without such an order, are read by
    their geometry.
    """
    chars = lambda count: F.aggregate(_real(F.col("words")), F.lit(0), lambda n, w: n + count(w["text"]))
    p = p.withColumn("_rtl", F.lit(rtl) | (chars(X.rtl_count) > chars(X.ltr_count)))
    by_ord = F.array_sort("regions", lambda a, b: F.when((a["ord"] < b["ord"]) | ((a["ord"] == b["ord"]) & (a["region_id"] < b["region_id"])), -1).otherwise(1))
    p = W.settled(p.withColumn("_known", by_ord))
    box = lambda x: F.struct(*[x[s].cast("double").alias(s) for s in B.SIDES])
    p = W.settled(p.withColumn("_all", F.when(F.col("detected"), F.col("_known")).otherwise(F.concat("_known", "strays"))))
    p = p.withColumn("_read", F.transform(B.order_of(F.transform("_all", box), F.col("_rtl")), lambda i: F.get(F.col("_all"), i)))
    known = F.when(F.col("_rtl"), F.col("_read")).otherwise(F.col("_known"))
    p = p.withColumn("regions", F.when(F.col("detected"), B.placed(known, F.col("strays"))).otherwise(F.col("_read"))).drop("_known", "_all", "_read", "_rtl", "strays")
    return W.settled(p)


def _items(words: DataFrame) -> DataFrame:
    """Items of text: one row each, with their region's facts.  words: word columns and `r`, their region with `pos` and `way`."""
    area = [*PAGE, "region_id"]
    facts = ["pos", "way", "kind", "label", "r_y0", "height", "body"]
    w = words.withColumns({"way": F.col("way"), "_chars": F.sum(F.length("text") + 1).over(Window.partitionBy(*area)) - 1})
    w = W.columns(w, area, F.when(F.col("way") == "inside", FIGURE_SHARE).otherwise(W.COLUMN_SHARE))
    w = w.withColumn("col", F.when(F.col("way").isin("flow", "inside"), F.col("col")).otherwise(0))
    part = [*area, "col"]
    gap = F.when(F.col("way").isin("heading", "rows"), NO_SPLIT).when(F.col("way") == "flow", FLOW_GAP).otherwise(W.LINE_GAP)
    w = W.line_facts(W.lines(W.with_rows(w, part), part, gap), part)
    w = W.short_columns(w, part).withColumn("side", F.when(F.col("way") == "flow", F.col("side")).otherwise(0))
    w = W.items(w, [*part, "side"], (F.col("kind") == "contents") | (F.col("way") == "rows"))
    # what isn't flowing text is one item, column after column
    whole = F.col("way").isin("heading", "inside", "caption", "running", "number")
    w = w.withColumns({"item": F.when(whole, 0).otherwise(F.col("item")), "line": F.when(whole, F.col("col") * 1_000_000 + F.col("line")).otherwise(F.col("line")), "col": F.when(whole, 0).otherwise(F.col("col"))})
    w = w.withColumn("r_size", F.median(F.when(~F.col("blank"), F.col("size"))).over(Window.partitionBy(*area)))
    w = w.withColumn("legible", F.max(F.regexp_count("text", F.lit(r"\p{L}")) >= 2).over(Window.partitionBy(*area)))
    side = Window.partitionBy(*part, "side")
    first = F.when(F.col("at") == 1, F.col("l_x0"))
    base = F.when(F.count_if(F.col("at") == 1).over(side) > 2, F.median(first).over(side)).otherwise(F.min(first).over(side))
    w = w.withColumn("base", base)
    return W.texts(w, [*part, "side", "item"], [*facts, "r_size", "legible", "base"]).withColumn("base", F.least("base", F.min("first_x0").over(side)))


def _text_blocks(items: DataFrame) -> DataFrame:
    """Blocks of items by what their region is and what they say."""
    order = Window.partitionBy(*PAGE, "region_id").orderBy("col", "side", "item")
    said = F.first("text").over(order)
    is_note = (F.col("kind") == "footnote") | ((F.col("kind") == "text") & (F.col("r_y0") > NOTE_FROM * F.col("height")) & (F.col("r_size") < NOTE_SIZE * F.col("body")) & X.starts_footnote(said))
    runs_on = (F.col("kind") == "footer") & X.starts_footnote(said) & (F.length(said) > NOTE_LENGTH)
    x = items.withColumn("base_type", F.when(F.col("way") == "heading", "heading").when(F.col("way") == "caption", "caption").when(F.col("way") == "inside", "caption").when(runs_on | is_note, "footnote").when(F.col("way").isin("running", "number") | (F.col("kind") == "aside"), "aside").otherwise("paragraph"))
    x = x.withColumn("marker", F.when(F.col("way") == "flow", X.list_marker(F.col("text"))))
    each = F.col("kind") == "contents"
    listed = (F.col("base_type") == "paragraph") & F.col("marker").isNotNull() & ~each
    numbered = F.col("marker").rlike(r"^\(?\d+[.)]*$") & ~(F.col("size") >= NUMBER_SIZE * F.col("body"))
    run_in = (F.col("way") == "flow") & (F.col("base_type") == "paragraph") & (F.col("n_lines") <= 2) & F.col("lettered") & F.col("all_bold") & ~F.coalesce(numbered, F.lit(False)) & (F.length("text") < HEADING_LENGTH) & ~F.col("text").rlike("[,;]$")
    x = x.withColumn("type", F.when(run_in, "heading").when(listed, "list").otherwise(F.col("base_type")))
    role = (
        F.when(F.col("way") == "number", "page_number").when((F.col("way") == "running") & ~runs_on, "running_text").when(F.col("way") == "rows", "table_row").when((F.col("way") == "inside") & (F.col("kind") == "formula"), "formula_text")
        .when(F.col("way") == "inside", "figure_text").when(F.col("kind") == "title", "title").when(each & ~run_in, "contents").when((F.col("type") == "list") & X.is_dialogue(F.col("text")), "dialogue"))
    x = x.withColumn("role", role)
    x = x.withColumn("list_marker", F.when(F.col("type") == "list", F.col("marker")))
    indent = G.indent_level(F.col("first_x0"), F.col("base"), F.col("size"))
    after_number = F.coalesce(F.lag("list_marker").over(order).rlike(r"^\d"), F.lit(False))
    indent = F.when((F.col("role") == "dialogue") & after_number, F.greatest(indent, F.lit(1))).otherwise(indent)
    speaker = X.speaker_after_number(F.col("text"))
    at = (F.instr("text", speaker) - 1).cast("int")
    named = F.when(speaker.isNotNull() & (F.col("way") == "flow"), F.array(F.struct(at.alias("start"), (at + F.length(speaker)).cast("int").alias("end"), F.lit(True).alias("bold"), F.lit(False).alias("italic"), F.lit(False).alias("underline"))))
    plain = F.col("type").isin("heading", "caption", "aside") | F.col("way").isin("rows")
    return x.filter((F.col("way") != "inside") | F.col("legible")).select(
        *PAGE, "height", "pos", F.lit(1).alias("part"), "col", "side", "item", "type", "text", F.when(F.col("kind") == "title", 1).when(F.col("way") == "heading", 2).when(run_in, 3).cast("int").alias("level"), "role", "list_marker",
        F.when((F.col("way") == "flow") & ~run_in, indent).otherwise(0).cast("int").alias("indent_level"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
        F.when(F.col("way") == "heading", F.col("largest") * F.when(F.col("kind") == "title", TITLE_SIZE).otherwise(1.0)).when(F.col("way") == "flow", F.col("size")).alias("size"), "x0", "y0", "x1", "y1",
        F.when(plain, F.array().cast(STYLES)).otherwise(F.concat("styles", F.coalesce(named, F.array().cast(STYLES))).cast(STYLES)).alias("styles"),
        F.lit(None).cast(T.CELLS).alias("rows"), F.lit(None).cast("boolean").alias("has_header"), F.when((F.col("way") == "rows") & (F.row_number().over(order) == 1), F.array(F.lit(NO_GRID))).otherwise(F.array().cast("array<string>")).alias("warnings"), runs_on.alias("late"))


def _region_blocks(regions: DataFrame) -> DataFrame:
    """A block for each table with a grid, and for each picture."""
    r = regions.filter(F.col("way").isin("grid", "inside", "picture"))
    grid = F.col("way") == "grid"
    sure = F.coalesce("grid.confidence", F.lit(1.0))
    none = lambda t: F.lit(None).cast(t)
    return r.select(
        *PAGE, "height", "pos", F.lit(0).alias("part"), *[F.lit(0).alias(c) for c in ("col", "side", "item")], F.when(grid, "table").otherwise("image").alias("type"), none("string").alias("text"), none("int").alias("level"), none("string").alias("role"), none("string").alias("list_marker"),
        F.lit(0).alias("indent_level"), sure.alias("confidence"), none("double").alias("size"), "x0", "y0", "x1", "y1", F.array().cast(STYLES).alias("styles"), F.col("grid.rows").alias("rows"), F.col("grid.has_header").alias("has_header"),
        F.when(sure < T.DOUBTFUL, F.array(F.lit(OTHER_GRID))).otherwise(F.array().cast("array<string>")).alias("warnings"), F.lit(False).alias("late"))


def joined(blocks: DataFrame, group: str) -> DataFrame:
    """Blocks of a page with one value of `group` as one: texts with a space between, emphasis moved along, a box around all, warnings
    once.  The first block in `ord` gives everything else."""
    key = [*PAGE, group]
    before = Window.partitionBy(*key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.transform("styles", lambda s: F.struct((s["start"] + F.col("_at")).alias("start"), (s["end"] + F.col("_at")).alias("end"), *[s[f].alias(f) for f in W.FLAGS]))
    b = blocks.withColumn("_at", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int")).withColumn("styles", moved.cast(STYLES))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ord", c))), lambda x: x[c])
    made = {
        "ord": F.min("ord"), "text": F.when(F.count("text") > 0, F.array_join(in_order("text"), " ")), "styles": F.flatten(in_order("styles")), "confidence": F.min("confidence"),
        "x0": F.min("x0"), "y0": F.min("y0"), "x1": F.max("x1"), "y1": F.max("y1"), "warnings": F.array_distinct(F.flatten(in_order("warnings"))),
    }
    rest = {c: F.min_by(F.struct(c), "ord")[c] for c in blocks.columns if c not in key and c not in made}
    return b.groupBy(*key).agg(*[x.alias(c) for c, x in (made | rest).items()]).select(*blocks.columns)


def continued_items(blocks: DataFrame) -> DataFrame:
    """A plain line indented under a list item, close below it, belongs to it; so does the next one below that.  Boxes have y upwards."""
    w = Window.partitionBy(*PAGE).orderBy("ord")
    up = lambda c: F.lag(c).over(w)
    opens = (F.col("type") == "list") & (F.coalesce("role", F.lit("")) != "dialogue")
    head = F.last(F.when(opens, F.col("x0")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fits = (F.col("type") == "paragraph") & F.col("role").isNull() & F.col("text").isNotNull() & (F.col("x0") - head).between(*GO_ON_INDENT) & (up("y0") - F.col("y1")).between(*GO_ON_GAP)
    b = blocks.withColumn("_fits", F.coalesce(fits, F.lit(False)))
    b = b.withColumn("_run", F.sum((~F.col("_fits")).cast("int")).over(w))
    run = Window.partitionBy(*PAGE, "_run").orderBy("ord")
    listed = F.first(opens).over(run)
    b = b.withColumn("_to", F.when(F.col("_fits") & listed, F.first("ord").over(run)).otherwise(F.col("ord"))).drop("_fits", "_run")
    return joined(b, "_to").drop("_to")


def whole_sentences(blocks: DataFrame) -> DataFrame:
    """Text that pictures and captions cut in two is one again, with the pictures after it."""
    w = Window.partitionBy(*PAGE).orderBy("ord")
    between = F.col("type").isin("image", "caption")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(~between, F.struct("ord", "type", "text")), ignorenulls=True).over(earlier)
    b = blocks.withColumns({"_last": last, "_cut": F.lag(between).over(w)})
    goes_on = F.col("_cut") & F.col("_last.type").isin("paragraph", "list") & F.regexp_replace("_last.text", rf"{X.SPACE}+$", "").rlike(X.OPEN_ENDING) & (F.col("type") == "paragraph") & F.col("text").rlike(r"^\p{Ll}")
    b = b.withColumn("_on", F.coalesce(goes_on, F.lit(False)))
    # what was itself put back isn't gone on with
    was = F.last(F.when(~between, F.col("_on")), ignorenulls=True).over(earlier)
    b = b.withColumn("_to", F.when(F.col("_on") & ~F.coalesce(was, F.lit(False)), F.col("_last.ord")).otherwise(F.col("ord"))).drop("_last", "_cut", "_on")
    return joined(b, "_to").drop("_to")


def captions(blocks: DataFrame) -> DataFrame:
    """Short paragraphs that read like captions, right after a picture or right before a picture or table, are captions."""
    w = Window.partitionBy(*PAGE).orderBy("ord")
    near = F.coalesce(F.lag("type").over(w) == "image", F.lit(False)) | F.coalesce(F.lead("type").over(w).isin("table", "image"), F.lit(False))
    return blocks.withColumn("type", F.when(near & (F.col("type") == "paragraph") & (F.length("text") <= 200) & X.is_caption(F.col("text")), "caption").otherwise(F.col("type")))


def laid_out(words: DataFrame, regions: DataFrame, rules: DataFrame, pages: DataFrame, rtl: bool = False) -> DataFrame:
    """One row a page: arrays of its words, each with its region, and of its regions in reading order."""
    p = with_blanks(with_ruled_tables(gathered(words, regions, rules, pages)))
    return in_order(with_strays(with_holders(with_whole_fragments(p))), rtl)


def assemble_pages(words: DataFrame, regions: DataFrame, rules: DataFrame, pages: DataFrame, rtl: bool = False) -> DataFrame:
    """(doc_id, page_number, ord, ...): the blocks of all pages in reading order; figures are image blocks without pixels."""
    p = laid_out(words, regions, rules, pages, rtl)
    r = p.select(*PAGE, "height", "body", F.posexplode("regions").alias("pos", "r"), F.col("rules").alias("_rules"), F.col("words").alias("_words"))
    mine = F.filter("_words", lambda w: w["region"] == F.col("r.region_id"))
    r = r.withColumns({"n_real": F.size(_real(mine)), "ruling": T.ruling(F.col("r"), F.col("_rules")), "words": mine}).drop("_rules", "_words")
    r = W.settled(r.select(*PAGE, "height", "body", "pos", "n_real", "ruling", "words", *[f"r.{c}" for c in REGION]))
    table = (F.col("kind") == "table") & (F.col("n_real") > 0)
    none = F.array().cast(r.schema["words"].dataType)
    r = T.built(r.withColumns({"_all": F.col("words"), "words": F.when(table, F.col("words")).otherwise(none)})).withColumn("words", F.col("_all")).drop("_all")
    chars = F.aggregate("words", F.lit(0), lambda n, w: n + F.length(w["text"]) + 1) - 1
    note = X.starts_footnote(F.array_join(F.transform("words", lambda w: w["text"]), " ")) & (chars > NOTE_LENGTH)
    way = (
        F.when(F.col("grid").isNotNull(), "grid").when(F.col("kind").isin("figure", "formula"), "inside").when(table, "rows").when(F.col("kind") == "table", "picture").when(F.col("kind").isin("title", "heading"), "heading")
        .when((F.col("kind") == "caption") & (F.coalesce(F.col("label").isin("figure_title", "table_title"), F.lit(False)) | (chars <= CAPTION_LENGTH)), "caption").when(F.col("kind") == "page_number", "number")
        .when((F.col("kind") == "header") | ((F.col("kind") == "footer") & ~note), "running").otherwise("flow"))
    r = W.settled(r.withColumn("way", way))
    w = r.filter(~F.col("way").isin("grid", "picture")).select(*PAGE, "region_id", "pos", "way", "kind", "label", F.col("y0").alias("r_y0"), "height", "body", F.explode("words").alias("w")).select("*", *[f"w.{c}" for c in WORD]).drop("w")
    b = _text_blocks(_items(w)).unionByName(_region_blocks(r))
    b = b.withColumns({"y0": F.col("height") - F.col("y1"), "y1": F.col("height") - F.col("y0")})
    order = Window.partitionBy(*PAGE).orderBy("late", "pos", "part", "col", "side", "item")
    b = b.withColumn("ord", F.row_number().over(order) - 1).select(*PAGE, "ord", *BLOCK)
    b = captions(continued_items(b))
    last = Window.partitionBy(*PAGE).orderBy((F.col("type") == "footnote").cast("int"), "ord")
    b = whole_sentences(b.withColumn("ord", F.row_number().over(last) - 1))
    return b.withColumn("ord", F.row_number().over(Window.partitionBy(*PAGE).orderBy("ord")) - 1)
