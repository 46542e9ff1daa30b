"""Words into rows, lines, columns, items and text.

Words are a table with one row a word; `keys` name the area (page, region, column) that a step stays within.  Rows come from one fold
over an area's words; everything after that is window functions over the same partitioning, so that an area's words are shuffled once,
by page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from .layout import interval_groups

# Tolerances in parts of the type size.
LEVEL, SHARED, OPEN_ROWS = 0.42, 0.6, 6
CELL_LEVEL, CELL_ROWS = 0.45, 3
LINE_GAP, WIDE_GAP = 2.5, 2.2
COLUMN_GAP, COLUMN_SHARE, COLUMN_SPAN, COLUMN_WORDS = 1.5, 0.2, 0.2, 6
PART_FROM, PART_LINES, PART_STARTS, PART_GRID = 0.25, 2, 2, 4
ITEM_GAP, LEAST_ITEM_GAP, HANGING, FIRST_INDENT = 0.45, 0.55, 0.6, 1.2
FLAGS = ("bold", "italic", "underline")

_ROW = "struct<no:int,mids:array<double>,top:double,bottom:double,size:double>"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def settled(df: DataFrame) -> DataFrame:
    """df with its columns worked out here, once a row: the optimizer would move an expression into the lambda that uses it, and there
    it would run once for each element."""
    return df.select(F.explode(F.array(F.struct("*"))).alias("_row")).select("_row.*")


def middle(a: Column) -> Column:
    """Median of an array of numbers; null of an empty one."""
    s = F.array_sort(a)
    last = F.size(a) - 1
    return (F.get(s, F.floor(last / 2).cast("int")) + F.get(s, F.ceil(last / 2).cast("int"))) / 2


def row_numbers(words: Column, tolerance: float, open_rows: int, shared: float | None) -> Column:
    """array<int>: the row of each word of an array in order of height.

    A word stands in the latest of the rows still open whose middle it is level with, or (where `shared` is given) whose height it
    shares so much of; otherwise it opens a row.
    """

    def step(state: Column, w: Column) -> Column:
        def level(r: Column) -> Column:
            near = F.abs(w["cy"] - middle(r["mids"])) <= tolerance * F.greatest(r["size"], w["size"], F.lit(1.0))
            if shared is None:
                return near
            common = F.least(w["y1"], r["bottom"]) - F.greatest(w["y0"], r["top"])
            return near | (common >= shared * F.least(w["y1"] - w["y0"], r["bottom"] - r["top"]))

        def next_state(hit: Column) -> Column:
            fresh = F.struct(state["n"].alias("no"), F.array(w["cy"]).alias("mids"), w["y0"].alias("top"), w["y1"].alias("bottom"), w["size"].alias("size"))
            wider = lambda r: F.struct(r["no"].alias("no"), F.concat(r["mids"], F.array(w["cy"])).alias("mids"), F.least(r["top"], w["y0"]).alias("top"), F.greatest(r["bottom"], w["y1"]).alias("bottom"), F.greatest(r["size"], w["size"]).alias("size"))
            rows = F.when(hit < 0, F.slice(F.concat(F.array(fresh), state["open"]), 1, open_rows)).otherwise(F.transform(state["open"], lambda r: F.when(r["no"] == hit, wider(r)).otherwise(r)))
            return F.struct(rows.alias("open"), (state["n"] + F.when(hit < 0, 1).otherwise(0)).alias("n"), F.concat(state["out"], F.array(F.when(hit < 0, state["n"]).otherwise(hit))).alias("out"))

        hits = F.transform(F.filter(state["open"], level), lambda r: r["no"])
        return let(F.coalesce(F.array_max(hits), F.lit(-1)), next_state)

    nothing = F.struct(F.array().cast(f"array<{_ROW}>").alias("open"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(words, nothing, step, lambda s: s["out"])


def with_rows(words: DataFrame, keys: list[str], tolerance: float = LEVEL, open_rows: int = OPEN_ROWS, shared: float | None = SHARED) -> DataFrame:
    """words with `row`, the visual row within their area (numbers tell rows apart, they aren't in order)."""
    cy = ((F.col("y0") + F.col("y1")) / 2).alias("cy")
    rest = [c for c in words.columns if c not in keys]
    each = F.struct(cy, F.col("x0"), F.col("word_id"), "y0", "y1", "size", F.struct(*rest).alias("w"))
    areas = words.groupBy(*keys).agg(F.array_sort(F.collect_list(each)).alias("_words"))
    rows = settled(areas.withColumn("_rows", row_numbers(F.col("_words"), tolerance, open_rows, shared)))
    spread = rows.select(*keys, F.explode(F.arrays_zip(F.col("_words")["w"].alias("w"), F.col("_rows").alias("row"))).alias("_x"))
    return spread.select(*keys, *[F.col(f"_x.w.{c}").alias(c) for c in rest], F.col("_x.row").alias("row"))


def line_boxes(words: Column, gap: float = LINE_GAP) -> Column:
    """array<struct(y0, x0, x1, y1, size, ids, blank)>: the lines that an array of words makes, each with its words' numbers."""
    by_height = F.array_sort(F.transform(words, lambda w: F.struct(((w["y0"] + w["y1"]) / 2).alias("cy"), w["x0"].alias("x0"), w["word_id"].alias("id"), *[w[c].alias(c) for c in ("x1", "y0", "y1", "size", "blank")])))

    def parts(row: Column) -> Column:
        def step(acc: Column, w: Column) -> Column:
            last = F.get(acc, F.size(acc) - 1)
            alone = F.struct(w["y0"].alias("y0"), w["x0"].alias("x0"), w["x1"].alias("x1"), w["y1"].alias("y1"), F.array(w["size"]).alias("sizes"), F.array(w["id"]).alias("ids"), w["blank"].alias("blank"))
            wider = F.struct(
                F.least(last["y0"], w["y0"]).alias("y0"), last["x0"].alias("x0"), F.greatest(last["x1"], w["x1"]).alias("x1"), F.greatest(last["y1"], w["y1"]).alias("y1"), F.concat(last["sizes"], F.array(w["size"])).alias("sizes"),
                F.concat(last["ids"], F.array(w["id"])).alias("ids"), (last["blank"] & w["blank"]).alias("blank"))
            near = w["x0"] - last["x1"] <= gap * F.greatest(w["size"], F.get(last["sizes"], F.size(last["sizes"]) - 1))
            return F.when(F.coalesce(near, F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(wider))).otherwise(F.concat(acc, F.array(alone)))

        kind = "array<struct<y0:double,x0:double,x1:double,y1:double,sizes:array<double>,ids:array<int>,blank:boolean>>"
        return F.aggregate(F.array_sort(F.transform(row, lambda w: F.struct(w["x0"].alias("x0"), w["id"].alias("id"), *[w[c].alias(c) for c in ("x1", "y0", "y1", "size", "blank")]))), F.array().cast(kind), step)

    def made(pair: Column) -> Column:
        rows = F.transform(F.array_distinct(pair["row"]), lambda k: F.transform(F.filter(F.arrays_zip(pair["w"].alias("w"), pair["row"].alias("row")), lambda x: x["row"] == k), lambda x: x["w"]))
        found = F.flatten(F.transform(rows, parts))
        return F.transform(found, lambda x: F.struct(*[x[c].alias(c) for c in ("y0", "x0", "x1", "y1")], middle(x["sizes"]).alias("size"), x["ids"].alias("ids"), x["blank"].alias("blank")))

    return let(by_height, lambda w: let(F.struct(w.alias("w"), row_numbers(w, LEVEL, OPEN_ROWS, SHARED).alias("row")), made))


def lines(words: DataFrame, keys: list[str], gap: Column | float = LINE_GAP) -> DataFrame:
    """words of `with_rows` with `line`, numbered from the top, and `at`, the place in the line as it is read.

    Rows of mostly right-to-left letters are read from the right, with runs of other words in their own order, unless their words are
    stored as they look.  Where neighbours are more than `gap` type sizes apart, a row is two lines.
    """
    whole, across = Window.partitionBy(*keys, "row"), Window.partitionBy(*keys, "row").orderBy("x0", "word_id")
    rtl = F.col("text").rlike(f"[{X.RTL}]")
    turned = (F.sum(X.rtl_count(F.col("text"))).over(whole) > F.sum(X.ltr_count(F.col("text"))).over(whole)) & ~F.max(F.coalesce("visual_order", F.lit(False))).over(whole)
    w = words.withColumns({"_rtl": rtl, "_turned": turned})
    w = w.withColumn("_run", F.sum(F.coalesce(F.col("_rtl") != F.lag("_rtl").over(across), F.lit(False)).cast("int")).over(across))
    w = w.withColumns({"_a": F.when(F.col("_turned"), -F.col("_run")).otherwise(0), "_b": F.when(F.col("_turned") & F.col("_rtl"), -F.col("x0")).otherwise(F.col("x0"))})
    read = Window.partitionBy(*keys, "row").orderBy("_a", "_b", "word_id")
    before = lambda c: F.lag(c).over(read)
    apart = F.greatest(F.col("x0") - before("x1"), before("x0") - F.col("x1")) > gap * F.greatest("size", before("size"))
    w = w.withColumn("_part", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(read))
    part = Window.partitionBy(*keys, "row", "_part")
    w = w.withColumns({"_top": F.bround(F.min("y0").over(part)), "_left": F.min("x0").over(part)})
    w = w.withColumn("line", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_top", "_left", "row", "_part")))
    w = w.withColumn("at", F.row_number().over(Window.partitionBy(*keys, "line").orderBy("_a", "_b", "word_id")))
    return w.drop("_rtl", "_turned", "_run", "_a", "_b", "_part", "_top", "_left")


def columns(words: DataFrame, keys: list[str], share: Column | float = COLUMN_SHARE) -> DataFrame:
    """words with `col`: columns inside an area, parted where a wide stretch is free of words.

    A column begins where words with enough of the text and width stand apart from such words before; slighter ones belong to what
    is left of them.
    """
    area = Window.partitionBy(*keys)
    real = ~F.coalesce("blank", F.lit(False))
    chars = F.when(real, F.length("text")).otherwise(0)
    w = words.withColumns({"_left": F.min("x0").over(area), "_span": F.max("x1").over(area) - F.min("x0").over(area), "_size": F.median(F.when(real, F.col("size"))).over(area), "_n": F.count_if(real).over(area)})
    w = w.withColumns({"_low": F.floor(F.col("x0") - F.col("_left")), "_high": F.floor(F.col("x1") - F.col("_left"))})
    w = interval_groups(w, keys, "_low", "_high", COLUMN_GAP * F.coalesce("_size", F.lit(0.0))).withColumnRenamed("grp", "_g")
    group = Window.partitionBy(*keys, "_g")
    stands = (F.sum(chars).over(group) >= share * F.greatest(F.sum(chars).over(area), F.lit(1))) & (F.max("x1").over(group) - F.min("x0").over(group) >= COLUMN_SPAN * F.col("_span"))
    w = w.withColumns({"_stands": stands, "_first": F.row_number().over(group.orderBy("x0", "word_id")) == 1})
    order = Window.partitionBy(*keys).orderBy("_g")
    w = w.withColumn("_opens", F.col("_stands") & F.coalesce(F.max("_stands").over(order.rangeBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    col = F.sum((F.col("_opens") & F.col("_first")).cast("int")).over(order.rangeBetween(Window.unboundedPreceding, 0))
    w = w.withColumn("col", F.when(F.col("_n") < COLUMN_WORDS, 0).otherwise(col).cast("int"))
    return w.drop("_left", "_span", "_size", "_n", "_low", "_high", "_g", "_stands", "_first", "_opens")


def side(spans: Column) -> Column:
    """Where two short columns set close to each other part, or null: spans is an array of the lines' (x0, x1).

    The first start well inside the area with whole lines on either side, enough of them, the right ones beginning at one or two places.
    """
    low, high = F.array_min(F.transform(spans, lambda s: s["x0"])), F.array_max(F.transform(spans, lambda s: s["x1"]))

    def parts(at: Column) -> Column:
        left, right = (lambda s: s["x1"] <= at + 1), (lambda s: s["x0"] >= at - 1)
        clean = F.forall(spans, lambda s: left(s) != right(s))
        starts = F.array_distinct(F.transform(F.filter(spans, right), lambda s: F.bround(s["x0"] / PART_GRID)))
        return clean & (F.size(F.filter(spans, left)) >= PART_LINES) & (F.size(F.filter(spans, right)) >= PART_LINES) & (F.size(starts) <= PART_STARTS)

    inside = F.transform(F.filter(spans, lambda s: s["x0"] > low + PART_FROM * (high - low)), lambda s: F.bround(s["x0"]))
    return F.array_min(F.filter(F.array_distinct(inside), parts))


def line_facts(words: DataFrame, keys: list[str]) -> DataFrame:
    """words of `lines` with facts of their line, in columns beginning with `l_`: box, size, weight, confidence and text."""
    line = Window.partitionBy(*keys, "line")
    real = ~F.coalesce("blank", F.lit(False))
    chars = F.when(real, F.length("text")).otherwise(0)
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text")).over(line)), lambda x: x["text"]), " ")
    return words.withColumns({
        "l_x0": F.min("x0").over(line), "l_y0": F.min("y0").over(line), "l_x1": F.max("x1").over(line), "l_y1": F.max("y1").over(line),
        "l_size": F.coalesce(F.median(F.when(real, F.col("size"))).over(line), F.max("size").over(line)), "l_bold": 2 * F.sum(F.when(F.col("bold"), chars).otherwise(0)).over(line) > F.sum(chars).over(line),
        "l_confidence": F.min(F.coalesce("confidence", F.lit(1.0))).over(line), "l_text": said,
    })


def short_columns(words: DataFrame, keys: list[str]) -> DataFrame:
    """words of `line_facts` with `side`, 1 for lines right of the place where two short columns part."""
    area = Window.partitionBy(*keys)
    spans = F.collect_list(F.when(F.col("at") == 1, F.struct(F.col("l_x0").alias("x0"), F.col("l_x1").alias("x1")))).over(area)
    w = words.withColumn("_spans", spans)
    w = w.withColumn("_at", side(F.col("_spans"))).drop("_spans")
    return w.withColumn("side", F.coalesce(F.col("l_x0") >= F.col("_at") - 1, F.lit(False)).cast("int")).drop("_at")


def item_numbers(these: Column) -> Column:
    """array<int>: the item of each line of an array in order.

    A line opens an item by its marker or the gap above it, and in three ways that depend on the item before: it returns to the edge
    of a hanging indent, it is indented after a full sentence, or plain text follows a short bold item.  Lines without a letter or
    digit never do.
    """

    def step(s: Column, x: Column) -> Column:
        hangs = s["marked"] & (s["n"] > 1) & (x["x0"] < s["second"] - HANGING * x["both"]) & (F.abs(x["x0"] - s["first"]) < HANGING * x["both"])
        indented = ~s["marked"] & x["indented"]
        plain = (s["n"] <= 2) & s["bold"] & x["lighter"]
        opens = (s["no"] < 0) | (x["lettered"] & (x["opens"] | hangs | indented | plain))
        begun = F.struct((s["no"] + 1).alias("no"), F.lit(1).alias("n"), x["x0"].alias("first"), F.lit(0.0).alias("second"), x["marked"].alias("marked"), x["bold"].alias("bold"))
        longer = F.struct(s["no"].alias("no"), (s["n"] + 1).alias("n"), s["first"].alias("first"), F.when(s["n"] == 1, x["x0"]).otherwise(s["second"]).alias("second"), s["marked"].alias("marked"), (s["bold"] & x["bold"]).alias("bold"))
        return let(F.when(opens, begun).otherwise(longer), lambda now: F.struct(*[now[c].alias(c) for c in ("no", "n", "first", "second", "marked", "bold")], F.concat(s["out"], F.array(now["no"])).alias("out")))

    start = F.struct(F.lit(-1).alias("no"), F.lit(0).alias("n"), F.lit(0.0).alias("first"), F.lit(0.0).alias("second"), F.lit(False).alias("marked"), F.lit(False).alias("bold"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(these, start, step, lambda s: s["out"])


def items(words: DataFrame, keys: list[str], each: Column) -> DataFrame:
    """words of `line_facts` with `item`: paragraphs and list items of an area; every line one where `each` holds."""
    rest = [c for c in words.columns if c not in keys]
    areas = words.withColumn("_each", each).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line", "at", F.struct(*rest).alias("w")))).alias("_words"), F.max("_each").alias("_each"))
    areas = settled(areas.withColumn("_lines", F.transform(F.filter("_words", lambda x: x["at"] == 1), lambda x: F.struct(*[x["w"][c].alias(c) for c in ("line", "l_x0", "l_y0", "l_y1", "l_size", "l_bold", "l_text")]))))
    gaps = F.filter(F.transform("_lines", lambda x, i: x["l_y0"] - F.get(F.col("_lines"), i - 1)["l_y1"]), lambda g: g.isNotNull())
    areas = settled(areas.withColumn("_usual", F.coalesce(middle(gaps), F.lit(0.0))))
    sure = lambda c: F.coalesce(c, F.lit(False))

    def facts(x: Column, up: Column) -> Column:
        both = F.coalesce(F.greatest(x["l_size"], up["l_size"]), x["l_size"])
        said = F.regexp_replace(up["l_text"], rf"{X.SPACE}+$", "")
        marked = x["l_text"].rlike(X.MARKER)
        gap = x["l_y0"] - up["l_y1"] > F.greatest(F.col("_usual") + ITEM_GAP * both, LEAST_ITEM_GAP * both)
        return F.struct(
            x["l_x0"].alias("x0"), both.alias("both"), marked.alias("marked"), x["l_bold"].alias("bold"), sure(marked | gap).alias("opens"), sure((x["l_x0"] > up["l_x0"] + FIRST_INDENT * both) & said.rlike("[.!?:]$")).alias("indented"),
            sure(~x["l_bold"] & (up["l_size"] >= x["l_size"]) & ~said.rlike("[,;]$")).alias("lighter"), x["l_text"].rlike(r"[\p{L}\p{N}]").alias("lettered"))

    areas = settled(areas.withColumn("_facts", F.transform("_lines", lambda x, i: facts(x, F.get(F.col("_lines"), i - 1)))))
    number = F.when(F.col("_each"), F.transform("_lines", lambda _, i: i)).otherwise(item_numbers(F.col("_facts")))
    areas = settled(areas.withColumn("_items", F.map_from_arrays(F.col("_lines")["line"], number)))
    x = areas.select(*keys, "_items", F.explode("_words").alias("_x"))
    return x.select(*keys, *[F.col(f"_x.w.{c}").alias(c) for c in rest], F.element_at("_items", F.col("_x.line")).alias("item"))


def _emphasis(words: Column) -> Column:
    """Spans of words in a row with the same flag, for flags that mark some words of the text but not all."""
    real = F.filter(words, lambda w: ~w["blank"])

    def spans(flag: str) -> Column:
        def step(acc: Column, w: Column) -> Column:
            last = F.get(acc, F.size(acc) - 1)
            joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["no"].alias("no"), last["start"].alias("start"), w["end"].alias("end"), w["k"].alias("k"))))
            fresh = F.concat(acc, F.array(F.struct(F.size(acc).alias("no"), w["start"].alias("start"), w["end"].alias("end"), w["k"].alias("k"))))
            return F.when(F.coalesce(last["k"] == w["k"] - 1, F.lit(False)), joined).otherwise(fresh)

        marked = F.filter(real, lambda w: w[flag])
        runs = F.aggregate(marked, F.array().cast("array<struct<no:int,start:int,end:int,k:int>>"), step)
        out = F.transform(runs, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), *[F.lit(f == flag).alias(f) for f in FLAGS]))
        return F.when(F.size(marked) < F.size(real), out).otherwise(F.array().cast("array<struct<start:int,end:int,bold:boolean,italic:boolean,underline:boolean>>"))

    return F.concat(*[spans(f) for f in FLAGS])


def texts(words: DataFrame, keys: list[str], carried: list[str] = ()) -> DataFrame:
    """One row for each item (the last of `keys`): its reflowed text, the spans of emphasis, box, size, confidence and facts of its lines.

    A word broken at a line's end is joined again and keeps its hyphen; words of one line set far apart begin a new line of text.
    """
    w = words.filter(X.strip(F.col("text")) != "").withColumn("blank", F.coalesce("blank", F.lit(False)))
    read = Window.partitionBy(*keys).orderBy("line", "at")
    before = lambda c: F.lag(c).over(read)
    same = before("line") == F.col("line")
    broken = ~same & (F.col("at") == 1) & before("text").endswith("-") & (before("text") != "-") & F.col("text").rlike(r"^\p{Ll}")
    wide = same & ~F.col("blank") & ~before("blank") & (F.col("x0") - before("x1") > WIDE_GAP * F.greatest("size", before("size")))
    glue = F.when(before("text").isNull() | broken, "").when(wide, "\n").otherwise(" ")
    w = w.withColumns({"_glue": glue, "_k": F.row_number().over(read)})
    w = w.withColumn("_end", F.sum(F.length("_glue") + F.length("text")).over(read).cast("int"))
    word = F.struct(F.col("_k").alias("k"), F.concat("_glue", "text").alias("t"), (F.col("_end") - F.length("text")).alias("start"), F.col("_end").alias("end"), "blank", *[F.coalesce(f, F.lit(False)).alias(f) for f in FLAGS])
    lettered = ~F.col("blank") & F.col("text").rlike(r"\p{L}")
    new = F.lit(True) if "at" not in w.columns else ~F.coalesce(same, F.lit(False))
    w = w.withColumn("_new", new)
    of_line = lambda c: F.when(F.col("_new"), F.col(c))
    sure = of_line("l_confidence")
    g = w.groupBy(*keys, *carried).agg(
        F.array_sort(F.collect_list(word)).alias("_w"), F.count_if("_new").alias("n_lines"), F.median(of_line("l_size")).alias("size"), F.max("l_size").alias("largest"), F.least(F.avg(sure), F.min(sure) + 0.2).alias("confidence"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min_by("l_x0", F.struct("line", "at")).alias("first_x0"),
        (F.count_if(lettered) > 0).alias("lettered"), (F.count_if(lettered & ~F.coalesce("bold", F.lit(False))) == 0).alias("all_bold"), F.count_if(~F.col("blank")).alias("n_real"))
    return g.withColumns({"text": F.array_join(F.transform("_w", lambda x: x["t"]), ""), "styles": _emphasis(F.col("_w"))}).drop("_w")
