"""Tables of a page: where ruling lines make a grid, and the grid of a region from its lines or its white space.

A table is one row of a DataFrame, with its words as an array: columns come from counting how many rows cover each point and taking the
gaps between points that enough rows cover; both by numbers that an Arrow function gets as flat arrays, while texts stay in Spark.  All steps
grow with a table's words, not with their square.  Nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrow, text as X
from .boxes import union
from .flow import CELL_LEVEL, CELL_ROWS, let, settled

# Fixed values.
SAME_HEIGHT, LEAST_VERTICALS, LEAST_LEVELS, LEVEL_REACH, LEVEL_SLACK = 4.0, 3, 2, 6.0, 3.0
RULED_SCORE = 0.5
LEVEL_MERGE, EDGE_MARGIN, LONG, COLUMN_STEP = 1.2, 4.0, 0.5, 2.0
COVERED, LEAST_GAP, GAP = 0.08, 4.0, 0.9
LEAST_WORDS, FULL, MOSTLY_BOLD, MOST_EMPTY_ROWS = 4, 0.6, 0.8, 8
SURE_RULED, SURE_FULL, UNSURE = 0.9, 0.8, 0.55
DOUBTFUL = 0.6
CELLS = "array<array<struct<text:string,row_span:int,col_span:int,is_header:boolean>>>"

_x = lambda r: (r["x0"] + r["x1"]) / 2
_y = lambda r: (r["y0"] + r["y1"]) / 2


def ruled_regions(rules: Column, words: Column) -> Column:
    """array<struct(x0, y0, x1, y1)>: grids on a page, where verticals of one height are crossed by level rules over words in rows."""
    upright = F.filter(rules, lambda r: r["vertical"])

    def of(v: Column) -> Column:
        like = F.filter(upright, lambda u: (F.abs(u["y0"] - v["y0"]) <= SAME_HEIGHT) & (F.abs(u["y1"] - v["y1"]) <= SAME_HEIGHT))
        return F.struct(F.array_min(F.transform(like, lambda u: u["rule_id"])).alias("first"), F.size(like).alias("n"), union(like).alias("box"))

    def holds(g: Column) -> Column:
        b = g["box"]
        across = F.filter(rules, lambda r: ~r["vertical"] & _y(r).between(b["y0"] - LEVEL_SLACK, b["y1"] + LEVEL_SLACK) & (r["x0"] <= b["x0"] + LEVEL_REACH) & (r["x1"] >= b["x1"] - LEVEL_REACH))
        inside = F.filter(words, lambda w: (X.strip(w["text"]) != "") & _x(w).between(b["x0"], b["x1"]) & _y(w).between(b["y0"], b["y1"]))
        rows = F.array_max(F.transform(inside, _y)) - F.array_min(F.transform(inside, _y)) > CELL_LEVEL * F.array_max(F.transform(inside, lambda w: w["size"]))
        return (g["n"] >= LEAST_VERTICALS) & (F.size(across) >= LEAST_LEVELS) & F.coalesce(rows, F.lit(False))

    # a group is known by its first rule
    groups = F.transform(F.filter(F.transform(upright, lambda v: F.struct(v["rule_id"].alias("id"), of(v).alias("g"))), lambda v: v["id"] == v["g"]["first"]), lambda v: v["g"])
    return F.transform(F.filter(groups, holds), lambda g: g["box"])


def ruling(region: Column, rules: Column) -> Column:
    """struct(vx, hy): the places of a region's inner verticals, and the heights of its level lines that reach over half of it."""
    inner = F.filter(rules, lambda r: r["vertical"] & (_x(r) > region["x0"] + EDGE_MARGIN) & (_x(r) < region["x1"] - EDGE_MARGIN) & (r["y1"] - r["y0"] > LONG * (region["y1"] - region["y0"])))
    level = F.filter(rules, lambda r: ~r["vertical"] & _y(r).between(region["y0"] - 2, region["y1"] + 2) & (r["x1"] > region["x0"]) & (r["x0"] < region["x1"]))
    pieces = F.array_sort(F.transform(level, lambda r: F.struct(_y(r).alias("y"), (r["x1"] - r["x0"]).alias("n"))))

    def step(acc: Column, p: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        fresh = F.struct(p["y"].alias("a"), p["y"].alias("b"), p["n"].alias("n"))
        longer = F.struct(last["a"].alias("a"), p["y"].alias("b"), (last["n"] + p["n"]).alias("n"))
        return F.when(F.coalesce(p["y"] - last["b"] <= LEVEL_MERGE, F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(fresh)))

    levels = F.aggregate(pieces, F.array().cast("array<struct<a:double,b:double,n:double>>"), step)
    long = F.filter(levels, lambda v: v["n"] > LONG * (region["x1"] - region["x0"]))
    return F.struct(F.array_sort(F.transform(inner, _x)).alias("vx"), F.transform(long, lambda v: (v["a"] + v["b"]) / 2).alias("hy"))


def _apart(vx: np.ndarray, step: float) -> np.ndarray:
    """Places without those that follow the one kept before too closely."""
    kept: list[float] = []
    for x in vx:
        if not kept or x - kept[-1] > step:
            kept.append(x)
    return np.array(kept)


def free_columns(row: np.ndarray, x0: np.ndarray, x1: np.ndarray, left: float, size: float) -> np.ndarray:
    """Places between columns: the middles of stretches that (nearly) all rows leave free."""
    point = lambda x: np.maximum(0, np.floor(x - left)).astype(np.int64)
    a, b = point(np.minimum(x0, x1)), point(np.maximum(x0, x1))
    # each row covers its points once: its spans that meet are one, rows laid end to end
    base = row * (int(b.max()) + 2)
    order = np.lexsort((a, row))
    low, reach = (a + base)[order], np.maximum.accumulate((b + base)[order])
    first = np.flatnonzero(np.r_[True, low[1:] > reach[:-1]])
    last = np.r_[first[1:] - 1, len(low) - 1]
    at, which = np.unique(np.r_[low[first] - base[order][first], reach[last] - base[order][last] + 1], return_inverse=True)
    covering = np.cumsum(np.bincount(which[: len(first)], minlength=len(at)) - np.bincount(which[len(first) :], minlength=len(at)))
    held = np.flatnonzero(covering > np.floor(COVERED * len(np.unique(row))))
    a, b = at[held[:-1] + 1] - 1, at[held[1:]]
    wide = b - a - 1 >= max(LEAST_GAP, GAP * size)
    return left + (a[wide] + 1 + b[wide]) / 2


def _rows(cy: np.ndarray, size: np.ndarray) -> np.ndarray:
    """`flow.row_numbers` of a table's words in order of height, with the middles of the rows still open at hand."""
    out = np.empty(len(cy), dtype=np.int64)
    opened: list[list] = []  # number and type size of a row, the latest first
    middles: list[list[float]] = []
    for i, (y, s) in enumerate(zip(cy.tolist(), size.tolist())):
        for r in opened:
            m = middles[r[0]]
            last = len(m) - 1
            if abs(y - (m[last // 2] + m[-(-last // 2)]) / 2) <= CELL_LEVEL * max(r[1], s, 1.0):
                m.append(y)
                r[1] = max(r[1], s)
                break
        else:
            r = [len(middles), s]
            middles.append([y])
            if len(opened) == CELL_ROWS:
                middles[opened.pop()[0]] = []
            opened.insert(0, r)
        out[i] = r[0]
    return out


def laid_out(x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray, size: np.ndarray, bold: np.ndarray, vx: np.ndarray, hy: np.ndarray, left: float) -> dict:
    """The visual row, row of the grid (g) and column (c) of each word of a table, its words in order of height; how many columns, and how
    many words lie in each cell and those before it."""
    n = len(x0)
    if not n:
        return {"row": [], "g": [], "c": [], "cols": 1, "ends": []}
    number = _rows((y0 + y1) / 2, size)
    order = np.argsort(number, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(number[order]) > 0])
    # rows from the top: by height of their highest word
    top = np.minimum.reduceat(y0[order], first)
    place = np.empty(len(top), dtype=np.int64)
    place[np.lexsort((np.arange(len(top)), top))] = np.arange(len(top))
    row = place[number]
    s = np.sort(size)
    middle_size = (s[(n - 1) // 2] + s[n // 2]) / 2
    edges = np.zeros(0) if n < LEAST_WORDS else _apart(vx, COLUMN_STEP * middle_size) if len(vx) else free_columns(row, x0, x1, left, middle_size)
    col = np.searchsorted(np.sort(edges), (x0 + x1) / 2, side="left")

    # rows that go on with the one above: with lines, where none parts them; without, where the first cell is empty and the gap small;
    # plain rows never go on with a bold first row
    order = np.argsort(row, kind="stable")
    tops, bottoms = np.minimum.reduceat(y0[order], first := np.flatnonzero(np.r_[True, np.diff(row[order]) > 0])), np.maximum.reduceat(y1[order], first)
    least, bolds = np.minimum.reduceat(col[order], first), np.logical_and.reduceat(bold[order], first)
    above = np.maximum.accumulate(np.r_[-1e12, bottoms])[:-1]
    levels = np.sort(hy)
    parted = np.searchsorted(levels, tops + 1, side="right") > np.searchsorted(levels, above - 1, side="left")
    close = (least > 0) & (tops - above < GAP * middle_size)
    on = (~parted if len(hy) >= 2 else close).copy()
    on[0] = False
    # the first plain row after bold ones alone, if these are all in the first row of the grid
    plain = int(np.argmin(bolds)) if not bolds.all() else 0
    if plain and on[1:plain].all():
        on[plain] = False
    g, cols = (np.cumsum(~on) - 1)[row], len(edges) + 1
    return {"row": row, "g": g, "c": col, "cols": cols, "ends": np.cumsum(np.bincount(g * cols + col, minlength=(int(g.max()) + 1) * cols))}


@arrow("struct<row:array<int>,g:array<int>,c:array<int>,cols:int,ends:array<int>>")
def _layout(x0: pd.Series, x1: pd.Series, y0: pd.Series, y1: pd.Series, size: pd.Series, bold: pd.Series, vx: pd.Series, hy: pd.Series, left: pd.Series) -> pd.DataFrame:
    numbers = lambda a, kind=float: np.array(a if a is not None else (), dtype=kind)
    found = [laid_out(*map(numbers, of[:5]), numbers(of[5], bool), *map(numbers, of[6:8]), of[8]) for of in zip(x0, x1, y0, y1, size, bold, vx, hy, left)]
    return pd.DataFrame(found, columns=["row", "g", "c", "cols", "ends"])


_WORD = ("word_id", "text", "x0", "y0", "x1", "y1", "size", "bold", "confidence")


def built(regions: DataFrame) -> DataFrame:
    """regions (box, `words`, `ruling`) with `grid`: struct(rows, has_header, confidence), null where columns can't be told apart."""
    real = F.filter("words", lambda w: X.strip(w["text"]) != "")
    by_height = F.array_sort(F.transform(real, lambda w: F.struct(_y(w).alias("cy"), w["x0"].alias("at"), *[w[c].alias(c) for c in _WORD])))
    r = settled(regions.withColumn("_w", by_height))
    each = lambda k: F.transform("_w", lambda w: w[k])
    r = r.withColumn("_at", _layout(each("x0"), each("x1"), each("y0"), each("y1"), each("size").cast("array<double>"), F.transform("_w", lambda w: F.coalesce(w["bold"], F.lit(False))), "ruling.vx", "ruling.hy", F.col("x0").cast("double")))
    zipped = F.arrays_zip("_w", F.col("_at.row").alias("row"), F.col("_at.g").alias("g"), F.col("_at.c").alias("c"))
    r = settled(r.withColumns({
        "_w": F.array_sort(F.transform(zipped, lambda x: F.struct(x["g"].alias("g"), x["c"].alias("c"), x["row"].alias("row"), *[x["_w"][c].alias(c) for c in ("x0", "word_id", "text", "bold", "confidence", "y1")]))),
        "_cols": F.col("_at.cols"), "_ends": F.col("_at.ends"), "_n": F.nullif((F.size("_at.ends") / F.col("_at.cols")).cast("int"), F.lit(0))}).drop("_at"))
    hy = F.col("ruling.hy")

    # words are sorted by cell and place in it, so that each cell's are a slice
    def said(k: Column) -> Column:
        start = F.coalesce(F.get("_ends", k - 1), F.lit(0))
        return F.array_join(F.transform(F.slice("_w", start + 1, F.get("_ends", k) - start), lambda w: w["text"]), " ")

    table = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.transform(F.sequence(F.lit(0), F.col("_cols") - 1), lambda c: said(i * F.col("_cols") + c)))
    r = settled(r.withColumn("_text", F.when((F.col("_cols") > 1) & (F.col("_n") > 0), table)))
    head, body = F.filter("_w", lambda w: w["g"] == 0), F.filter("_w", lambda w: w["g"] > 0)
    lone = F.col("_n") == 1
    first_cells = F.size(F.array_distinct(F.transform(head, lambda w: w["c"])))
    bold_body = F.size(F.filter(body, lambda w: w["bold"])) < MOSTLY_BOLD * F.greatest(F.lit(1), F.size(body))
    below = let(F.array_max(F.transform("_w", lambda w: w["y1"])), lambda b: F.size(F.filter(hy, lambda y: y > b + 2)))
    filled = F.size(F.array_distinct(F.transform("_w", lambda w: w["g"] * 10_000 + w["c"]))) / (F.col("_n") * F.col("_cols"))
    sure = F.when((F.size("ruling.vx") > 0) | (F.size(hy) >= 2), SURE_RULED).when(filled >= FULL, SURE_FULL).otherwise(UNSURE)
    r = settled(r.withColumns({
        "_head": F.when(lone, True).otherwise(F.forall(head, lambda w: w["bold"]) & bold_body), "_sure": F.when(lone, SURE_FULL).otherwise(F.least(sure, F.array_min(F.transform("_w", lambda w: w["confidence"])))),
        "_empty": F.when(lone, F.greatest(F.lit(1), F.least(F.lit(MOST_EMPTY_ROWS), below - 1))).otherwise(0), "_ok": F.col("_text").isNotNull() & (~lone | (first_cells >= 2))}))
    blank = F.array_repeat(F.array_repeat(F.lit(""), F.col("_cols")), F.col("_empty"))
    cells = F.transform(F.concat("_text", blank), lambda row, i: F.transform(row, lambda t: F.struct(t.alias("text"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), (F.col("_head") & (i == 0)).alias("is_header"))))
    grid = F.struct(cells.cast(CELLS).alias("rows"), F.col("_head").alias("has_header"), F.col("_sure").alias("confidence"))
    return settled(r.withColumn("grid", F.when(F.col("_ok"), grid))).select(*regions.columns, "grid")
