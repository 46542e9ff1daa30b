"""Orders and groups of the boxes of a page.  A page has few regions; each function takes their array, as a column or as numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrow, geometry as G
from .flow import let

# Fixed values.
SLACK_X, SLACK_Y = 6.0, 2.0
LINE_HEIGHT, LEVEL, NEAR, BRIDGE = 2.4, 0.5, 12.0, 1.5
CLOSE_BELOW, CLOSE_BESIDE = 0.9, 0.5
CLUSTER_SLACK, LEAST_SIDE, LEAST_PART, MOST_WIDTH = 6.0, 40.0, 0.03, 0.98
SIDES = ("x0", "y0", "x1", "y1")
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def parted(low: np.ndarray, high: np.ndarray, slack: float) -> np.ndarray:
    """A number for each interval: those with no free space wider than `slack` between them share one, from low to high."""
    order = np.lexsort((high, low))
    reach = np.maximum.accumulate(high[order])
    number = np.empty(len(low), dtype=np.int64)
    number[order] = np.r_[0, np.cumsum(low[order][1:] > reach[:-1] + slack)]
    return number


def columns_of(spans: np.ndarray) -> np.ndarray:
    """Intervals (low, high) that free spaces part, from intervals in any order."""
    number = parted(spans[:, 0], spans[:, 1], SLACK_X)
    out = np.stack([np.full(number.max() + 1, np.inf), np.full(number.max() + 1, -np.inf)], axis=1)
    np.minimum.at(out[:, 0], number, spans[:, 0])
    np.maximum.at(out[:, 1], number, spans[:, 1])
    return out


def reading_order(b: np.ndarray, rtl: bool = False) -> list[int]:
    """The order in which boxes (rows of x0, y0, x1, y1) are read.

    A set of boxes is cut into bands from top to bottom.  Bands with a gutter that goes on through the next ones are read together,
    column by column, each column again a set; other bands are read across.
    """
    side = -1 if rtl else 1
    out: list[int] = []
    todo = [np.arange(len(b))]
    while todo:
        these = todo.pop()
        band = parted(b[these, 1], b[these, 3], SLACK_Y) if len(these) else np.zeros(0, np.int64)
        gutters = lambda which: parted(b[which, 0], b[which, 2], SLACK_X)
        in_bands = np.argsort(band, kind="stable")
        first = np.searchsorted(band[in_bands], np.arange(int(band.max()) + 2 if len(band) else 1))
        of = lambda k, end: these[np.sort(in_bands[first[k] : first[end]])]
        # from the bottom up, so that what is read first is on top of the pile
        pile, k, last = [], 0, int(band.max()) + 1 if len(band) else 0
        while k < last:
            end = k + 1
            if first[end] - first[k] == 1:
                pile.append(("read", of(k, end)))
                k = end
                continue
            taken = columns_of(b[of(k, end)][:, [0, 2]])
            while end < last and len(taken) > 1 and len(more := columns_of(np.r_[taken, b[of(end, end + 1)][:, [0, 2]]])) > 1:
                taken, end = more, end + 1
            stretch = of(k, end)
            column = gutters(stretch)
            if not column.max():
                pile.append(("read", stretch[np.lexsort((side * b[stretch, 0], b[stretch, 1]))]))
            else:
                for c in range(int(column.max()) + 1)[::side]:
                    part = stretch[column == c]
                    pile.append(("read", part) if len(part) == 1 else ("cut", part))
            k = end
        for n, (what, part) in enumerate(pile):
            if what == "cut":
                # what comes after an open column waits beneath it
                todo += [p for _, p in pile[n:][::-1]]
                break
            out += part.tolist()
    return out


@arrow("array<int>")
def _order_of(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series, rtl: pd.Series) -> pd.Series:
    side = lambda a: np.array(a if a is not None else (), dtype=float)
    return pd.Series([np.array(reading_order(np.stack([side(a) for a in sides], axis=1), bool(r)), dtype=np.int32) for *sides, r in zip(x0, y0, x1, y1, rtl)])


def order_of(boxes: Column, rtl: Column) -> Column:
    """Places in reading order for an array of boxes, whose sides travel as flat arrays."""
    return _order_of(*(F.transform(boxes, lambda x: x[s].cast("double")) for s in SIDES), rtl)


def _array(boxes) -> np.ndarray:
    return np.array([[x[s] for s in SIDES] for x in (boxes if boxes is not None else ())], dtype=float).reshape(-1, 4)


def fragments(b: np.ndarray, text_like: np.ndarray, body: float, blanks: np.ndarray) -> np.ndarray:
    """A number for each region: text regions that continue each other on one line share the least of theirs.

    Continuing: level, lines of a usual height, with a narrow gap, or a wider one that an answer blank fills.
    """
    label = np.arange(len(b))
    while True:
        heads = np.flatnonzero(label == np.arange(len(b)))
        box = np.array([np.r_[b[label == h, :2].min(0), b[label == h, 2:].max(0)] for h in heads]).reshape(-1, 4)
        x0, y0, x1, y1 = (box[:, k] for k in range(4))
        pair = lambda f, v: f(v[:, None], v[None, :])
        low, level = pair(np.minimum, y1 - y0), pair(np.minimum, y1) - pair(np.maximum, y0)
        left, right = pair(np.minimum, x1), pair(np.maximum, x0)
        gap = right - left
        filled = np.zeros_like(gap, dtype=bool)
        for w in blanks:
            mid = (w[1] + w[3]) / 2
            filled |= (w[0] <= left + body) & (w[2] >= right - body) & (mid >= pair(np.maximum, y0) - body) & (mid <= pair(np.minimum, y1) + body)
        both = text_like[heads][:, None] & text_like[heads][None, :]
        on = both & (low <= LINE_HEIGHT * body) & (level >= LEVEL * low) & (gap < NEAR * body) & ((gap < BRIDGE * body) | filled)
        np.fill_diagonal(on, False)
        if not on.any():
            return label
        # each head joins the first that it continues, whole chains at once
        to = np.where(on.any(1), np.minimum(np.argmax(on, 1), np.arange(len(heads))), np.arange(len(heads)))
        while (to != to[to]).any():
            to = to[to]
        label = heads[to][np.searchsorted(heads, label)]


@arrow("array<int>")
def fragment_of(boxes: pd.Series, text_like: pd.Series, body: pd.Series, blanks: pd.Series) -> pd.Series:
    return pd.Series([fragments(_array(b), np.array(t if t is not None else (), dtype=bool), float(s), _array(w)).tolist() for b, t, s, w in zip(boxes, text_like, body, blanks)])


def union(boxes: Column) -> Column:
    """The box around an array of boxes."""
    edge = lambda f, s: f(F.transform(boxes, lambda x: x[s])).alias(s)
    return F.struct(edge(F.array_min, "x0"), edge(F.array_min, "y0"), edge(F.array_max, "x1"), edge(F.array_max, "y1"))


def grown(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"))


def _gathered(boxes: Column, fits) -> Column:
    """array<struct(box, of)>: boxes in order, each put to the first group that it fits; `of` are the places of a group's boxes."""
    kind = f"array<struct<box:{BOX},of:array<int>>>"
    plain = lambda b: F.struct(*[b[s].cast("double").alias(s) for s in SIDES])

    def step(s: Column, b: Column) -> Column:
        def put(at: Column) -> Column:
            alone = F.concat(s["groups"], F.array(F.struct(plain(b).alias("box"), F.array(s["n"]).alias("of"))))
            joined = F.transform(s["groups"], lambda g, i: F.when(i == at, F.struct(grown(g["box"], plain(b)).alias("box"), F.concat(g["of"], F.array(s["n"])).alias("of"))).otherwise(g))
            return F.struct(F.when(at < 0, alone).otherwise(joined).alias("groups"), (s["n"] + 1).alias("n"))

        hits = F.filter(F.transform(s["groups"], lambda g, i: F.when(fits(g["box"], b), i)), lambda i: i.isNotNull())
        return let(F.coalesce(F.get(hits, F.lit(0)), F.lit(-1)), put)

    return F.aggregate(boxes, F.struct(F.array().cast(kind).alias("groups"), F.lit(0).alias("n")), step, lambda s: s["groups"])


def near_lines(lines: Column) -> Column:
    """Groups of stray lines (x0, y0, x1, y1, size), from the top: a line close under or beside a group belongs to it."""

    def close(g: Column, x: Column) -> Column:
        beside = F.least(g["x1"], x["x1"]) - F.greatest(g["x0"], x["x0"]) > -CLOSE_BESIDE * x["size"]
        return (x["y0"] - g["y1"] <= CLOSE_BELOW * x["size"]) & (x["y1"] >= g["y0"]) & beside

    return _gathered(lines, close)


def artwork(boxes: Column, width: Column, height: Column) -> Column:
    """Boxes of drawn shapes that lie close, as figures; small, thin and page-wide ones aren't."""
    def near(g: Column, b: Column) -> Column:
        meets = lambda lo, hi: (b[lo] <= g[hi] + CLUSTER_SLACK) & (g[lo] <= b[hi] + CLUSTER_SLACK)
        return meets("x0", "x1") & meets("y0", "y1")

    shown = lambda b: (b["x1"] - b["x0"] >= LEAST_SIDE) & (b["y1"] - b["y0"] >= LEAST_SIDE) & (G.area(b) >= LEAST_PART * width * height) & (b["x1"] - b["x0"] <= MOST_WIDTH * width)
    return F.filter(F.transform(_gathered(boxes, near), lambda g: g["box"]), shown)


def placed(known: Column, strays: Column) -> Column:
    """Strays put among regions in order (arrays of structs with a box): after the last one above in their columns, else before
    the first one below, else last."""

    def step(seq: Column, o: Column) -> Column:
        above = F.transform(seq, lambda r, i: F.when((F.least(r["x1"], o["x1"]) > F.greatest(r["x0"], o["x0"])) & (r["y0"] <= o["y0"]), i + 1))
        below = F.transform(seq, lambda r, i: F.when(r["y0"] > o["y0"], i))
        at = F.coalesce(F.array_max(above), F.array_min(below), F.size(seq))
        return let(at, lambda k: F.concat(F.slice(seq, F.lit(1), k), F.array(o), F.slice(seq, k + 1, F.size(seq))))

    return F.aggregate(F.array_sort(strays, lambda a, b: F.when((a["y0"] < b["y0"]) | ((a["y0"] == b["y0"]) & (a["x0"] < b["x0"])), -1).otherwise(1)), known, step)


def clusters(shapes: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, x0, y0, x1, y1) of the figures that a page's drawn shapes make."""
    key = ["doc_id", "page_number"]
    s = shapes.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("shape_id", *SIDES))).alias("_s"))
    return s.join(pages.select(*key, "width", "height"), key).select(*key, F.explode(artwork(F.col("_s"), F.col("width"), F.col("height"))).alias("b")).select(*key, "b.*")
