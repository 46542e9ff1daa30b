"""Table expressions over array<array<struct(text, row_span, col_span, is_header)>>, and widths over exploded cells."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

from . import arrow
from .text import SPACE, strip

# Fixed values.
CHAR_WIDTH, PADDING, LEAST_COLUMN, LINE_CAP = 0.55, 16.0, 60.0, 20
WRAP_WIDTH, WRAP_PADDING, WRAP_LEAST, WRAP_COLUMN = 0.56, 14.0, 2.2, 4.5
READABLE, SPLIT_TOLERANCE, SPLIT_DATA, SPLIT_LEAST = 14.0, 1.15, 2, 4
EMPTY = "array<array<struct<text:string,row_span:int,col_span:int,is_header:boolean>>>"


def flat(text: Column) -> Column:
    """A cell's text on one line."""
    return strip(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")))


def column_count(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))


def _line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def markdown(rows: Column, caption: Column) -> Column:
    head = F.transform(F.get(rows, 0), lambda c: flat(c["text"]))
    n = F.size(head)
    fit = lambda r: F.slice(F.concat(F.transform(r, lambda c: flat(c["text"])), F.array_repeat(F.lit(""), n)), 1, n)
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.when(n > 0, _line(fit(r))).otherwise("|  |"))
    title = F.when(F.length(caption) > 0, F.array(F.concat(F.lit("**"), caption, F.lit("**\n")))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(title, F.array(_line(head), _line(F.array_repeat(F.lit("---"), n))), body), "\n")).otherwise("")


def linearized(rows: Column, has_header: Column, caption: Column) -> Column:
    names = F.when(has_header, F.transform(F.get(rows, 0), lambda c: flat(c["text"]))).otherwise(F.array().cast("array<string>"))
    body = F.when(has_header, F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(rows)
    cell = lambda c, i: F.concat(F.lit("   - "), F.coalesce(F.get(names, i), F.concat(F.lit("Column "), (i + 1).cast("string"))), F.lit(": "), flat(c["text"]))
    lines = F.transform(body, lambda r, i: F.array_join(F.concat(F.array(F.concat(F.lit("• Row "), (i + 1).cast("string"), F.lit(":"))), F.transform(r, cell)), "\n"))
    top = F.when(F.length(caption) > 0, F.concat(F.lit("[Table: "), caption, F.lit("]"))).otherwise("[Table]")
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(top), lines), "\n")).otherwise("")


def entries(rows: Column, has_header: Column) -> Column:
    """array<struct(lead, details array<struct(label, value)>)>: rows read one by one, without empty rows and details."""
    names = F.when(has_header, F.transform(F.get(rows, 0), lambda c: strip(c["text"])))
    body = F.when(has_header, F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(rows)
    texts = F.filter(F.transform(body, lambda r: F.transform(r, lambda c: strip(c["text"]))), lambda r: F.exists(r, lambda t: t != ""))
    detail = lambda r: F.filter(F.transform(r, lambda v, i: F.struct(F.nullif(F.get(names, i), F.lit("")).alias("label"), v.alias("value"), i.alias("i"))), lambda d: (d["i"] > 0) & (d["value"] != ""))
    return F.transform(texts, lambda r: F.struct(F.get(r, 0).alias("lead"), F.transform(detail(r), lambda d: F.struct(d["label"], d["value"])).alias("details")))


def _longest(parts: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(parts, F.length)), F.lit(0))


def _cells(rows: Column, c: Column) -> Column:
    return F.filter(F.transform(rows, lambda r: F.when(F.size(r) > c, strip(F.coalesce(F.get(r, c)["text"], F.lit(""))))), lambda t: t.isNotNull())


def _columns(rows: Column) -> Column:
    n = column_count(rows)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def measures(rows: Column) -> Column:
    """For each column: its longest line, its longest word and the characters of all its cells."""
    words = lambda t: F.filter(F.split(t, rf"{SPACE}+"), lambda w: w != "")
    return F.transform(_columns(rows), lambda c: F.struct(
        F.coalesce(F.array_max(F.transform(_cells(rows, c), lambda t: _longest(F.split(t, "\n")))), F.lit(0)).alias("line"),
        F.coalesce(F.array_max(F.transform(_cells(rows, c), lambda t: _longest(words(t)))), F.lit(0)).alias("word"),
        F.aggregate(_cells(rows, c), F.lit(0), lambda a, t: a + F.length(t)).alias("volume")))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def estimated_widths(m: Column, points: Column) -> Column:
    w = points * CHAR_WIDTH
    return F.transform(m, lambda c: F.bround(F.greatest(F.lit(LEAST_COLUMN), c["word"] * w + PADDING, F.least(c["line"], F.lit(LINE_CAP)) * w + PADDING), 2))


def wrapped_widths(m: Column, points: Column, available: Column) -> Column:
    """Widths at which all cells can wrap, spare room shared by the root of the columns' volume; null where words don't fit."""
    least = F.transform(m, lambda c: F.greatest(c["word"] * points * WRAP_WIDTH, points * WRAP_LEAST) + WRAP_PADDING)
    weight = F.transform(m, lambda c: F.sqrt(F.greatest(F.lit(1), c["volume"]).cast("double")))
    fits = (F.size(m) > 0) & (_total(least) <= available) & (available / F.size(m) >= points * WRAP_COLUMN)
    spare = available - _total(least)
    return F.when(fits, F.zip_with(least, weight, lambda a, b: F.bround(a + spare * b / _total(weight), 2)))


def part_columns(columns: Column, data: int = SPLIT_DATA) -> Column:
    """For each part of a split table its columns: the first, and the next `data` ones."""
    n = F.ceil((columns - 1) / data).cast("int")
    part = lambda k: F.concat(F.array(F.lit(0)), F.sequence(k * data + 1, F.least(k * data + data, columns - 1)))
    return F.when(columns <= data + 1, F.array(F.sequence(F.lit(0), columns - 1))).otherwise(F.transform(F.sequence(F.lit(0), n - 1), part))


def split_parts(rows: Column, caption: Column, data: int = SPLIT_DATA) -> Column:
    """array<struct(rows, caption)>: parts of at most `data` columns beside the first; short rows are filled up."""
    parts = part_columns(column_count(rows), data)
    blank = F.struct(F.lit("").alias("text"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.lit(False).alias("is_header"))
    title = F.when(F.length(caption) > 0, caption).otherwise("Table")
    made = F.transform(parts, lambda cols, k: F.struct(
        F.transform(rows, lambda r: F.transform(cols, lambda c: F.coalesce(F.get(r, c), blank))).alias("rows"),
        F.concat(title, F.lit(" (Part "), (k + 1).cast("string"), F.lit(" of "), F.size(parts).cast("string"), F.lit(")")).alias("caption")))
    return F.when(F.size(parts) > 1, made).otherwise(F.array(F.struct(rows.alias("rows"), caption.alias("caption"))))


def fit(rows: Column, m: Column, available: Column, points: Column) -> Column:
    """struct(tier, widths, total, warned) by the first of: wrap, wrap small, merged cells kept, full, scaled, split, listed."""
    readable = F.lit(READABLE)
    wrap = F.coalesce(wrapped_widths(m, points, available), wrapped_widths(m, readable, available))
    est, low = estimated_widths(m, points), estimated_widths(m, readable)
    total, low_total = _total(est), _total(low)
    merged = F.exists(rows, lambda r: F.exists(r, lambda c: (c["row_span"] > 1) | (c["col_span"] > 1)))
    shrunk = F.transform(est, lambda w: w * F.least(F.lit(1.0), available / F.greatest(F.lit(1.0), total)))
    scale = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (available - low_total) / F.greatest(F.lit(1.0), total - low_total)))
    scaled = F.zip_with(est, low, lambda w, b: F.bround(b + (w - b) * scale, 2))
    part_ok = F.forall(part_columns(F.size(m)), lambda cols: _total(F.transform(cols, lambda c: F.get(low, c))) <= available * SPLIT_TOLERANCE)
    tier = (
        F.when(F.size(rows) == 0, "enlarged").when(wrap.isNotNull(), "enlarged").when(merged, "enlarged").when(total <= available, "enlarged")
        .when(low_total <= available, "enlarged").when((F.size(m) >= SPLIT_LEAST) & part_ok, "split").otherwise("linearize")
    )
    widths = F.when(F.size(rows) == 0, F.array().cast("array<double>")).when(wrap.isNotNull(), wrap).when(merged, shrunk).when(total <= available, est).when(low_total <= available, scaled).otherwise(low)
    return F.struct(tier.alias("tier"), widths.alias("widths"), _total(widths).alias("total"), (tier != "enlarged").alias("warned"))


@arrow("array<boolean>")
def _seen(sizes: pd.Series, down: pd.Series, across: pd.Series) -> pd.Series:
    """Which cells of a grid, in order, no visible one before covers: for each column the row up to which it is covered."""
    def of(sizes, down, across) -> list[bool]:
        n, m = len(sizes), int(max(sizes, default=0))
        spans = zip(pd.Series(down).fillna(n).tolist(), pd.Series(across).fillna(m).tolist())
        until = [0] * m
        out = []
        for r, size in enumerate(sizes):
            for c in range(int(size)):
                rows, columns = next(spans)
                out.append(until[c] <= r)
                if out[-1]:
                    for k in range(c, c + max(1, min(int(columns), m - c))):
                        until[k] = max(until[k], r + max(1, min(int(rows), n - r)))
        return out

    return pd.Series([of(*x) if x[1] is not None else None for x in zip(sizes, down, across)])


def visible_cells(rows: Column) -> Column:
    """array<struct(r, c, text, rs, cs)>: cells that no earlier visible cell's span covers, spans cut at the grid's edge.

    The cells are gone through in order, so that a covered cell's own span covers nothing.
    """
    cut = lambda s: F.flatten(F.transform(rows, lambda row, r: F.transform(row, lambda c, k: F.struct(
        r.alias("r"), k.alias("c"), c["text"].alias("text"),
        F.greatest(F.lit(1), F.least(c["row_span"], s["n"] - r)).alias("rs"), F.greatest(F.lit(1), F.least(c["col_span"], s["m"] - k)).alias("cs")))))
    cells = F.get(F.transform(F.array(F.struct(F.size(rows).alias("n"), column_count(rows).alias("m"))), cut), F.lit(0))
    seen = _seen(F.transform(rows, F.size), F.flatten(rows)["row_span"], F.flatten(rows)["col_span"])
    return F.transform(F.filter(F.arrays_zip(cells.alias("cell"), seen.alias("seen")), lambda x: x["seen"]), lambda x: x["cell"])


def structure_score(ref: Column, hyp: Column) -> Column:
    """Agreement of two grids of strings: rows 0.3, columns 0.3, equal cells 0.4."""
    wide = lambda g: F.coalesce(F.array_max(F.transform(g, F.size)), F.lit(0))
    cells = lambda g: F.aggregate(g, F.lit(0), lambda a, r: a + F.size(r))
    near = lambda a, b: F.greatest(F.lit(0.0), 1 - F.abs(a - b) / F.greatest(F.lit(1), a))
    pair = F.zip_with(ref, hyp, lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda x, y: strip(x) == strip(y)), lambda q: q)))
    hit = F.aggregate(pair, F.lit(0), lambda a, x: a + F.greatest(F.coalesce(x, F.lit(0)), F.lit(0)))
    most = F.greatest(cells(ref), cells(hyp))
    score = 0.3 * near(F.size(ref), F.size(hyp)) + 0.3 * near(wide(ref), wide(hyp)) + 0.4 * F.when(most > 0, hit / most).otherwise(0.0)
    return F.when((F.size(ref) == 0) & (F.size(hyp) == 0), 1.0).when((F.size(ref) == 0) | (F.size(hyp) == 0), 0.0).otherwise(F.bround(score, 3))


def quality(rows: Column, has_header: Column) -> Column:
    n = column_count(rows)
    cells = F.flatten(rows)
    # the widest row is looked for once, not for each row
    even = F.get(F.transform(F.array(F.greatest(n, F.lit(1))), lambda n: F.size(F.filter(rows, lambda r: F.size(r) == n))), F.lit(0)) / F.size(rows)
    full = F.when(F.size(cells) > 0, F.size(F.filter(cells, lambda c: strip(F.coalesce(c["text"], F.lit(""))) != "")) / F.size(cells)).otherwise(0.0)
    return F.when(F.size(rows) > 0, F.bround(0.4 * even + 0.4 * full + 0.2 * F.when(has_header, 1.0).otherwise(0.5), 3)).otherwise(0.0)
