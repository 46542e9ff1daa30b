"""Boxes, sizes and bounds as column expressions.  Boxes are structs (x0, y0, x1, y1) with y downwards unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
MAX_PIXELS, MAX_SIDE = 16_000_000, 9999
IMAGE_SIDE, IMAGE_PIXELS = 10_000, 50_000_000
SOURCE_BODY, PICTURE_DPI, ENLARGE_CAP, LEAST_FRAME, FULL_HEIGHT = 10.5, 150.0, 2.2, 0.35, 0.86
PRESETS = {"Comfortable": (18.0, 1.4), "Large": (20.0, 1.5), "Extra Large": (24.0, 1.5), "Very Large": (28.0, 1.55)}
CROP_MARGIN, LEAST_CROP, GRID = 4.0, 8, 8.0
BODY_RANGE, SPACING_RANGE = (12.0, 72.0), (1.0, 3.0)


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def overlap(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def coverage(inner: Column, outer: Column) -> Column:
    """Share of the inner box that lies in the outer one."""
    return F.when(area(inner) > 0, overlap(inner, outer) / area(inner)).otherwise(0.0)


def union(b: Column) -> Column:
    """Aggregate: the box around all boxes of a group."""
    return F.struct(F.min(b["x0"]).alias("x0"), F.min(b["y0"]).alias("y0"), F.max(b["x1"]).alias("x1"), F.max(b["y1"]).alias("y1"))


def flipped(b: Column, page_height: Column) -> Column:
    """From page space (y down) to document points (y up)."""
    return F.struct(b["x0"].alias("x0"), (page_height - b["y1"]).alias("y0"), b["x1"].alias("x1"), (page_height - b["y0"]).alias("y1"), F.lit("pdf_points").alias("coord_system"))


def render_scale(width: Column, height: Column, dpi: Column) -> Column:
    """Scale that keeps a rendered page within its pixel bounds; impossible sizes fail."""
    ok = (width > 0) & (height > 0) & ~F.isnan(width) & ~F.isnan(height) & (width < float("inf")) & (height < float("inf")) & (dpi > 0)
    s = F.least(dpi / 72, MAX_SIDE / width, MAX_SIDE / height, 0.99 * F.sqrt(MAX_PIXELS / (width * height)))
    return F.when(ok, s).otherwise(F.raise_error(F.lit("page size out of bounds")).cast("double"))


def image_within_bounds(width: Column, height: Column) -> Column:
    return (width > 0) & (height > 0) & (width <= IMAGE_SIDE) & (height <= IMAGE_SIDE) & (width.cast("long") * height <= IMAGE_PIXELS)


def picture_size(width: Column, height: Column, source_width: Column, frame_width: float, frame_height: float, body: float, retained: Column) -> Column:
    """struct(width, height) of a picture on the page: enlarged like the text, aspect kept."""
    aspect = height / F.greatest(F.lit(1.0), width)
    own = width * 72.0 / PICTURE_DPI
    source = F.coalesce(source_width, own)
    w = F.least(source * max(1.0, body / SOURCE_BODY), own * ENLARGE_CAP)
    w = F.least(F.greatest(w, F.least(F.lit(frame_width * LEAST_FRAME), source)), F.lit(frame_width))
    w = F.when(retained, frame_width).otherwise(w)
    tall = w * aspect > frame_height * FULL_HEIGHT
    limit = F.lit(frame_height * FULL_HEIGHT)
    return F.struct(F.when(tall, limit / aspect).otherwise(w).alias("width"), F.when(tall, limit).otherwise(w * aspect).alias("height"))


def indent_level(x0: Column, base: Column, size: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(4), F.ceil((x0 - base) / F.greatest(F.lit(1.0), 1.4 * size) - 0.35))).cast("int")


def crop_box(b: Column, page_height: Column, scale: Column, width: Column, height: Column) -> Column:
    """struct(left, top, right, bottom) in pixels of the lines behind a doubtful block (y up) with a margin, cut to the picture; null where too little is left."""
    whole = lambda v: v.cast("int")
    left, top = F.greatest(F.lit(0), whole((b["x0"] - CROP_MARGIN) * scale)), F.greatest(F.lit(0), whole((page_height - b["y1"] - CROP_MARGIN) * scale))
    right, bottom = F.least(width, whole((b["x1"] + CROP_MARGIN) * scale)), F.least(height, whole((page_height - b["y0"] + CROP_MARGIN) * scale))
    return F.when((right - left >= LEAST_CROP) & (bottom - top >= LEAST_CROP), F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom")))


def upright(b: Column, width: Column, height: Column, quarter: Column) -> Column:
    """A box in document points (y up) as it lies on its page (y down) after clockwise quarter turns, on a grid of eighths of a point."""
    grid = lambda v: F.bround(v * GRID) / GRID
    x, y = lambda k: b[f"x{k}"], lambda k: b[f"y{k}"]
    turn = lambda none, once, twice, thrice: F.when(quarter == 1, once).when(quarter == 2, twice).when(quarter == 3, thrice).otherwise(none)
    ends = lambda k: (grid(turn(x(k), y(k), width - x(k), height - y(k))), grid(turn(height - y(k), x(k), y(k), width - x(k))))
    (ax, ay), (bx, by) = ends(0), ends(1)
    return F.struct(F.least(ax, bx).alias("x0"), F.least(ay, by).alias("y0"), F.greatest(ax, bx).alias("x1"), F.greatest(ay, by).alias("y1"))


def figure_dpi(pixel_width: Column, points: Column) -> Column:
    return F.least(F.lit(300.0), F.greatest(F.lit(150.0), pixel_width / (points / 72)))


def preset(name: Column, body: Column, spacing: Column) -> Column:
    """struct(body, spacing) of an export preset; custom values are checked, and default to those of Large."""
    m = lambda k: F.element_at(F.create_map(*[F.lit(x) for n, v in PRESETS.items() for x in (n, v[k])]), name)
    custom = name == "Custom"
    bad = (~body.between(*BODY_RANGE) | F.isnan(body)) | (~spacing.between(*SPACING_RANGE) | F.isnan(spacing))
    value = lambda k, own: F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("text size or spacing out of range")).cast("double")).when(custom, F.coalesce(own, F.lit(PRESETS["Large"][k]))).otherwise(m(k))
    return F.struct(value(0, body).alias("body"), value(1, spacing).alias("spacing"))
