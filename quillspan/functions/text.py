"""Text expressions: script, direction and language; markers; labels; cleaning.  All built-in, so they stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Code point ranges, thresholds, patterns and labels of the document model.
ARABIC = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{0870}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
RTL = ARABIC + r"\x{0590}-\x{05FF}\x{0700}-\x{074F}\x{0780}-\x{085F}\x{0860}-\x{086F}\x{FB1D}-\x{FB4F}"
RTL_SHARE, ARABIC_SHARE = 0.30, 0.40
BIDI_RTL, BIDI_LTR = 2, 3
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}]"
BULLETS = "•●○◦▪▫■□☐☑☒❑❒❏❐◆◇►▶➢➤→➔✓✔✗✘☆★\\-–—*"
MARKER = (
    rf"^(?:[{BULLETS}](?=\s|$)|\(?\d{{1,3}}(?:\.\d{{1,3}})*[.)]?(?=\s)|\d{{1,3}}(?=[A-Z][a-z]{{0,11}}:\s)"
    r"|\(?[a-hA-H][.)](?=\s)|\([ivx]{1,4}\)(?=\s)|[A-Z][a-z]{0,11}:(?=\s))"
)
DIALOGUE = r"^[A-Z][a-z]{0,11}:\s"
FOOTNOTE_START = r"^(?:\d{1,3}[.)]?\s|[*†‡¹²³]|\[\d{1,3}\])"
SPEAKER_AFTER_NUMBER = r"^\d{1,3}[.)]?\s+([A-Z][a-z]{0,11}:)\s"
CAPTION = r"(?i)^(figure|fig\.|table|chart|diagram|map|plate|photo)\s*[\dIVXivx]+[\w.\-]*\s*[:.\-–]?\s"
DOCX_CAPTION = r"(?i)^(figure|table|جدول|شكل)\s*[:\d]"
OPEN_ENDING = r"[\w,;\-\[\(–]$"
BLANK = "______"
JOB_ID = r"\A[A-Za-z0-9][A-Za-z0-9_-]{0,127}\z"
MAX_PRINTED = 8
REPLACEMENT = r"\x{FFFD}\x{25A0}\x{25AE}\x{25AF}\x{25FD}\x{25FE}"
UI_TYPES = {
    "title": "heading", "heading": "heading", "paragraph": "paragraph", "list": "list_item", "list_item": "list_item", "quote": "quote",
    "footnote": "footnote", "table": "table", "image": "figure", "figure": "figure", "caption": "caption", "page_marker": "page_marker", "aside": "aside",
}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, rf"{SPACE}+", " "))


def _left(c: Column, without: str) -> Column:
    """How many characters are left without runs of a class: one pass, and few matches where most characters go or stay together."""
    return F.length(F.regexp_replace(c, f"[{without}]++", ""))


def rtl_count(c: Column) -> Column:
    # the first range tells usual characters at once
    return F.length(F.regexp_replace(c, rf"[\x{{0}}-\x{{58F}}[^{RTL}]]++", ""))


def ltr_count(c: Column) -> Column:
    """Letters that aren't in a right-to-left range."""
    return F.length(c) - F.length(F.regexp_replace(c, rf"[a-zA-Z[\p{{L}}&&[^{RTL}]]]++", ""))


def script_counts(c: Column) -> Column:
    """struct(rtl, ltr, digit, other), each character counted once in that order."""
    t = F.coalesce(c, F.lit(""))
    rtl, ltr, digit = rtl_count(t), ltr_count(t), _left(t, rf"\P{{Nd}}{RTL}")
    return F.struct(rtl.alias("rtl"), ltr.alias("ltr"), digit.alias("digit"), (F.length(t) - rtl - ltr - digit).alias("other"))


def _share(counts: Column) -> Column:
    return counts["rtl"] / F.nullif(counts["rtl"] + counts["ltr"], F.lit(0))


def direction(counts: Column) -> Column:
    r, n = counts["rtl"], counts["rtl"] + counts["ltr"]
    return F.when((n > 0) & ((r >= counts["ltr"]) | (_share(counts) >= RTL_SHARE)), "rtl").otherwise("ltr")


def language(counts: Column) -> Column:
    r, n = counts["rtl"], counts["rtl"] + counts["ltr"]
    return F.when((n > 0) & ((r > counts["ltr"]) | (_share(counts) >= ARABIC_SHARE)), "ar").otherwise("en")


def is_bidi(counts: Column) -> Column:
    return (counts["rtl"] >= BIDI_RTL) & (counts["ltr"] >= BIDI_LTR)


def is_visual_arabic(c: Column) -> Column:
    """An Arabic word that seems written backwards: ends in the reversed article or starts with a final letter."""
    a = F.regexp_replace(c, f"[^{ARABIC}]", "")
    return (F.length(a) >= 3) & (a.endswith("لا") | a.startswith("ة"))


def list_marker(c: Column) -> Column:
    """The marker that text begins with, or null."""
    m = F.regexp_extract(c, MARKER, 0)
    return F.when(F.length(m) > 0, strip(m))


def is_dialogue(c: Column) -> Column:
    return c.rlike(DIALOGUE)


def starts_footnote(c: Column) -> Column:
    return c.rlike(FOOTNOTE_START)


def speaker_after_number(c: Column) -> Column:
    m = F.regexp_extract(c, SPEAKER_AFTER_NUMBER, 1)
    return F.when(F.length(m) > 0, m)


def is_caption(c: Column) -> Column:
    return c.rlike(CAPTION)


def split_marker(text: Column, marker: Column) -> Column:
    """struct(marker, rest): the marker split off where text starts with it."""
    t = F.coalesce(text, F.lit(""))
    has = (F.length(marker) > 0) & t.startswith(marker)
    return F.struct(F.when(has, marker).alias("marker"), F.when(has, F.regexp_replace(F.substring(t, F.length(marker) + 1, F.length(t)), rf"^{SPACE}+", "")).otherwise(t).alias("rest"))


def readable_title(stem: Column) -> Column:
    t = F.replace(F.regexp_replace(stem, r"\[[^\]]*\]", " "), F.lit("_"), F.lit(" "))
    t = F.btrim(F.regexp_replace(t, rf"{SPACE}+", " "), F.lit(" -"))
    return F.when(F.length(t) > 0, t).otherwise(stem)


def page_label(page: Column, printed: Column) -> Column:
    p = strip(F.coalesce(printed.cast("string"), F.lit("")))
    show = (F.length(p) > 0) & (p != page.cast("string")) & (F.length(p) <= MAX_PRINTED)
    return F.concat(F.lit("Original page "), page.cast("string"), F.when(show, F.concat(F.lit(" (printed "), p, F.lit(")"))).otherwise(""))


def caption_label(role: Column) -> Column:
    return F.when(role == "figure_text", "In the picture: ").when(role == "formula_text", "Formula: ")


def is_retained(asset_id: Column) -> Column:
    return F.coalesce(asset_id.endswith("_retained"), F.lit(False))


def reader_note(warnings: Column, asset_id: Column, block_type: Column, page: Column) -> Column:
    """The one note shown for a flagged block: its first warning, or one of two wordings for words hard to read."""
    first = F.get(warnings, 0)
    hard = first.startswith("Some words here were hard to read")
    cropped = asset_id.isNotNull() & ~block_type.isin("image", "table")
    return (
        F.when(is_retained(asset_id) | ~hard, first)
        .when(cropped, "Some words were hard to read, so the original lines are shown below.")
        .otherwise(F.concat(F.lit("Check against original page "), page.cast("string"), F.lit(": some words were hard to read.")))
    )


def ui_type(block_type: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in UI_TYPES.items() for x in kv]), block_type), F.lit("paragraph"))


def xml_clean(c: Column) -> Column:
    """Without characters that XML 1.0 doesn't allow."""
    return F.regexp_replace(c, r"[^\x09\x0A\x0D\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_text(c: Column) -> Column:
    """Escaped text with the blank token as a span that a screen reader can name."""
    return F.replace(html_escape(c), F.lit(BLANK), F.lit('<span class="blank" aria-label="blank">______</span>'))


def furniture_key(c: Column) -> Column:
    """Letters of running text alone: lower case, whatever else as one space."""
    return F.btrim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{Nl}\p{No}]+", " "))


def docx_block(style: Column, text: Column, numbered: Column) -> Column:
    """struct(type, level, text) of an office paragraph, by the first rule that holds.

    A style that contains "title" is level 1, and so is "subtitle": the later rule for it is never reached.
    """
    s = F.lower(F.coalesce(style, F.lit("")))
    level = F.regexp_extract(s, r"heading\s*(\d+)", 1)
    bullet = s.contains("list") | F.coalesce(numbered, F.lit(False)) | text.rlike(r"^[•\-*]")
    bare = F.regexp_replace(text, r"^[•\-* \t]+", "")
    kind = (
        F.when(level != "", "heading").when(s.contains("title"), "heading").when(bullet, "list").when(s.contains("quote"), "quote")
        .when(s.contains("caption") | text.rlike(DOCX_CAPTION), "caption").when(s.contains("footnote"), "footnote").otherwise("paragraph")
    )
    depth = F.when(level != "", F.least(F.lit(6), F.greatest(F.lit(1), level.cast("int")))).when(s.contains("title"), 1)
    return F.struct(kind.alias("type"), depth.cast("int").alias("level"), F.when((kind == "list") & (F.length(bare) > 0), bare).otherwise(text).alias("text"))


def pptx_block(level: Column, text: Column) -> Column:
    is_list = (F.coalesce(level, F.lit(0)) > 0) | text.rlike(r"^[•\-*]")
    bare = F.regexp_replace(text, r"^[•\-* \t]+", "")
    return F.struct(F.when(is_list, "list").otherwise("paragraph").alias("type"), F.when(is_list & (F.length(bare) > 0), bare).otherwise(text).alias("text"))


def styled_segments(text: Column, styles: Column, offset: int = 0) -> Column:
    """array<struct(text, tags)>: text cut at the edges of its emphasis spans, each piece with the tags that cover it."""
    n = F.length(text)
    edges = F.flatten(F.transform(F.coalesce(styles, F.array().cast("array<struct<start:int,end:int,bold:boolean,italic:boolean,underline:boolean>>")), lambda s: F.array(s["start"] - offset, s["end"] - offset)))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), n), F.filter(edges, lambda e: (e > 0) & (e < n)))))
    tag = lambda a, b, flag, t: F.when(F.exists(styles, lambda s: s[flag] & (s["start"] - offset <= a) & (b <= s["end"] - offset)), t)
    pieces = F.zip_with(F.slice(cuts, 1, F.size(cuts) - 1), F.slice(cuts, 2, F.size(cuts)), lambda a, b: F.struct(
        F.substr(text, a + 1, b - a).alias("text"), F.array_compact(F.array(tag(a, b, "bold", "b"), tag(a, b, "italic", "i"), tag(a, b, "underline", "u"))).alias("tags")))
    return F.when(F.coalesce(F.size(styles), F.lit(0)) > 0, pieces).otherwise(F.array(F.struct(text.alias("text"), F.array().cast("array<string>").alias("tags"))))


def error_code(kind: Column, message: Column) -> Column:
    """Stable code of a failure by its message and type."""
    return (
        F.when(message.contains("File format not recognized"), "UNSUPPORTED_FORMAT").when(message.contains("File exceeds maximum allowed size"), "FILE_TOO_LARGE")
        .when(kind.contains("FileNotFoundError"), "FILE_NOT_FOUND").when(kind.contains("PermissionError"), "PERMISSION_DENIED").when(kind.contains("TimeoutError"), "TIMEOUT")
        .when(kind.isin("ValueError", "UnicodeDecodeError", "UnicodeEncodeError", "JSONDecodeError", "ValidationError"), "INVALID_INPUT").otherwise("CONVERSION_ERROR")
    )


def progress_percent(stage: Column, current: Column, total: Column) -> Column:
    return F.bround(F.when(stage == "exporting", F.lit(95.0)).otherwise(F.least(F.lit(90.0), current / F.greatest(F.lit(1), total) * 90)), 1)


def log_text(message: Column) -> Column:
    """Messages beyond 500 characters are cut to 200 for the log."""
    return F.when(F.length(message) > 500, F.concat(F.substring(message, 1, 200), F.lit("..."))).otherwise(message)


def is_job_id(c: Column) -> Column:
    return F.coalesce(c.rlike(JOB_ID), F.lit(False))


def apply_edit(edit: Column, block_type: Column, text: Column) -> Column:
    """The edited text where there is one; edits to pictures, tables and markers or beyond a million characters fail."""
    bad = edit.isNotNull() & (block_type.isin("image", "table", "page_marker") | (F.length(edit) > 1_000_000))
    return F.when(bad, F.raise_error(F.lit("this block's text can't be edited")).cast("string")).otherwise(F.coalesce(edit, text))
