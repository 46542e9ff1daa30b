"""Pages: selection and slicing, validation, classification, furniture, headings, labels."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X

# Fixed values.
BROKEN_PRINTABLE, BROKEN_REPLACED, RASTER_MIXED = 0.70, 0.15, 0.60
NATIVE_CHARS, NATIVE_RASTER = 40, 0.5
FEW_PAGES, FEW_REPEATS, MANY_REPEATS = 6, 2, 3
BODY_DEFAULT, LEVEL_1, LEVEL_2 = 11.0, 1.7, 1.2
ARABIC_NAME, ARABIC_SAMPLE, SAMPLE_BLOCKS = 3, 20, 6


def page_selection(spec, total: int) -> set[int] | None:
    """Pages of "1-5, 8", "3-", "-2", a tuple (first, last), or a list or set of numbers; None or blank means all."""
    if spec is None or isinstance(spec, str) and not spec.strip():
        return None
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
    if not whole(total) or total < 1:
        raise ValueError("there are no pages to select")
    spans: list[tuple[int, int]] = []
    if isinstance(spec, str):
        for part in spec.split(","):
            ends = re.fullmatch(r"\s*(\d*)\s*(-?)\s*(\d*)\s*", part, re.ASCII)
            first, dash, last = ends.groups() if ends else ("", "", "")
            if not (first or last) or (not dash and last):
                raise ValueError(f"not a page selection: {part!r}")
            spans.append((int(first or 1), int(last or total) if dash else int(first)))
    elif isinstance(spec, tuple) and len(spec) == 2 and all(map(whole, spec)):
        spans = [spec]
    elif isinstance(spec, (list, set, frozenset)) and spec and all(map(whole, spec)):
        spans = [(p, p) for p in spec]
    else:
        raise ValueError(f"not a page selection: {spec!r}")
    if any(not 1 <= a <= b <= total for a, b in spans):
        raise ValueError(f"pages must lie between 1 and {total}")
    return {p for a, b in spans for p in range(a, b + 1)}


def select_pages(df: DataFrame, pages: set[int] | None, column: str = "source_page") -> DataFrame:
    """Rows of the selected pages: a filter that reaches the scan."""
    return df if pages is None else df.filter(F.col(column).isin(sorted(pages)))


def slice_range(first: int, last: int, blocks: DataFrame, pages: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks, pages and documents of a run of pages, with the run in the title and the new page count."""
    if first < 1 or last < first:
        raise ValueError(f"invalid page range {first} to {last}")
    suffix = f" (Page {first})" if first == last else f" (Pages {first}–{last})"
    return _slice(lambda c: F.col(c).between(first, last), suffix, last - first + 1, blocks, pages, documents)


def slice_set(chosen: set[int], blocks: DataFrame, pages: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    if not chosen or min(chosen) < 1:
        raise ValueError("invalid page selection")
    suffix = f" ({'page' if len(chosen) == 1 else 'pages'} {runs_label(chosen)})"
    return _slice(lambda c: F.col(c).isin(sorted(chosen)), suffix, len(chosen), blocks, pages, documents)


def runs_label(chosen) -> str:
    """1–3, 5 of {1, 2, 3, 5}."""
    runs: list[list[int]] = []
    for p in sorted(chosen):
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return ", ".join(str(a) if a == b else f"{a}–{b}" for a, b in runs)


def _slice(keep, suffix: str, length: int, blocks, pages, documents):
    p, b = pages.filter(keep("page_number")), blocks.filter(keep("source_page"))
    n = p.groupBy("doc_id").agg(F.count("*").cast("int").alias("_n"))
    title = F.concat(F.coalesce(F.when(F.col("title") != "", F.col("title")), F.lit("Document")), F.lit(suffix))
    d = documents.join(n, "doc_id", "left").withColumn("title", title).withColumn("page_count", F.coalesce("_n", F.lit(length))).drop("_n")
    return b, p, d


def label_runs(df: DataFrame, keys: list[str], page: str) -> DataFrame:
    """Per group the collapsed runs of its pages as text: gaps and islands by page minus row number."""
    w = Window.partitionBy(*keys).orderBy(page)
    runs = df.select(*keys, page).distinct().withColumn("island", F.col(page) - F.row_number().over(w)).groupBy(*keys, "island").agg(F.min(page).alias("a"), F.max(page).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit("–"), F.col("b").cast("string")))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))), lambda x: x["t"]), ", ").alias("label"))


def first_violation(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, problem): of each document the first block in order that breaks a rule, and which."""
    problem = (
        F.when(F.col("source_page") < 1, "source_page").when((F.col("type") == "image") & F.col("image_asset").isNull(), "image_asset")
        .when((F.col("type") == "table") & F.col("table_structure").isNull(), "table_structure").when((F.col("type") == "page_marker") & F.col("page_marker").isNull(), "page_marker")
    )
    b = blocks.withColumn("problem", problem).filter(F.col("problem").isNotNull())
    return b.groupBy("doc_id").agg(F.min_by(F.struct(F.col("id").alias("block_id"), "problem"), "ord").alias("x")).select("doc_id", "x.*")


def document_warnings(documents: DataFrame, pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, fatal, mismatch, no_blocks): negative counts, counts that differ from the pages, native pages without blocks."""
    p = pages.groupBy("doc_id").agg(F.count("*").alias("n"), F.max((F.col("classification") == "native").cast("int")).alias("native"))
    b = blocks.groupBy("doc_id").agg(F.count("*").alias("k"))
    d = documents.join(p, "doc_id", "left").join(b, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return d.select("doc_id", (F.col("page_count") < 0).alias("fatal"), (zero("n") != F.col("page_count")).alias("mismatch"), ((zero("native") > 0) & (zero("k") == 0)).alias("no_blocks"))


def classify(text: Column, raster: Column, objects: Column) -> Column:
    """struct(classification, is_broken, is_blank) of a page by its text layer and how much of it pictures cover.

    Printable is taken as: no control, format, surrogate, private or unassigned character and no separator but the space.
    """
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    # counted by what is left without all others: a page that has none is one match, whose usual characters are told by the first range
    gone = lambda of: F.length(F.regexp_replace(t, rf"[ -~\t\n\r[^{of}]]++", ""))
    replaced = gone(rf"{X.REPLACEMENT}\x{{E000}}-\x{{F8FF}}\x{{0}}-\x{{8}}\x{{B}}\x{{C}}\x{{E}}-\x{{1F}}")
    hidden = gone(rf"{X.REPLACEMENT}\x{{0}}-\x{{8}}\x{{B}}\x{{C}}\x{{E}}-\x{{1F}}\x{{7F}}-\x{{A0}}\x{{AD}}\p{{Cf}}\p{{Co}}\p{{Cn}}\p{{Zl}}\p{{Zp}}\p{{Zs}}")
    broken = (n > 0) & (((n - hidden) / F.nullif(n, F.lit(0)) < BROKEN_PRINTABLE) | (replaced / F.nullif(n, F.lit(0)) > BROKEN_REPLACED))
    broken = F.coalesce(broken, F.lit(False))
    kind = F.when(broken, "broken_digital").when(~t.rlike(f"[^{X.SPACE[1:]}"), "scanned").when(F.least(F.lit(1.0), raster) > RASTER_MIXED, "mixed").otherwise("native")
    return F.struct(kind.alias("classification"), broken.alias("is_broken"), ((n == 0) & (objects == 0)).alias("is_blank"))


def route(visible: Column, broken: Column, raster: Column) -> Column:
    """The classification that extraction acts on."""
    bad = broken > BROKEN_REPLACED * visible
    enough = F.when(raster > NATIVE_RASTER, visible >= NATIVE_CHARS).otherwise(visible >= 1)
    return F.when(bad, "broken_digital").when(~enough, "scanned").when(raster > RASTER_MIXED, "mixed").otherwise("native")


def histogram(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id", F.coalesce("classification", F.lit("scanned")).alias("classification")).agg(F.count("*").alias("n_pages"))


def language_hint(stem: Column, sample: Column) -> Column:
    n = F.regexp_count(F.concat_ws(" ", stem, sample), F.lit(f"[{X.ARABIC}]"))
    return F.when((n >= ARABIC_NAME) | F.lower(stem).contains("arabic"), "ar").otherwise("en")


def running_hint(blocks: DataFrame, start: str = "en") -> DataFrame:
    """(doc_id, source_page, hint): Arabic from the page on after one whose first blocks hold more than 20 Arabic characters."""
    w = Window.partitionBy("doc_id", "source_page").orderBy("ord")
    sample = blocks.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= SAMPLE_BLOCKS)
    page = sample.groupBy("doc_id", "source_page").agg(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(f"[{X.ARABIC}]"))).alias("n"))
    before = Window.partitionBy("doc_id").orderBy("source_page").rowsBetween(Window.unboundedPreceding, -1)
    return page.select("doc_id", "source_page", F.when(F.max("n").over(before) > ARABIC_SAMPLE, "ar").otherwise(start).alias("hint"))


def settle_furniture(blocks: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept blocks, page details): repeated running text, page numbers and edge slivers move to their pages.

    Running text repeats when its letters alone occur on enough distinct pages of the document; what doesn't stays as a
    page note.  One aggregation by (document, key) and one by page, joined back.
    """
    size = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    b = blocks.join(size, "doc_id", "left").withColumn("key", F.when((F.col("role") == "running_text") & (F.col("text") != ""), X.furniture_key(F.col("text"))))
    pages_of = b.filter(F.col("key") != "").select("doc_id", "key", "source_page").distinct()
    # only keys on enough pages matter below
    repeats = pages_of.groupBy("doc_id", "key").agg(F.count("*").alias("repeats")).filter(F.col("repeats") >= min(FEW_REPEATS, MANY_REPEATS))
    b = b.join(repeats, ["doc_id", "key"], "left")
    limit = F.when(F.coalesce("n_pages", F.lit(0)) <= FEW_PAGES, FEW_REPEATS).otherwise(MANY_REPEATS)
    furniture = F.col("key").isNotNull() & ((F.col("key") == "") | (F.coalesce("repeats", F.lit(0)) >= limit))
    number = (F.col("role") == "page_number") & (F.col("text") != "")
    edge = F.col("role") == "edge_text"
    moved = F.coalesce(furniture | number | edge, F.lit(False))
    kept = b.filter(~moved).withColumn("role", F.when(F.col("key").isNotNull(), "page_note").otherwise(F.col("role"))).select(*blocks.columns)
    texts = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("ord", F.coalesce("text", F.lit("")).alias("t"))))), lambda x: x["t"])
    details = b.filter(moved).groupBy("doc_id", F.col("source_page").alias("page_number")).agg(
        F.min_by(F.when(number, F.col("text")), F.when(number, F.col("ord"))).alias("printed_page"), texts(furniture).alias("running_text"), texts(edge).alias("edge_text"))
    return kept, pages.select("doc_id", "page_number").join(details, ["doc_id", "page_number"])


def body_size(words: DataFrame) -> DataFrame:
    return words.groupBy("doc_id").agg(F.coalesce(F.median(F.when(~F.coalesce("blank", F.lit(False)), F.col("size"))), F.lit(BODY_DEFAULT)).alias("body"))


def heading_levels(blocks: DataFrame, sizes: DataFrame, body: DataFrame) -> DataFrame:
    """blocks with level by type size against the document's body size; blocks without a recorded size keep theirs."""
    b = blocks.join(sizes.select("doc_id", "id", F.col("size").alias("_s")), ["doc_id", "id"], "left").join(body.select("doc_id", F.col("body").alias("_b")), "doc_id", "left")
    base = F.coalesce("_b", F.lit(BODY_DEFAULT))
    level = F.when((F.col("role") == "title") | (F.col("_s") >= LEVEL_1 * base), 1).when(F.col("_s") >= LEVEL_2 * base, 2).otherwise(3)
    return b.withColumn("level", F.when(F.col("_s").isNotNull(), level).otherwise(F.col("level"))).select(*blocks.columns)


def page_labels(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Markers with the label of their page, the printed number beside the real one where they differ."""
    m = blocks.filter(F.col("page_marker").isNotNull())
    p = pages.select("doc_id", F.col("page_number").alias("page_marker"), "printed_page")
    return m.join(p, ["doc_id", "page_marker"], "left").withColumn("label", X.page_label(F.col("page_marker"), F.col("printed_page")))
