"""Large-print office documents from blocks: the XML by expressions, only the packing into an archive by an Arrow function.

Tables are shown as they fit the page: as one table with the widths its words ask for, in parts of some columns, or row by row as a list.
Pictures come from a table of their own and are packed beside the text.

Edge cases: a picture block without its picture shows its text; a table without rows is an empty paragraph; a document without blocks makes no file; a
body size, spacing or paper out of range is refused.
"""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrow_rows, geometry as G, tables as B, text as X

# Paper in twentieths of a point with its margin, type sizes of headings in parts of the body's, style names.
PAPERS = {"A4": (11906, 16838, 1020), "A3": (16838, 23811, 1247)}
HEADINGS = {1: 1.6, 2: 1.35, 3: 1.2, 4: 1.1, 5: 1.0, 6: 1.0}
STYLES = {"list": ("ListParagraph", "List Paragraph"), "quote": ("Quote", "Quote"), "caption": ("Caption", "Caption"), "footnote": ("FootnoteText", "footnote text"), "page_marker": ("PageMarker", "Page Marker"), "aside": ("Aside", "Aside")}
INDENT, SMALL_TABLE, LEAST_CELL, EMU = 360, 0.88, 14.0, 12700
NAMESPACE = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DRAWN = 'xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
PICTURE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/image"
KINDS = {"image/png": "png", "image/jpeg": "jpeg", "image/gif": "gif"}
PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/><Default Extension="jpeg" ContentType="image/jpeg"/><Default Extension="gif" ContentType="image/gif"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
    "word/_rels/document.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
}


def _half_points(points: float) -> int:
    return round(2 * points)


def styles_xml(body: float, spacing: float) -> str:
    """Named styles: body text, six headings, and one for each other kind of block."""
    def style(key: str, name: str, size: float, bold: bool = False) -> str:
        return f'<w:style w:type="paragraph" w:styleId="{key}"><w:name w:val="{name}"/><w:pPr><w:spacing w:line="{round(240 * spacing)}" w:lineRule="auto" w:after="{round(10 * body)}"/></w:pPr><w:rPr>{"<w:b/>" if bold else ""}<w:sz w:val="{_half_points(size)}"/></w:rPr></w:style>'

    heads = "".join(style(f"Heading{k}", f"heading {k}", body * f, True) for k, f in HEADINGS.items())
    return f'<w:styles {NAMESPACE}>{style("Normal", "Normal", body)}{heads}{"".join(style(k, n, body) for k, n in STYLES.values())}</w:styles>'


def _said(c: Column) -> Column:
    return F.replace(X.html_escape(X.xml_clean(c)), F.lit("\n"), F.lit('</w:t><w:br/><w:t xml:space="preserve">'))


def _run(text: Column, tags: Column, rtl: Column, size: Column | None = None) -> Column:
    flag = lambda t, xml: F.when(F.array_contains(tags, t), xml).otherwise("")
    sized = F.concat(F.lit('<w:sz w:val="'), size.cast("string"), F.lit('"/>')) if size is not None else F.lit("")
    props = F.concat(flag("b", "<w:b/>"), flag("i", "<w:i/>"), flag("u", '<w:u w:val="single"/>'), F.when(rtl, "<w:rtl/>").otherwise(""), sized)
    return F.concat(F.lit("<w:r><w:rPr>"), props, F.lit('</w:rPr><w:t xml:space="preserve">'), _said(text), F.lit("</w:t></w:r>"))


def _paragraph(style: Column, rtl: Column, indent: Column, runs: Column) -> Column:
    props = F.concat(F.lit('<w:pStyle w:val="'), style, F.lit('"/>'), F.when(rtl, "<w:bidi/>").otherwise(""), F.when(indent > 0, F.concat(F.lit('<w:ind w:start="'), (indent * INDENT).cast("string"), F.lit('"/>'))).otherwise(""))
    return F.concat(F.lit("<w:p><w:pPr>"), props, F.lit("</w:pPr>"), runs, F.lit("</w:p>"))


def _table(rows: Column, widths: Column, rtl: Column, body: float) -> Column:
    none = F.array().cast("array<string>")
    size = F.lit(_half_points(max(LEAST_CELL, SMALL_TABLE * body)))

    def cell(c: Column) -> Column:
        span = F.when(c["col_span"] > 1, F.concat(F.lit('<w:gridSpan w:val="'), c["col_span"].cast("string"), F.lit('"/>'))).otherwise("")
        run = _run(F.coalesce(c["text"], F.lit("")), F.when(c["is_header"], F.array(F.lit("b"))).otherwise(none), rtl, size)
        return F.concat(F.lit("<w:tc><w:tcPr>"), span, F.lit("</w:tcPr>"), _paragraph(F.lit("Normal"), rtl, F.lit(0), run), F.lit("</w:tc>"))

    def row(r: Column) -> Column:
        head = F.when(F.exists(r, lambda c: c["is_header"]), "<w:trPr><w:tblHeader/></w:trPr>").otherwise("")
        return F.concat(F.lit("<w:tr>"), head, F.array_join(F.transform(r, cell), ""), F.lit("</w:tr>"))

    edges = "".join(f'<w:{e} w:val="single" w:sz="4"/>' for e in ("top", "start", "bottom", "end", "insideH", "insideV"))
    grid = F.concat(F.lit("<w:tblGrid>"), F.array_join(F.transform(widths, lambda w: F.concat(F.lit('<w:gridCol w:w="'), F.round(20 * w).cast("int").cast("string"), F.lit('"/>'))), ""), F.lit("</w:tblGrid>"))
    return F.concat(F.lit("<w:tbl><w:tblPr>"), F.when(rtl, "<w:bidiVisual/>").otherwise(""), F.lit(f"<w:tblBorders>{edges}</w:tblBorders></w:tblPr>"), grid, F.array_join(F.transform(rows, row), ""), F.lit("</w:tbl>"))


def _fitted(rows: Column, caption: Column, has_header: Column, rtl: Column, body: float, width: float) -> Column:
    """A table as it fits: whole, in parts, or as a list; with its caption before each part."""
    plain, bold = F.array().cast("array<string>"), F.array(F.lit("b"))
    points = F.lit(max(LEAST_CELL, SMALL_TABLE * body))
    said = lambda c: F.when(F.length(c) > 0, _paragraph(F.lit("Caption"), rtl, F.lit(0), _run(c, plain, rtl))).otherwise("")
    gap = _paragraph(F.lit("Normal"), rtl, F.lit(0), F.lit(""))
    one = lambda r, c, w: F.concat(said(c), _table(r, w, rtl, body), gap)
    none = F.array().cast("array<double>")
    parts = F.array_join(F.transform(B.split_parts(rows, caption), lambda p: one(p["rows"], p["caption"], none)), "")
    item = lambda indent, runs: _paragraph(F.lit("ListParagraph"), rtl, F.lit(indent), runs)
    detail = lambda d: item(1, F.concat(F.when(d["label"].isNotNull(), _run(F.concat(d["label"], F.lit(": ")), bold, rtl)).otherwise(""), _run(d["value"], plain, rtl)))
    lead = lambda e: F.when(F.length(e["lead"]) > 0, item(0, _run(e["lead"], bold, rtl))).otherwise("")
    entries = F.array_join(F.transform(B.entries(rows, has_header), lambda e: F.concat(lead(e), F.array_join(F.transform(e["details"], detail), ""))), "")
    fit = B.fit(rows, B.measures(rows), F.lit(width), points)
    return F.when(fit["tier"] == "split", parts).when(fit["tier"] == "linearize", F.concat(said(caption), entries)).otherwise(one(rows, caption, fit["widths"]))


def _drawn(picture: Column, alt: Column) -> Column:
    """A picture in its line; it names the relation that leads to its bytes."""
    size = F.concat(F.lit('cx="'), (picture["width"] * EMU).cast("long").cast("string"), F.lit('" cy="'), (picture["height"] * EMU).cast("long").cast("string"), F.lit('"'))
    number = picture["ord"].cast("string")
    return F.concat(
        F.lit(f"<w:p><w:r><w:drawing {DRAWN}><wp:inline><wp:extent "), size, F.lit('/><wp:docPr id="'), (picture["ord"] + 1).cast("string"), F.lit('" name="Picture" descr="'), X.html_escape(X.xml_clean(alt)),
        F.lit('"/><a:graphic><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/picture"><pic:pic><pic:nvPicPr><pic:cNvPr id="0" name=""/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="pic'), number,
        F.lit('"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext '), size, F.lit('/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing></w:r></w:p>'))


def block_xml(body: float, width: float) -> Column:
    """A block (type, text, level, text_direction, indent_level, styles, rows, caption, has_header, page_marker, picture) as paragraphs, a table or a picture."""
    rtl = F.coalesce(F.col("text_direction") == "rtl", F.lit(False))
    kind = F.col("type")
    style = F.when(kind.isin("heading", "title"), F.concat(F.lit("Heading"), F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(1)))).cast("string")))
    for name, (key, _) in STYLES.items():
        style = style.when(kind == name, key)
    text = F.when(kind == "page_marker", F.concat(F.lit("Original page "), F.col("page_marker").cast("string"))).when(kind == "image", F.coalesce("text", F.lit("[Picture]"))).otherwise(F.coalesce("text", F.lit("")))
    runs = F.array_join(F.transform(X.styled_segments(text, F.col("styles")), lambda s: _run(s["text"], s["tags"], rtl)), "")
    grid = _fitted(F.col("rows"), F.coalesce("caption", F.lit("")), F.coalesce("has_header", F.lit(True)), rtl, body, width)
    plain = _paragraph(style.otherwise("Normal"), rtl, F.coalesce("indent_level", F.lit(0)), runs)
    return F.when(F.size("rows") > 0, grid).when(F.col("picture").isNotNull(), _drawn(F.col("picture"), text)).otherwise(plain)


def _with_pictures(blocks: DataFrame, pictures: DataFrame | None, body: float, width: float, height: float) -> DataFrame:
    """blocks with their picture (its size on the page, bytes and kind), null where there is none."""
    if pictures is None:
        return blocks.withColumn("picture", F.lit(None).cast("struct<ord:int,width:double,height:double,content:binary,kind:string>"))
    ending = F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), F.col("mime_type"))
    known = pictures.filter(ending.isNotNull() & F.col("content").isNotNull()).select("doc_id", "asset", F.struct("content", "width", "height", ending.alias("kind")).alias("_p"))
    size = G.picture_size(F.col("_p.width"), F.col("_p.height"), F.lit(None).cast("double"), width, height, body, F.lit(False))
    x = blocks.join(known, ["doc_id", "asset"], "left").withColumn("_s", size)
    return x.withColumn("picture", F.when((F.col("type") == "image") & F.col("_p").isNotNull(), F.struct(F.col("ord").cast("int").alias("ord"), "_s.width", "_s.height", "_p.content", "_p.kind"))).drop("_p", "_s")


def large_print(blocks: DataFrame, body: float = 20.0, spacing: float = 1.5, paper: str = "A4", pictures: DataFrame | None = None) -> DataFrame:
    """(doc_id, content): each document's blocks in order as an office document with named styles in large print.

    pictures: (doc_id, asset, content, mime_type, width, height in pixels), one row for each asset that blocks name; a document's pictures are
    packed with it in one task.
    """
    if paper not in PAPERS or not G.BODY_RANGE[0] <= body <= G.BODY_RANGE[1] or not G.SPACING_RANGE[0] <= spacing <= G.SPACING_RANGE[1]:
        raise ValueError("paper, text size or spacing out of range")
    width, height, margin = PAPERS[paper]
    page = f'<w:sectPr><w:pgSz w:w="{width}" w:h="{height}"/><w:pgMar w:top="{margin}" w:bottom="{margin}" w:start="{margin}" w:end="{margin}"/></w:sectPr>'
    styles = styles_xml(body, spacing)

    @arrow_rows("binary")
    def packed(document: pa.Array, media: pa.Array) -> pa.Array:
        def archive(xml: str, pictures) -> bytes:
            files = {f"word/media/image{m['ord']}.{m['kind']}": bytes(m["content"]) for m in pictures}
            relations = "".join(f'<Relationship Id="pic{m["ord"]}" Type="{PICTURE}" Target="media/image{m["ord"]}.{m["kind"]}"/>' for m in pictures)
            parts = {**PARTS, "word/styles.xml": styles, "word/document.xml": xml}
            parts["word/_rels/document.xml.rels"] = parts["word/_rels/document.xml.rels"].replace("</Relationships>", relations + "</Relationships>")
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for name, said in {**{n: '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + x for n, x in parts.items()}, **files}.items():
                    z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), said, zipfile.ZIP_DEFLATED)
            return out.getvalue()

        # one document and its pictures at a time: a batch never lies here as Python objects
        return pa.array((archive(d.as_py(), m.as_py()) for d, m in zip(document, media)), pa.binary(), size=len(document))

    absent = {"caption": "string", "has_header": "boolean", "asset": "string"}
    x = blocks.withColumns({n: F.lit(None).cast(k) for n, k in absent.items() if n not in blocks.columns})
    x = _with_pictures(x, pictures, body, (width - 2 * margin) / 20, (height - 2 * margin) / 20)
    x = x.withColumn("_xml", block_xml(body, (width - 2 * margin) / 20)).groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "_xml"))), lambda b: b["_xml"]), "").alias("_body"), F.collect_list(F.struct("picture.ord", "picture.content", "picture.kind")).alias("_media"))
    media = F.filter("_media", lambda m: m["content"].isNotNull())
    return x.select("doc_id", packed(F.concat(F.lit(f"<w:document {NAMESPACE}><w:body>"), "_body", F.lit(f"{page}</w:body></w:document>")), media).alias("content"))
