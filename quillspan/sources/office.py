"""Office documents as block rows, from the ZIP and XML of the standard library.

One row a file goes in (doc_id, content), blocks come out; the passes over them are DataFrame operations.  `folders` reads whole folders
of files by the same functions.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
import zlib
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import text as X
from ..schema import names
from .sniff import BOMB_BYTES, BOMB_RATIO, MAX_BYTES, safe_name

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
EMU = 12700.0
RAW = "doc_id string, ord int, kind string, page int, style string, numbered boolean, rtl boolean, level int, text string, rows array<array<struct<text:string,row_span:int,col_span:int,is_header:boolean>>>, asset string, digest string, box struct<x0:double,y0:double,x1:double,y1:double>"

CELL = pa.struct([("text", pa.string()), ("row_span", pa.int32()), ("col_span", pa.int32()), ("is_header", pa.bool_())])
BOX = pa.struct([(n, pa.float64()) for n in ("x0", "y0", "x1", "y1")])
ARROW = pa.schema([
    ("doc_id", pa.string()), ("ord", pa.int32()), ("kind", pa.string()), ("page", pa.int32()), ("style", pa.string()), ("numbered", pa.bool_()), ("rtl", pa.bool_()), ("level", pa.int32()), ("text", pa.string()),
    ("rows", pa.list_(pa.list_(CELL))), ("asset", pa.string()), ("digest", pa.string()), ("box", BOX)])


def _opened(content: bytes) -> zipfile.ZipFile:
    """The archive, if its members stay in their folder and don't unpack to far more than they should."""
    z = zipfile.ZipFile(io.BytesIO(content))
    size, packed = sum(m.file_size for m in z.infolist()), sum(m.compress_size for m in z.infolist())
    if not all(safe_name(m.filename) for m in z.infolist()):
        raise ValueError("a member leaves its folder")
    if size > MAX_BYTES or (size > BOMB_BYTES and size > BOMB_RATIO * max(1, packed)):
        raise ValueError("unpacks to too much")
    return z


def _xml(z: zipfile.ZipFile, part: str):
    raw = z.read(part)
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
        raise ValueError(f"{part} declares a document type")
    return ET.fromstring(raw)


def _targets(z: zipfile.ZipFile, part: str) -> dict:
    """The parts that a part's relations lead to."""
    rels = posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels")
    if rels not in z.namelist():
        return {}
    where = lambda t: t[1:] if t.startswith("/") else posixpath.normpath(posixpath.join(posixpath.dirname(part), t))
    return {r.get("Id"): where(r.get("Target") or "") for r in _xml(z, rels)}


def _picture(z: zipfile.ZipFile, targets: dict, blip, digest: bool) -> tuple[str | None, str | None]:
    """The member that holds a picture, and its digest where that is wanted."""
    name = targets.get(blip.get(R + "embed"))
    return (name, hashlib.sha256(z.read(name)).hexdigest() if digest else None) if name in z.namelist() else (None, None)


def _text(node, run: str, brk: dict) -> str:
    return "".join(x.text or "" if x.tag == run else brk.get(x.tag, "") for x in node.iter())


def _word(p) -> str:
    return _text(p, W + "t", {W + "tab": "\t", W + "br": "\n"}).strip()


def docx_rows(doc_id: str, content: bytes, digest: bool = True):
    """Body elements in order.  A paragraph with a page break comes after the new marker but keeps the old page."""
    z = _opened(content)
    body, parts = _xml(z, "word/document.xml").find(W + "body"), _targets(z, "word/document.xml")
    styles = {}
    if "word/styles.xml" in z.namelist():
        for s in _xml(z, "word/styles.xml").iter(W + "style"):
            name = s.find(W + "name")
            styles[s.get(W + "styleId")] = name.get(W + "val") if name is not None else s.get(W + "styleId")
    out, page = [(doc_id, 0, "marker", 1, *[None] * 9)], 1
    add = lambda *v: out.append((doc_id, len(out), *v, *[None] * (11 - len(v))))
    for e in body if body is not None else ():
        if e.tag == W + "p":
            here = page
            breaks = any(b.get(W + "type") == "page" for b in e.iter(W + "br"))
            sect = e.find(f"{W}pPr/{W}sectPr")
            kind = sect.find(W + "type") if sect is not None else None
            if breaks or (sect is not None and (kind is None or kind.get(W + "val") != "continuous")):
                page += 1
                add("marker", page, None, None, None, None, None, None)
            for blip in e.iter(A + "blip"):
                add("image", here, None, None, None, None, None, None, *_picture(z, parts, blip, digest))
            ref = e.find(f"{W}pPr/{W}pStyle")
            text = _word(e)
            if text:
                rtl = e.find(f"{W}pPr/{W}bidi") is not None or any(True for _ in e.iter(W + "rtl"))
                add("paragraph", here, styles.get(ref.get(W + "val"), ref.get(W + "val")) if ref is not None else "", e.find(f"{W}pPr/{W}numPr") is not None, rtl, None, text, None)
        elif e.tag == W + "tbl":
            rows = []
            for r, tr in enumerate(e.findall(W + "tr")):
                head = r == 0 or tr.find(f"{W}trPr/{W}tblHeader") is not None
                rows.append([{"text": "\n".join(_word(p) for p in tc.findall(W + "p")).strip(), "row_span": 1, "col_span": 1, "is_header": head} for tc in tr.findall(W + "tc")])
            add("table", page, None, None, e.find(f"{W}tblPr/{W}bidiVisual") is not None, None, None, rows)
    if "word/footnotes.xml" in z.namelist():
        try:
            for f in _xml(z, "word/footnotes.xml").findall(W + "footnote"):
                said = " ".join(t.text or "" for t in f.iter(W + "t")).strip()
                if f.get(W + "type") not in ("separator", "continuationSeparator", "continuationNotice") and said:
                    add("footnote", page, None, None, None, None, said, None)
        except (ET.ParseError, ValueError) as e:
            add("warning", page, None, None, None, None, f"The footnotes could not be read: {e}", None)
    return out


def _numbers(node, first: str, second: str) -> tuple[float, float] | None:
    return (float(node.get(first)), float(node.get(second))) if node is not None else None


def _shapes(tree, scale=(1.0, 1.0), shift=(0.0, 0.0)):
    """(shape, its box in slide units or None) of all shapes in order, groups opened.

    A group lays its inner coordinates (chOff, chExt) over its own place (off, ext); nested groups compose.  Turns and flips are left out.
    """
    for s in tree:
        if s.tag == P + "grpSp":
            x = s.find(f"{P}grpSpPr/{A}xfrm")
            inner, moved = scale, shift
            if x is not None:
                off, ext, at, size = (_numbers(x.find(A + n), *k) for n, k in (("off", "xy"), ("ext", ("cx", "cy")), ("chOff", "xy"), ("chExt", ("cx", "cy"))))
                off, at = off or (0.0, 0.0), at or off or (0.0, 0.0)
                grow = tuple(e / c if e is not None and c else 1.0 for e, c in zip(ext or (None, None), size or (None, None)))
                inner = tuple(a * g for a, g in zip(scale, grow))
                moved = tuple(t + a * (o - c * g) for t, a, o, c, g in zip(shift, scale, off, at, grow))
            yield from _shapes(s, inner, moved)
        elif s.tag in (P + "sp", P + "pic", P + "graphicFrame"):
            x = s.find(f"{P}spPr/{A}xfrm")
            x = x if x is not None else s.find(P + "xfrm")
            off, ext = (_numbers(x.find(A + n), *k) if x is not None else None for n, k in (("off", "xy"), ("ext", ("cx", "cy"))))
            if off is None:
                yield s, None
            else:
                (x0, y0), (w, h) = (tuple(a * o + t for a, o, t in zip(scale, off, shift)), tuple(a * e for a, e in zip(scale, ext or (0.0, 0.0))))
                yield s, (x0, y0, x0 + w, y0 + h)


def pptx_rows(doc_id: str, content: bytes, digest: bool = True):
    """Slides in order: marker, title, the other shapes by top and left on the slide, with their boxes in points, notes."""
    z = _opened(content)
    rel = _targets(z, "ppt/presentation.xml")
    ids = [s.get(R + "id") for s in _xml(z, "ppt/presentation.xml").iter(P + "sldId")]
    out: list[tuple] = []
    add = lambda *v: out.append((doc_id, len(out), *v, *[None] * (11 - len(v))))
    for page, rid in enumerate(ids, 1):
        part = rel[rid]
        parts = _targets(z, part)
        add("marker", page, None, None, None, None, None, None)
        tree = _xml(z, part).find(f"{P}cSld/{P}spTree")
        shapes = []
        for s, box in _shapes(tree if tree is not None else ()):
            ph = next(s.iter(P + "ph"), None)
            title = ph is not None and ph.get("type") in ("title", "ctrTitle")
            top, left = (box[1], box[0]) if box else (0.0, 0.0)
            shapes.append((not title, top, left, len(shapes), s, box and dict(zip(("x0", "y0", "x1", "y1"), (v / EMU for v in box)))))
        for other, _, _, _, s, box in sorted(shapes, key=lambda x: x[:4]):
            if s.tag == P + "pic":
                blip = next(s.iter(A + "blip"), None)
                add("image", page, None, None, None, None, None, None, *(_picture(z, parts, blip, digest) if blip is not None else (None, None)), box)
                continue
            table = next(s.iter(A + "tbl"), None)
            if table is not None:
                rows = [[{"text": "\n".join(_text(p, A + "t", {A + "br": "\n"}).strip() for p in tc.iter(A + "p")).strip(), "row_span": 1, "col_span": 1, "is_header": r == 0} for tc in tr.findall(A + "tc")] for r, tr in enumerate(table.findall(A + "tr"))]
                add("table", page, None, None, None, None, None, rows, None, None, box)
                continue
            paragraphs = [(p, _text(p, A + "t", {A + "br": "\n"}).strip()) for p in s.iter(A + "p")]
            if not other:
                said = " ".join(t for _, t in paragraphs if t)
                if said:
                    add("title", page, None, None, None, None, said, None, None, None, box)
                continue
            for p, t in paragraphs:
                if t:
                    pr = p.find(A + "pPr")
                    add("slide_text", page, None, None, None, int(pr.get("lvl", 0)) if pr is not None else 0, t, None, None, None, box)
        notes = next((t for t in parts.values() if "notesSlide" in t), None)
        if notes:
            said = "\n".join(t for t in (_text(p, A + "t", {}).strip() for p in _xml(z, notes).iter(A + "p")) if t and not re.fullmatch(r"\d+", t))
            if said:
                add("notes", page, None, None, None, None, f"[Speaker Notes] {said}", None)
    return out


READERS = {"docx": docx_rows, "pptx": pptx_rows}


def elements(kind: str, doc_id: str, content, wanted: set) -> list[dict]:
    """A file's elements as rows of RAW; where it can't be read one row of kind `error` with the reason.

    content: gives the bytes.  wanted: names of the columns that are used; pictures are only digested if theirs is one of them.
    """
    try:
        rows = READERS[kind](doc_id, bytes(content() or b""), "digest" in wanted)
    except (OSError, zipfile.BadZipFile, zlib.error, ET.ParseError, KeyError, ValueError, NotImplementedError, RuntimeError) as e:
        rows = [(doc_id, 0, "error", *[None] * 5, f"{type(e).__name__}: {e}", *[None] * 4)]
    return [dict(zip(names(RAW), r)) for r in rows]


def _read(files: DataFrame, kind: str) -> DataFrame:
    """Elements of all files (doc_id, content); a file at a time."""

    def run(batches):
        for b in batches:
            for d, c in zip(b.column(0), b.column(1)):
                yield pa.RecordBatch.from_pylist(elements(kind, d.as_py(), c.as_py, set(names(RAW))), schema=ARROW)

    return files.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(run, RAW)


def read_docx(files: DataFrame) -> DataFrame:
    return blocks_of(_read(files, "docx"))


def read_pptx(files: DataFrame) -> DataFrame:
    return blocks_of(_read(files, "pptx"))


def unreadable(files: DataFrame, kind: str) -> DataFrame:
    """(doc_id, problem, fatal): files of a kind (docx, pptx) that can't be read, and parts that were left out."""
    return problems_of(_read(files, kind))


def problems_of(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("kind").isin("error", "warning")).select("doc_id", F.col("text").alias("problem"), (F.col("kind") == "error").alias("fatal"))


def blocks_of(raw: DataFrame) -> DataFrame:
    """Raw elements as blocks: type, level and text by style; language and direction by script or mark-up."""
    d, p = X.docx_block(F.col("style"), F.col("text"), F.col("numbered")), X.pptx_block(F.col("level"), F.col("text"))
    kind = F.col("kind")
    spoken = F.coalesce(F.col("text"), F.array_join(F.transform(F.flatten("rows"), lambda c: c["text"]), " "))
    counts = X.script_counts(spoken)
    marked = F.coalesce("rtl", F.lit(False)) | ((kind == "table") & F.exists(F.flatten("rows"), lambda c: X.direction(X.script_counts(c["text"])) == "rtl"))
    return raw.filter(~kind.isin("error", "warning")).select(
        "doc_id", "ord",
        F.when(kind == "paragraph", d["type"]).when(kind == "slide_text", p["type"]).when(kind == "title", "heading").when(kind == "notes", "aside").when(kind == "marker", "page_marker").otherwise(kind).alias("type"),
        F.when(kind == "paragraph", d["text"]).when(kind == "slide_text", p["text"]).otherwise(F.col("text")).alias("text"),
        F.when(kind == "paragraph", d["level"]).when(kind == "title", 1).cast("int").alias("level"),
        F.when(marked, "ar").otherwise(X.language(counts)).alias("language"), F.when(marked, "rtl").otherwise(X.direction(counts)).alias("text_direction"),
        F.col("page").alias("source_page"), F.when(kind == "marker", F.col("page")).alias("page_marker"), "rows", (kind == "table").alias("has_header"), "asset", "digest", "box")


def titles(blocks: DataFrame) -> DataFrame:
    """Each document's first heading."""
    return blocks.filter((F.col("type") == "heading") & (F.coalesce("text", F.lit("")) != "")).groupBy("doc_id").agg(F.min_by("text", "ord").alias("title"))
