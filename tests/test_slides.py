"""Slides: shapes within groups stand where the groups' coordinates put them."""

import io
import zipfile

from quillspan.sources import office as O

NS = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
PT = 12700


def xfrm(tag, x, y, w, h, inner=None):
    child = f'<a:chOff x="{inner[0] * PT}" y="{inner[1] * PT}"/><a:chExt cx="{inner[2] * PT}" cy="{inner[3] * PT}"/>' if inner else ""
    return f'<{tag}><a:off x="{x * PT}" y="{y * PT}"/><a:ext cx="{w * PT}" cy="{h * PT}"/>{child}</{tag}>'


def shape(text, box=None):
    place = f"<p:spPr>{xfrm('a:xfrm', *box)}</p:spPr>" if box else "<p:spPr/>"
    return f"<p:sp>{place}<p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>"


def group(place, *shapes):
    return f"<p:grpSp><p:grpSpPr>{place}</p:grpSpPr>{''.join(shapes)}</p:grpSp>"


def deck(*shapes):
    parts = {
        "ppt/presentation.xml": f'<p:presentation {NS}><p:sldIdLst><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="r1" Target="slides/s1.xml"/></Relationships>',
        "ppt/slides/s1.xml": f"<p:sld {NS}><p:cSld><p:spTree>{''.join(shapes)}</p:spTree></p:cSld></p:sld>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, said in parts.items():
            z.writestr(name, said)
    return bytearray(out.getvalue())


def test_nested_groups(spark):
    inner = group(xfrm("a:xfrm", 0, 0, 50, 50, (0, 0, 100, 100)), shape("deep", (100, 100, 20, 20)), shape("top of the inner", (0, 0, 10, 10)))
    outer = group(xfrm("a:xfrm", 200, 300, 200, 100, (0, 0, 100, 100)), inner, shape("beside", (90, 0, 10, 10)))
    table = f"<p:graphicFrame>{xfrm('p:xfrm', 10, 500, 70, 30)}<a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>cell</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl></p:graphicFrame>"
    plain = group("", shape("moved by nothing", (5, 20, 10, 10)))
    files = spark.createDataFrame([("d", deck(outer, table, plain, shape("first", (0, 10, 10, 10)), shape("nowhere")))], "doc_id string, content binary")
    got = O.read_pptx(files).orderBy("ord").collect()
    boxes = {r.text or r.type: tuple(r.box) if r.box else None for r in got if r.type != "page_marker"}
    assert boxes["deep"] == (300.0, 350.0, 320.0, 360.0) and boxes["top of the inner"] == (200.0, 300.0, 210.0, 305.0)
    assert boxes["beside"] == (380.0, 300.0, 400.0, 310.0) and boxes["table"] == (10.0, 500.0, 80.0, 530.0)
    assert boxes["moved by nothing"] == (5.0, 20.0, 15.0, 30.0) and boxes["nowhere"] is None
    assert [r.text for r in got if r.type == "paragraph"] == ["nowhere", "first", "moved by nothing", "top of the inner", "beside", "deep"]


def test_groups_without_size(spark):
    flat = group(xfrm("a:xfrm", 10, 10, 100, 0, (0, 0, 50, 0)), shape("flat", (5, 5, 10, 10)))
    bare = group("<a:xfrm/>", shape("bare", (1, 2, 3, 4)))
    got = O.read_pptx(spark.createDataFrame([("d", deck(flat, bare))], "doc_id string, content binary")).collect()
    assert {r.text: tuple(r.box) for r in got if r.text} == {"flat": (20.0, 15.0, 40.0, 25.0), "bare": (1.0, 2.0, 4.0, 6.0)}
