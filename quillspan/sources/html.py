"""Web pages as block rows, by the tolerant parser of the standard library."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

PAGES_AT_ONCE = 100
TYPES = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string())
BLOCKS = "page_id long, ord int, type string, level int, text string"
KINDS = {**{f"h{k}": "heading" for k in range(1, 7)}, "p": "paragraph", "li": "list", "blockquote": "quote", "figcaption": "caption", "td": "paragraph", "th": "paragraph", "footer": "aside", "nav": "aside", "div": "paragraph"}
SKIPPED = {"script", "style", "head", "noscript", "template"}


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.now, self.kind, self.skip = [], [], ("paragraph", None), 0

    def flush(self):
        text = " ".join("".join(self.now).split())
        if text:
            self.out.append((*self.kind, text))
        self.now, self.kind = [], ("paragraph", None)

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        elif tag in KINDS or tag in ("article", "ul", "ol", "table", "tr", "section", "body"):
            self.flush()
            self.kind = (KINDS.get(tag, "paragraph"), int(tag[1]) if tag[0] == "h" and tag[1:].isdigit() else None)
        elif tag == "br":
            self.now.append("\n")
        elif tag == "img":
            self.flush()
            self.out.append(("image", None, dict(attrs).get("alt") or ""))

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in KINDS or tag in ("article", "ul", "ol", "table", "tr", "section", "body"):
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.now.append(data)


def blocks_of(html: str | None) -> list[tuple]:
    r = _Reader()
    r.feed(html or "")
    r.close()
    r.flush()
    return r.out


def read_html(pages: DataFrame) -> DataFrame:
    """pages(page_id, html) -> blocks in order."""

    def run(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, PAGES_AT_ONCE):
                b = whole.slice(first, PAGES_AT_ONCE)
                rows = [(p, k, t, lv, x) for p, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, (t, lv, x) in enumerate(blocks_of(h))]
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*rows) if rows else [()] * 5, TYPES)], names=["page_id", "ord", "type", "level", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(run, BLOCKS)
