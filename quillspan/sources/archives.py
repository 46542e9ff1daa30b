"""Office archives without active content: macros, controls and embedded programs go, targets outside the document are cut."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Fixed values.
ACTIVE = re.compile(r"(?i)^(word/vbaProject\.bin|word/vbaData\.xml|ppt/vbaProject\.bin|.*vbaProjectSignature\.bin|.*/activeX/.*|.*/embeddings/.*\.bin)$")
OUTSIDE = ("file:", "javascript:", "mhtml:")
CLEANED = "doc_id string, content binary, removed array<string>"


def _relations(raw: bytes) -> tuple[bytes, list[str]]:
    """Relations with their outside targets cut.  Elements are cut as text, so that broken files are cleaned as well."""
    removed: list[str] = []

    def element(m):
        target = re.search(r'Target\s*=\s*"([^"]*)"', m[0])
        if not target or not target[1].startswith(OUTSIDE) or not re.search(r'TargetMode\s*=\s*"External"', m[0]):
            return m[0]
        removed.append(f"ExternalRel:{target[1]}")
        return m[0].replace(target[0], 'Target="#"')

    text = re.sub(r"<Relationship\b[^>]*>", element, raw.decode("utf-8", errors="surrogateescape"))
    return (text.encode("utf-8", errors="surrogateescape"), removed) if removed else (raw, removed)


def cleaned(content: bytes) -> tuple[bytes, list[str]]:
    out, removed = io.BytesIO(), []
    with zipfile.ZipFile(io.BytesIO(content)) as source, zipfile.ZipFile(out, "w", compression=zipfile.ZIP_DEFLATED) as target:
        for m in source.infolist():
            if ACTIVE.match(m.filename):
                removed.append(f"ArchiveMember:{m.filename}")
                continue
            raw = source.read(m.filename)
            if m.filename.endswith(".rels"):
                raw, gone = _relations(raw)
                removed += gone
            target.writestr(m, raw)
    return out.getvalue(), removed


def clean_archives(files: DataFrame) -> DataFrame:
    """files(doc_id, content) with active content removed, and what was removed."""

    def run(batches):
        for pdf in batches:
            made = [cleaned(bytes(c)) for c in pdf["content"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "content": [m[0] for m in made], "removed": [m[1] for m in made]})

    return files.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInPandas(run, CLEANED)


def references(texts: DataFrame, records: DataFrame) -> DataFrame:
    """Benchmark references: a case's JSON record with its transcript from the first place that has one.

    texts(case, priority, content), records(case, value): value is the JSON of reading order, pages, tables and pictures.
    """
    first = texts.filter(F.col("content").isNotNull()).groupBy("case").agg(F.min_by("content", "priority").alias("transcript"))
    schema = "reading_order array<string>, source_pages array<int>, tables array<array<array<string>>>, image_count int, image_pixel_hashes array<string>, license string"
    return records.select("case", F.from_json("value", schema).alias("r")).select("case", "r.*").join(first, "case", "left")
