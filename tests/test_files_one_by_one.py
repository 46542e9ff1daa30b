"""Batches of files go through Python a file at a time, so that memory doesn't follow a batch's bytes."""

import io
import random
import tracemalloc
import zipfile

import pyarrow as pa

from quillspan.sources import docx, folders, office, sniff


def most(work):
    tracemalloc.start()
    try:
        out = work()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def archive(size):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", "x" * size)
    return buf.getvalue()


def test_members_and_writing(tmp_path):
    files = pa.array([archive(1_000_000)] * 30 + [None, b"", b"PK\x03\x04junk"], pa.binary())
    got, peak = most(lambda: sniff.members.__wrapped__(files))
    assert [len(m) for m in got.to_pylist()] == [1] * 30 + [0] * 3 and peak < 3_000_000
    writer = folders.FolderWriter.__new__(folders.FolderWriter)
    writer.suffix = ".docx"
    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(30)]), files[:30]], ["doc_id", "content"])
    (n, size), peak = most(lambda: writer._written(iter([batch]), str(tmp_path)))
    assert (n, size) == (30, 30 * len(archive(1_000_000))) and peak < 5_000_000


def test_packing(spark, monkeypatch):
    made = []
    real = docx.arrow_rows
    monkeypatch.setattr(docx, "arrow_rows", lambda kind: lambda f: made.append(f) or real(kind)(f))
    blocks = spark.createDataFrame([("d", 0, "paragraph", "text")], "doc_id string, ord int, type string, text string").selectExpr(
        "*", "cast(null as int) level", "'ltr' text_direction", "0 indent_level", "cast(null as int) page_marker", "cast(null as array<struct<start:int,end:int,bold:boolean,italic:boolean,underline:boolean>>) styles",
        "cast(null as array<array<struct<text:string,row_span:int,col_span:int,is_header:boolean>>>) rows")
    assert docx.large_print(blocks).count() == 1
    texts = pa.array(["".join(random.Random(k).choices("ab", k=1000)) * 1000 for k in range(30)])
    got, peak = most(lambda: made[0](texts, pa.array([[]] * 30)))
    assert len(got) == 30 and peak < 8_000_000
    assert zipfile.ZipFile(io.BytesIO(got[7].as_py())).read("word/document.xml").decode().endswith(texts[7].as_py())


def test_elements_leave_by_file():
    class Table:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    import pyspark.sql.functions as F

    F_col, office.F.col = F.col, lambda name: type("C", (), {"cast": lambda s, k: s, "alias": lambda s, n: s})()
    try:
        run = office._read(Table(), "docx")
    finally:
        office.F.col = F_col
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", None]), pa.array([archive(10), b"", None], pa.binary())], ["doc_id", "content"])
    assert [(b.num_rows, b.column(0)[0].as_py(), b.column(2)[0].as_py()) for b in run(iter([batch]))] == [(1, "a", "error"), (1, "b", "error"), (1, None, "error")]
