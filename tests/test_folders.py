"""The data source of files: two-phase writing, planned reading, error rows."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quillspan.sources import folders as D, office as O


def files(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id string, content string").repartition(parts)


def shown(spark, path, **k):
    return {r.doc_id: r.value for r in D.read_files(spark, path, "text", **k).collect()}


def test_write_and_read(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [("a/b", "one"), ("ü~", "two"), ("..", "three"), ("_x", "four"), ("l" * 400, "five"), ("", "six")]
    D.write_files(files(spark, rows), path, ".txt")
    assert shown(spark, path) == dict(rows)
    D.write_files(files(spark, [("more", "seven")]), f"file://{path}", ".txt")
    assert len(shown(spark, path)) == 7
    D.write_files(files(spark, [("new", "eight")]), path, ".txt", mode="overwrite")
    assert shown(spark, path) == {"new": "eight"}
    assert len([n for n in os.listdir(path) if n.startswith(D.MANIFEST)]) == 1 and len(os.listdir(path)) == 2
    names = [f for _, _, fs in os.walk(path) for f in fs]
    assert "new.txt" in names and not any(n.startswith(".") for n in names)
    D.write_files(files(spark, [("same", "x"), ("same", "y")], 1), path, ".txt", mode="overwrite")
    assert sorted(r.value for r in D.read_files(spark, path, "text").collect()) == ["x", "y"]
    D.write_files(files(spark, []), path, ".txt", mode="overwrite")
    assert shown(spark, path) == {}


@pytest.mark.parametrize("bad", [("z", None), (None, "text"), ("z", "")])
def test_a_failed_job_leaves_what_was_there(spark, tmp_path, bad):
    path = str(tmp_path / "out")
    D.write_files(files(spark, [("a", "one")]), path)
    before = sorted(os.listdir(path))
    with pytest.raises(Exception, match="nothing to write"):
        D.write_files(files(spark, [(f"k{k}", "text") for k in range(50)] + [bad], 4), path, mode="overwrite")
    assert sorted(os.listdir(path)) == before and shown(spark, path) == {"a": "one"}


def test_only_listed_attempts_count(spark, tmp_path):
    """What a lost or slower attempt wrote is not read; a commit removes it."""
    path = tmp_path / "out"
    w = D.FolderWriter(str(path), "", spark.createDataFrame([], "doc_id string, content string").schema, True)
    for name in ("000000-1", "000000-2"):
        folder = path / w.job / name
        folder.mkdir()
        (folder / "a").write_text(name)
        (folder / D.INDEX).write_text(json.dumps(["a", "a", 8]) + "\n")
    assert D.manifests(str(path)) == {}
    w.commit([D.Written("000000-2", 1, 8), None])
    assert shown(spark, str(path)) == {"a": "000000-2"} and os.listdir(path / w.job) == ["000000-2"]
    again = D.FolderWriter(str(path), "", spark.createDataFrame([], "doc_id string, content string").schema, True)
    (path / again.job / "000000-1").mkdir()
    again.abort([])
    assert not (path / again.job).exists() and shown(spark, str(path)) == {"a": "000000-2"}
    # an overwrite that stopped after its manifest: the older job counts no more, though its files are there
    D._put_json(str(path / f"{D.MANIFEST}later"), {"parts": [], "replaces": [w.job]})
    assert shown(spark, str(path)) == {}


def test_partitions_are_planned_by_bytes(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [(f"{k:03}", "x" * 100_000) for k in range(40)]
    D.write_files(files(spark, rows, 2), path)
    df = D.read_files(spark, path, "text", "doc_id string, bytes long", partition_bytes=500_000)
    assert 8 <= df.rdd.getNumPartitions() <= 16 and sorted(r.doc_id for r in df.collect()) == [r[0] for r in rows]
    few = D.read_files(spark, path, "binary", partition_bytes=100_000_000)
    assert few.rdd.getNumPartitions() == 1 and few.filter(F.length("content") == 100_000).count() == 40
    plain = tmp_path / "plain" / "sub"
    plain.mkdir(parents=True)
    for k in range(6):
        (plain / f"d%2F{k}.txt").write_text("x" * 1000)
    (plain / "_hidden").write_text("x")
    df = D.read_files(spark, str(tmp_path / "plain"), "text", partition_bytes=2 * (1000 + D.OPEN_BYTES))
    assert df.rdd.getNumPartitions() == 3 and {r.doc_id for r in df.collect()} == {f"d/{k}" for k in range(6)}


def test_columns_filters_and_errors(spark, tmp_path):
    path = tmp_path / "office"
    path.mkdir()
    (path / "bad.docx").write_text("not an archive")
    (path / "bad.pptx").write_text("not read as docx")
    raw = D.read_files(spark, str(path), "docx")
    assert [(r.doc_id, r.fatal) for r in O.problems_of(raw).collect()] == [("bad", True)] and O.blocks_of(raw).count() == 0
    out = str(tmp_path / "out")
    D.write_files(files(spark, [(str(k), "text") for k in range(20)]), out)
    (row,) = [p for p in os.walk(out) if D.INDEX in p[2]][:1]
    os.unlink(f"{row[0]}/{next(f for f in row[2] if f != D.INDEX)}")  # a file that isn't asked for isn't opened
    assert D.read_files(spark, out, "text", "doc_id string").count() == 20
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        kept = {f for f in row[2] if f != D.INDEX and os.path.exists(f"{row[0]}/{f}")}
        got = D.read_files(spark, out, "text").filter(F.col("doc_id").isin(*kept)).collect()
        assert {r.doc_id for r in got} == kept and all(r.value == "text" for r in got)
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(Exception, match="kind is one of"):
        D.read_files(spark, out, "pdf").count()
    with pytest.raises(ValueError, match="mount"):
        D.local("s3://bucket/x")
