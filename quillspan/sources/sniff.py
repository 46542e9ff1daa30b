"""File types by content: what a binary table's files are, whatever their names."""

from __future__ import annotations

import posixpath
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import arrow_rows

# Fixed values.
MAX_BYTES, HEAD, OLE_SCAN = 500 * 1024 * 1024, 1024, 512 * 1024
OLE = "D0CF11E0A1B11AE1"
BOMB_RATIO, BOMB_BYTES = 100.0, 10 * 1024 * 1024
MEMBERS = pa.list_(pa.struct([("name", pa.string()), ("size", pa.int64()), ("packed", pa.int64())]))
STREAMS = {"doc": "WordDocument", "ppt": "PowerPoint Document"}


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def _members(content: pa.Scalar) -> list[zipfile.ZipInfo]:
    """The members of an archive that is looked at where it lies."""
    try:
        return zipfile.ZipFile(pa.BufferReader(content.as_buffer())).infolist() if content.is_valid else []
    except (zipfile.BadZipFile, OSError, ValueError):
        return []


@arrow_rows("array<struct<name:string,size:long,packed:long>>")
def members(content: pa.Array) -> pa.Array:
    return pa.array([[{"name": m.filename, "size": m.file_size, "packed": m.compress_size} for m in _members(c)] for c in content], MEMBERS)


def _has(content: Column, raw: bytes, within: int) -> Column:
    """Whether bytes occur within the head, a byte a character."""
    return F.locate(raw.decode("latin-1"), F.decode(F.substring(content, 1, within), "ISO-8859-1")) > 0


def detect(content: Column) -> Column:
    """pdf, docx, pptx, doc, ppt, or null for what isn't accepted: empty, too large, or anything else."""
    size = F.length(content)
    zipped = F.hex(F.substring(content, 1, 4)) == "504B0304"
    names = members(F.when(zipped & (size <= MAX_BYTES), content))
    has = lambda prefix: F.exists(names, lambda m: m["name"].startswith(prefix))
    ole = F.hex(F.substring(content, 1, 8)) == OLE
    stream = lambda k: _has(content, STREAMS[k].encode("utf-16-le"), OLE_SCAN)
    return (
        F.when(content.isNull() | (size == 0) | (size > MAX_BYTES), F.lit(None)).when(_has(content, b"%PDF-", HEAD), "pdf")
        .when(zipped & has("word/"), "docx").when(zipped & has("ppt/"), "pptx").when(ole & stream("doc"), "doc").when(ole & stream("ppt"), "ppt")
    )


def unsafe_members(archives: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, name, problem): members that would leave their folder, and those at which the running totals look like a bomb."""
    m = archives.select(path, F.posexplode(members(content)).alias("k", "m")).select(path, "k", "m.*")
    from pyspark.sql import Window

    w = Window.partitionBy(path).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumns({"total": F.sum("size").over(w), "packed_total": F.sum("packed").over(w)})
    parts = F.filter(F.split(F.replace("name", F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a, p: F.struct(
        (a["d"] + F.when(p == "..", -1).otherwise(1)).alias("d"), F.least(a["low"], a["d"] + F.when(p == "..", -1).otherwise(1)).alias("low")))["low"]
    problem = (
        F.when(F.col("name").startswith("/") | (depth < 0), "outside").when(F.col("total") > MAX_BYTES, "too large")
        .when((F.col("packed_total") > 0) & (F.col("total") / F.col("packed_total") > BOMB_RATIO) & (F.col("total") > BOMB_BYTES), "bomb")
    )
    return m.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select(path, "name", "problem")


def safe_name(name: str) -> bool:
    return not name.startswith("/") and not posixpath.normpath(name).startswith("..")
