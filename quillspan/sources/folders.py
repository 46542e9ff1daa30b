"""Files of many documents as a Spark data source: tasks write them, one commit shows them, tasks read them again.

Writing (format "document_files") goes in two phases.  Each attempt of a task writes its files and an index of them into a folder of
its own; only its name, count and bytes travel to the driver.  When all tasks are done, the driver puts one manifest in place that
lists the attempts that count: files of failed, repeated or unfinished attempts are in no manifest and are removed.  Nothing is
moved, so a commit takes the same time for ten files and for ten million.  An overwrite's manifest also names the jobs that it
replaces.  If a task fails for good, the job's folder goes and the folder reads as before.

Reading plans partitions by bytes: from the manifests (a line for each writing task), or else from the folder's list of files.  A
file that can't be read is a row with the reason.  Work that no asked column needs isn't done: give the schema with only the columns
you want; filters on doc_id skip files where spark.sql.python.filterPushdown.enabled is set.

The path must lead to the same folder on driver and executors.

Edge cases: a document without an id, or without content, fails the job, as an empty file would; ids that repeat get files of their own;
any id makes a safe file name (percent signs for what isn't a letter, digit, point or dash; long ones by digest); no rows make an empty, readable folder.
"""

from __future__ import annotations

import atexit
import hashlib
import json
import os
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .office import RAW, elements

FORMAT = "document_files"
MANIFEST, INDEX = "_committed-", "_index"
LONGEST_NAME = 150
#: Bytes that a reading task takes, and what opening a file counts besides its bytes.
PARTITION_BYTES, OPEN_BYTES = 32 * 1024 * 1024, 16 * 1024
WHOLE = {"binary": "doc_id string, path string, bytes long, content binary", "text": "doc_id string, path string, bytes long, value string"}
PARSED = ("docx", "pptx")


def local(path: str) -> str:
    """The path as the operating system names it."""
    if path.startswith("file:"):
        return "/" + unquote(path[5:]).lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: a folder that driver and executors mount is needed")
    return path


def file_name(doc_id: str) -> str:
    name = quote(doc_id, safe="").replace("~", "%7E")
    name = "%2E" + name[1:] if name.startswith(".") else "%5F" + name[1:] if name.startswith("_") else name
    return name if len(name) <= LONGEST_NAME else hashlib.sha256(doc_id.encode()).hexdigest()


def _put_json(path: str, value) -> None:
    fd, part = tempfile.mkstemp(dir=os.path.dirname(path), prefix=".")
    with os.fdopen(fd, "w") as f:
        json.dump(value, f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int
    bytes: int


def manifests(path: str) -> dict[str, dict]:
    """job -> manifest of the jobs that count: committed, and not replaced by a later overwrite."""
    found = {}
    for name in sorted(os.listdir(path)) if os.path.isdir(path) else ():
        if name.startswith(MANIFEST):
            with open(f"{path}/{name}") as f:
                found[name.removeprefix(MANIFEST)] = json.load(f)
    gone = {j for m in found.values() for j in m["replaces"]}
    return {j: m for j, m in found.items() if j not in gone}


class FolderWriter(DataSourceArrowWriter):
    def __init__(self, path: str, suffix: str, schema: StructType, overwrite: bool):
        self.path, self.suffix, self.overwrite, self.job = path, suffix, overwrite, uuid.uuid4().hex
        missing = {"doc_id", "content"} - set(schema.names)
        if missing:
            raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
        os.makedirs(f"{path}/{self.job}")  # here, on the driver: a task that starts after the job was given up finds no place

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        folder = f"{self.path}/{self.job}/{name}"
        os.mkdir(folder)
        try:
            return Written(name, *self._written(iterator, folder))
        except BaseException:
            shutil.rmtree(folder, ignore_errors=True)
            raise

    def _written(self, iterator: Iterator[pa.RecordBatch], folder: str) -> tuple[int, int]:
        taken: dict[str, int] = {}
        files = size = 0
        with open(f"{folder}/{INDEX}", "w") as index:
            for batch in iterator:
                for doc_id, content in zip(batch.column("doc_id"), batch.column("content")):
                    doc_id, content = doc_id.as_py(), content.as_py()
                    data = content.encode() if isinstance(content, str) else content
                    if doc_id is None or not data:
                        raise ValueError(f"document {doc_id}: nothing to write")
                    stem = file_name(str(doc_id))
                    taken[stem] = taken.get(stem, 0) + 1
                    file = (stem if taken[stem] == 1 else f"{stem}~{taken[stem]}") + self.suffix
                    with open(f"{folder}/{file}", "xb") as f:
                        f.write(data)
                    index.write(json.dumps([str(doc_id), file, len(data)]) + "\n")
                    files, size = files + 1, size + len(data)
            index.flush()
            os.fsync(index.fileno())
        return files, size

    def commit(self, messages: list) -> None:
        parts = sorted([m.folder, m.files, m.bytes] for m in messages if m is not None)
        before = manifests(self.path)
        _put_json(f"{self.path}/{MANIFEST}{self.job}", {"parts": parts, "replaces": sorted(before) if self.overwrite else []})
        kept = {p[0] for p in parts}
        for name in os.listdir(f"{self.path}/{self.job}"):
            if name not in kept:
                shutil.rmtree(f"{self.path}/{self.job}/{name}", ignore_errors=True)
        for job in before if self.overwrite else ():
            # files first: while its manifest stands, the job is known as replaced
            shutil.rmtree(f"{self.path}/{job}", ignore_errors=True)
            os.unlink(f"{self.path}/{MANIFEST}{job}")

    def abort(self, messages: list) -> None:
        """The job's folder goes; tasks that are being stopped may still write for a moment."""
        for _ in range(100):
            shutil.rmtree(f"{self.path}/{self.job}", ignore_errors=True)
            if not os.path.exists(f"{self.path}/{self.job}"):
                break
            time.sleep(0.1)


@dataclass
class Files(InputPartition):
    """Parts of written folders (folder, first file, last file), or files (path, bytes) of a folder that something else wrote."""

    spans: list
    files: list

    def __post_init__(self):
        super().__init__(None)


class FolderReader(DataSourceReader):
    def __init__(self, path: str, kind: str, most: int, schema: StructType):
        self.path, self.kind, self.most, self.names, self.ids = path, kind, most, schema.names, None

    def partitions(self) -> list[Files]:
        """Spans of at most `most` bytes: a large part is divided by its count of files, small ones go together."""
        jobs = manifests(self.path)
        pieces = []
        for job, m in sorted(jobs.items()):
            for name, files, size in m["parts"]:
                n = min(files, -(-(size + files * OPEN_BYTES) // self.most))
                pieces += [((f"{self.path}/{job}/{name}", files * k // n, files * (k + 1) // n), None, (size + files * OPEN_BYTES) // n) for k in range(n)]
        if not jobs:
            for top, folders, names in os.walk(self.path):
                folders[:] = sorted(d for d in folders if not d.startswith((".", "_")))
                for name in sorted(names):
                    if not name.startswith((".", "_")) and (self.kind in WHOLE or name.lower().endswith("." + self.kind)):
                        size = os.path.getsize(f"{top}/{name}")
                        pieces.append((None, (f"{top}/{name}", size), size + OPEN_BYTES))
        out, room = [], 0
        for span, file, size in pieces:
            if not out or size > room:
                out.append(Files([], []))
                room = self.most
            room -= size
            out[-1].spans.extend([span] * (span is not None))
            out[-1].files.extend([file] * (file is not None))
        return out or [Files([], [])]

    def _files(self, part: Files) -> Iterator[tuple]:
        for folder, first, last in part.spans:
            with open(f"{folder}/{INDEX}") as index:
                for k, line in enumerate(index):
                    if first <= k < last:
                        doc_id, name, size = json.loads(line)
                        yield doc_id, f"{folder}/{name}", size
        for path, size in part.files:
            yield unquote(os.path.splitext(os.path.basename(path))[0]), path, size

    def read(self, partition: Files):
        for doc_id, path, size in self._files(partition):
            if self.ids is None or doc_id in self.ids:
                yield from self._rows(doc_id, path, size)

    def _rows(self, doc_id: str, path: str, size: int):
        if self.kind in PARSED:
            for row in elements(self.kind, doc_id, lambda: _content(path), set(self.names)):
                yield tuple(row[n] for n in self.names)
        else:
            row = {"doc_id": doc_id, "path": path, "bytes": size}
            if "content" in self.names:
                row["content"] = _content(path)
            if "value" in self.names:
                row["value"] = _content(path).decode("utf-8", "replace")
            yield tuple(row[n] for n in self.names)


class FilteringReader(FolderReader):
    """Opens only the files of the documents asked for; Spark refuses it where filter pushdown is off."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("doc_id",):
                ids = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.ids = ids if self.ids is None else self.ids & ids
            else:
                yield f


def _content(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class DocumentFiles(DataSource):
    """Options: path; kind (reading: binary, text, docx or pptx); suffix (writing); partitionBytes (reading)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _path(self) -> str:
        return local(self.options["path"]).rstrip("/")

    def schema(self) -> str:
        kind = self.options.get("kind", "binary")
        if kind not in (*WHOLE, *PARSED):
            raise ValueError(f"kind is one of {', '.join((*WHOLE, *PARSED))}")
        return WHOLE.get(kind, RAW)

    def reader(self, schema: StructType) -> FolderReader:
        made = FilteringReader if self.options.get("pushdown") == "true" else FolderReader
        return made(self._path(), self.options.get("kind", "binary"), int(self.options.get("partitionBytes", PARTITION_BYTES)), schema)

    def writer(self, schema: StructType, overwrite: bool) -> FolderWriter:
        return FolderWriter(self._path(), self.options.get("suffix", ""), schema, overwrite)


def write_files(files: DataFrame, path: str, suffix: str = "", mode: str = "append") -> None:
    """files (doc_id, content: binary or string) written under path, all or none."""
    files.sparkSession.dataSource.register(DocumentFiles)
    files.selectExpr("cast(doc_id as string) as doc_id", "content").write.format(FORMAT).option("suffix", suffix).mode(mode).save(path)


def read_files(spark: SparkSession, path: str, kind: str = "binary", columns: str | None = None, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The files under path, or the elements of its office files; columns: a schema with those that are wanted."""
    spark.dataSource.register(DocumentFiles)
    r = spark.read.format(FORMAT).option("kind", kind).option("partitionBytes", partition_bytes).option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    return (r.schema(columns) if columns else r).load(path)


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder that driver and executors share, below the session's checkpoint folder; it goes when the program ends."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    top = local(named) if named else tempfile.mkdtemp(prefix="quillspan-")
    path = f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    os.makedirs(path)
    atexit.register(shutil.rmtree, path if named else top, ignore_errors=True)
    return path
