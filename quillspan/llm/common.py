"""What the operators of this subpackage share: tables, scratch space, folds, fit samples."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager, suppress

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input.  Arrow batches get smaller, where the session has Spark's default: rows here are whole texts."""
    if spark.conf.get(BATCH, "10000") == "10000":
        spark.conf.set(BATCH, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where the session names none (tests on one machine) a temporary folder is taken.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="quillspan-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
        named = sc.getCheckpointDir()
    return named.rstrip("/")


@contextmanager
def dropping_shuffles(spark: SparkSession):
    """Shuffle files of the jobs run inside go when each job ends: nothing reads them again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


#: Paths of stored tables that are still there, with the JVM and the configuration to delete them by.
_made: dict[str, tuple] = {}


def stored(df: DataFrame, what: str = "t", codec: str = "snappy") -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: cuts the lineage, survives lost executors.

    The table goes by `discard`, else with `release` or at the end of the program, as a lazy result may read it until then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspan/{what}-{uuid.uuid4().hex}"
    with dropping_shuffles(spark):
        df.write.parquet(path, compression=codec)
    _made[path] = (spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())
    out = spark.read.schema(df.schema).parquet(path)
    out._quillspan_path = path
    return out


def _delete(path: str) -> None:
    jvm, configuration = _made.pop(path)
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(configuration).delete(p, True)


def discard(*frames: DataFrame) -> None:
    """Delete tables made by stored() that no later result reads."""
    for df in frames:
        path = getattr(df, "_quillspan_path", None)
        if path in _made:
            _delete(path)


def release() -> None:
    """Delete all stored tables that are left: for programs that go on when their results are written."""
    for path in list(_made):
        _delete(path)


@atexit.register
def _release_at_exit() -> None:
    with suppress(Exception):  # the JVM may be gone
        release()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def spread(doc_id: Column, seed: int = 0) -> Column:
    return F.xxhash64(doc_id, F.lit(seed))


def by_label(labels: DataFrame, label: str, modulus: int, held: int) -> DataFrame:
    """(doc_id, y): one row per labelled document outside the held-out fold; of several labels the largest counts."""
    return (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .filter(remainder(F.col("doc_id"), modulus) != held)
        .groupBy("doc_id")
        .agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    )


def pick(ids: DataFrame, n: int, seed: int) -> list:
    """At most n values of doc_id in the order of a hash: a top-k, so that n rows reach the driver."""
    return [r[0] for r in ids.select("doc_id").orderBy(spread(F.col("doc_id"), seed), "doc_id").limit(n).collect()]


def texts_of(docs: DataFrame, ids: list, max_bytes: int) -> dict:
    """doc_id -> whole text for a bounded list of ids; ids beyond max_bytes of text in all are left out.

    The join broadcasts at most len(ids) integers, which the callers bound.
    """
    if not ids:
        return {}
    spark = docs.sparkSession
    small = F.broadcast(spark.createDataFrame([(i,) for i in ids], "doc_id long"))
    found = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(small, "doc_id"), "fit")
    sizes: dict = {}
    for r in found.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("n")).collect():
        sizes[r.doc_id] = r.n
    left, keep = max_bytes, []
    for i in ids:
        if i in sizes and sizes[i] <= left:
            left -= sizes[i]
            keep.append(i)
    out = {}
    if keep:
        chosen = F.broadcast(spark.createDataFrame([(i,) for i in keep], "doc_id long"))
        for r in found.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).collect():
            out[r.doc_id] = r.text
    discard(found)
    return {i: out[i] for i in keep}


def logit_fit(x, y, w, ridge: float = 1e-2, steps: int = 30):
    """Weighted logistic regression by Newton's method; returns (mean, scale, coefficients, intercept)."""
    import numpy as np

    m, s = x.mean(0), x.std(0) + 1e-9
    a = np.c_[(x - m) / s, np.ones(len(x))]
    b = np.zeros(a.shape[1])
    w = w / w.mean()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = a.T @ (w * (p - y)) + ridge * len(x) * 1e-2 * b
        h = (a * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + ridge * len(x) * 1e-2 * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return m, s, b[:-1], b[-1]


def best_cut(z, y, w):
    """The value of z that parts the classes with the least weighted error; midway between neighbours."""
    import numpy as np

    order = np.argsort(z, kind="stable")
    z, y, w = z[order], y[order], w[order]
    right = np.r_[0.0, np.cumsum(w * (y == 0))] + np.r_[np.cumsum((w * (y == 1))[::-1])[::-1], 0.0]
    edge = np.r_[True, z[1:] > z[:-1], True]
    right[~edge] = -1
    top = right.max()
    best = np.flatnonzero(right >= top - 1e-12)
    i = best[len(best) // 2]
    if i == 0:
        return z[0] - 1.0
    if i == len(z):
        return z[-1] + 1.0
    return (z[i - 1] + z[i]) / 2
