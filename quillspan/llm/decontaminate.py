"""Benchmark decontamination with an FM-index per training shard.

A shard is as many documents of a task as fit a bound of tokens.  Its words are
written in the alphabet of the benchmark's words; stretches of words that are
all in the alphabet and at least as long as the shortest window are the
sequence that is indexed (no window can lie anywhere else), with a separator
after each.  All windows are searched backward at once through the wavelet
matrix' ranks, occurrences are located by sampled suffix positions, and their
word spans are merged into removal spans.

The benchmark is the stated query set.  It is sent to executors in blocks of a
bounded number of words; with several blocks, each document goes through one
after the other, which merge their spans.

Edge cases: null and empty texts have no words and no hits; a very long text is a shard of its own, read whole; an item without
words has no window; an item shorter than a window is one window; items that
share an item_id count once; a null item_id counts as the empty string; repeated
rows are searched each; empty tables give no hits or no rows.  Extra columns of
documents are ignored by `spans` and carried along by `clean`; names _words,
_spans and _items are reserved.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table
from .fmindex import FMIndex

WINDOW = 10
#: Words of benchmark text in one block, and tokens of indexed sequence in one shard.
BLOCK_WORDS, SHARD_TOKENS = 500_000, 1_000_000
#: Occurrences located at once.
LOCATE = 1_000_000


def _table() -> bytes:
    """Byte map: A-Z to lower case; 0-9, a-z and bytes from 0x80 stay; the rest separates words."""
    out = bytearray(b" " * 256)
    for a, b in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        out[a : b + 1] = range(a, b + 1)
    out[0x41:0x5B] = range(0x61, 0x7B)
    return bytes(out)


WORDS_MAP = _table()


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS_MAP).split()


def _blocks(items: list[tuple]) -> list[list[tuple]]:
    out, size = [[]], 0
    for item_id, text in items:
        n = len(words(text))
        if out[-1] and size + n > BLOCK_WORDS:
            out.append([])
            size = 0
        out[-1].append((item_id, text))
        size += n
    return out


class Windows:
    """The distinct windows of a block of items in its alphabet, and the items of each."""

    def __init__(self, items: list[tuple]):
        self.alphabet: dict[bytes, int] = {}
        seen: dict[tuple, set] = {}
        for item_id, text in items:
            w = [self.alphabet.setdefault(x, len(self.alphabet) + 2) for x in words(text)]
            name = "" if item_id is None else str(item_id)
            for i in range(max(1, len(w) - WINDOW + 1) if w else 0):
                seen.setdefault(tuple(w[i : i + WINDOW]), set()).add(name)
        keys = list(seen)
        self.items = [sorted(seen[k]) for k in keys]
        self.length = np.array([len(k) for k in keys], dtype=np.int64)
        self.phrase = np.zeros((len(keys), WINDOW), dtype=np.int64)
        for r, k in enumerate(keys):
            self.phrase[r, : len(k)] = k
        self.shortest = int(self.length.min()) if len(keys) else WINDOW

    def encode(self, w: list[bytes]) -> np.ndarray:
        get = self.alphabet.get
        return np.array([get(x, 1) for x in w], dtype=np.int32)


def _stretches(codes: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches of known words that could hold a window."""
    known = codes > 1
    edge = np.flatnonzero(np.diff(np.r_[False, known, False].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    fit = end - start >= shortest
    return list(zip(start[fit].tolist(), end[fit].tolist()))


def search_shard(docs: list[np.ndarray], windows: Windows) -> list[tuple[list[tuple[int, int]], set]]:
    """For each document its merged spans of hit words, and the items with windows in it."""
    parts, begin, owner, offset, at = [], [], [], [], 0
    for d, codes in enumerate(docs):
        for a, b in _stretches(codes, windows.shortest):
            begin.append(at), owner.append(d), offset.append(a)
            parts += [codes[a:b], np.array([1], dtype=np.int32)]
            at += b - a + 1
    out: list[tuple[list[tuple[int, int]], set]] = [([], set()) for _ in docs]
    if not parts or not len(windows.length):
        return out
    index = FMIndex(np.concatenate(parts), len(windows.alphabet) + 2)
    lo, hi = index.ranges(windows.phrase, windows.length)
    found = np.flatnonzero(hi > lo)
    begin, owner, offset = (np.array(x, dtype=np.int64) for x in (begin, owner, offset))
    count = hi[found] - lo[found]
    edge = np.r_[0, np.cumsum(count)]
    hit_doc, hit_start, hit_end = [], [], []
    for first in range(0, int(edge[-1]), LOCATE):
        k = np.arange(first, min(first + LOCATE, int(edge[-1])))
        w = np.searchsorted(edge, k, side="right") - 1
        pos = index.locate(lo[found[w]] + k - edge[w])
        run = np.searchsorted(begin, pos, side="right") - 1
        start = offset[run] + pos - begin[run]
        doc = owner[run]
        hit_doc.append(doc), hit_start.append(start), hit_end.append(start + windows.length[found[w]])
        for d, x in np.unique(np.c_[doc, found[w]], axis=0).tolist():
            out[d][1].update(windows.items[x])
    if hit_doc:
        d, a, b = (np.concatenate(x) for x in (hit_doc, hit_start, hit_end))
        order = np.lexsort((a, d))
        for dd, aa, bb in zip(d[order].tolist(), a[order].tolist(), b[order].tolist()):
            s = out[dd][0]
            if s and aa <= s[-1][1]:
                s[-1] = (s[-1][0], max(s[-1][1], bb))
            else:
                s.append((aa, bb))
    return out


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted([*a, *b]):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], y))
        else:
            out.append((x, y))
    return out


SPANS = "_words long, _spans array<struct<start:int,stop:int>>, _items array<string>"
_TYPES = [pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.list_(pa.string())]


def _search(windows: Windows, text_at: int, width: int, later: bool):
    """Adds _words, _spans and _items to each row; later blocks merge into those columns."""

    def run(batches):
        held, codes, size = [], [], 0

        def flush():
            nonlocal held, codes, size
            at = 0
            found = search_shard([c for c in codes], windows)
            for b in held:
                mine = found[at : at + b.num_rows]
                n = [len(c) for c in codes[at : at + b.num_rows]]
                at += b.num_rows
                spans, items = [x[0] for x in mine], [x[1] for x in mine]
                if later:
                    spans = [_merged([(s["start"], s["stop"]) for s in old], new) for old, new in zip(b.column(width + 1).to_pylist(), spans)]
                    items = [set(old) | new for old, new in zip(b.column(width + 2).to_pylist(), items)]
                cols = [n, [[{"start": x, "stop": y} for x, y in s] for s in spans], [sorted(i) for i in items]]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(width)), *(pa.array(c, t) for c, t in zip(cols, _TYPES))], names=[*b.schema.names[:width], "_words", "_spans", "_items"])
            held, codes, size = [], [], 0

        for big in batches:
            for first in range(0, big.num_rows, 500):
                b = big.slice(first, 500)
                new = [windows.encode(words(t.as_py())) for t in b.column(text_at)]
                held.append(b)
                codes += new
                size += sum(len(c) for c in new)
                if size >= SHARD_TOKENS:
                    yield from flush()
        if held:
            yield from flush()

    return run


def spans(docs: DataFrame, bench: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns of carry, text among them) with _words, _spans (word offsets) and _items."""
    found = bench.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    # the stated query set, read once by the driver, block by block
    blocks = _blocks(sorted(((r.item_id, r.text) for r in found.toLocalIterator()), key=lambda x: (x[0] or "", x[1])))
    cols = carry or ["doc_id", "text"]
    d = docs.select(*cols)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema) + ", " + SPANS
    for k, block in enumerate(blocks):
        d = d.mapInArrow(_search(Windows(block), cols.index("text"), len(cols), k > 0), schema)
    return d


def clean(docs: DataFrame, bench: DataFrame, cut: bool = True) -> DataFrame:
    """docs without benchmark passages: hit words are cut out of the text, or (cut=False) documents with any go."""
    cols = docs.columns
    found = spans(docs, bench, cols)
    if not cut:
        return found.filter(F.size("_spans") == 0).select(*cols)
    return found.withColumn("text", F.when(F.size("_spans") == 0, F.col("text")).otherwise(_without(F.col("text"), F.col("_spans")))).select(*cols)


def cut_spans(text: str, removed: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; what separates the remaining words stays."""
    raw = text.encode("utf-8", "surrogatepass")
    flat = raw.translate(WORDS_MAP)
    edge = np.flatnonzero(np.diff(np.r_[32, np.frombuffer(flat, np.uint8), 32].__ne__(32).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    out, at = [], 0
    for a, b in removed:
        out.append(raw[at : start[a]])
        at = end[b - 1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def _without(text: Column, removed: Column) -> Column:
    return F.pandas_udf(_cut_all, "string")(text, removed)


def _cut_all(text: pd.Series, removed: pd.Series) -> pd.Series:
    return pd.Series([cut_spans(t, [(s["start"], s["stop"]) for s in r]) if t and len(r) else t for t, r in zip(text, removed)])


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, s: a + (s["stop"] - s["start"]).cast("long"))
    return found.select("doc_id", F.col("_words").alias("n_words"), n_hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (F.size("_spans") > 0).alias("contaminated"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Windows of documents, of every length that an item's window has, against those of the benchmark.
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS name, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), q AS (
  SELECT DISTINCT name, least(len(w), {WINDOW}) AS n, unnest(list_transform(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1), lambda k: array_to_string(w[k:k + {WINDOW - 1}], ' '))) AS g FROM i WHERE len(w) > 0
), l AS (
  SELECT DISTINCT n FROM q
), x AS (
  SELECT row, n, unnest(range(1, len(w) - n + 2)) AS k, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS g FROM d, l WHERE len(w) >= n
), h AS (
  SELECT x.row, x.k, x.n, q.name FROM x JOIN q ON x.n = q.n AND x.g = q.g
), c AS (
  SELECT row, count(DISTINCT spot) AS n_hit FROM (SELECT row, unnest(range(k, k + n)) AS spot FROM h) GROUP BY row
), t AS (
  SELECT row, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT row, name FROM h) GROUP BY row
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.names, '')) AS items_sha256, c.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c ON d.row = c.row LEFT JOIN t ON d.row = t.row
"""
