"""N-gram Jaccard join: a blocked sparse product of the document by shingle incidence.

A document's set holds the 64-bit hashes of its distinct five-word shingles.
Documents with equal sets form a class.  Two classes link when
100 * overlap >= 80 * union; the result is the connected components.

1.  Bound by size.  Sets of sizes n and m link only with an overlap of at least
    ceil(0.8 * max(n, m)); so of the n - ceil(0.8 n) + k smallest hashes of
    either, at least k are common.  With k = n / 10 this leaves about a third
    of the shingles to be matched across documents, and only classes go on that
    have as many matched ones as their smallest possible partner asks for.
2.  Of these the whole sets are made, and in how many sets each hash is.  Only
    classes go on of whose hashes four fifths are shared; their prefix is the
    n - ceil(0.8 n) + 1 rarest hashes, which hold a common one with every
    partner.  Classes connected by prefix hashes are a candidate group.
3.  Within a candidate group, blocks of classes are multiplied, documents by
    shingles: products of one range of incidence columns after the other add up overlap counts,
    until no pair of a tile can reach the overlap that its sizes ask for; pairs below that bound
    are discarded, and each block keeps a spanning forest of its links.  Blocks
    are numbered by steps of set size, as many to a step as its classes ask for.  In
    large groups neighbouring blocks by size are multiplied first; then only
    classes outside the group's largest component meet those of other blocks
    that they share a prefix hash with.  No pair becomes a row and no link between
    components is lost.

A hash that many documents hold is settled inside each task: a task sends one
row for it, whatever the number of its documents that hold it.

Edge cases: null or empty texts have an empty set and link with nothing, not
even each other; fewer than five words make one shingle; very long texts are read whole and may fill a block alone; repeated rows belong
to one class; a null doc_id takes part but is never a component's id; a pair exactly at the bound links; an empty
table gives an empty result.  Extra columns are ignored.  Sets and classes are
told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import discard, partitions, stored, table
from .graph import components, local_labels

WORDS = 5
PERCENT = 80
#: Classes in a block, and incidence entries in a block at most (one set may exceed it alone).
BLOCK, BLOCK_ENTRIES = 2048, 1_500_000
#: Ratio of one step of set size to the next: no set links with one two steps away.
STEP = 1.25
#: Incidence columns, and documents on either side, of one product; links that are gathered before a forest stands for them.
COLUMNS, TILE, GATHER = 2048, 512, 1_000_000
#: Entries that a task gathers before it settles them.
FLUSH = 1_000_000
#: Percent of a set that must be matched among its first hashes.
FIRST = 10
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known, digest = self.known, xxhash.xxh3_64_intdigest
        if len(known) > 200_000:
            known.clear()
        out = []
        for w in words:
            v = known.get(w)
            if v is None:
                v = known[w] = digest(w)
            out.append(v)
        a = np.array(out, dtype=np.uint64)
        if len(a) < WORDS:
            return np.array([digest(bytes([len(a)]) + a.tobytes())], dtype=np.uint64)
        n = len(a) - WORDS + 1
        h = np.zeros(n, np.uint64)
        for k in range(WORDS):
            h = (h ^ a[k : k + n]) * _MIX[k]
            h ^= h >> np.uint64(29)
        return np.unique(h)


def need(n):
    """Least overlap of a set of size n with any set that it links with."""
    return (PERCENT * n + 99) // 100


def first_hashes(n: int) -> int:
    """How many of the smallest hashes hold FIRST percent of n common ones with any set that links."""
    return n - need(n) + max(1, n * FIRST // 100)


def _class_of(h: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(h.tobytes()), dtype=np.uint64).view(np.int64))


def _settle(h: np.ndarray, c: np.ndarray):
    """Of entries (hash, class): hashes of one class here; hashes of several; and per class how many of the latter."""
    order = np.lexsort((c, h))
    h, c = h[order], c[order]
    fresh = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
    h, c = h[fresh], c[fresh]
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    count = np.diff(np.r_[start, len(h)])
    many = np.repeat(count > 1, count)
    cls, n = np.unique(c[many], return_counts=True)
    return h[~many], c[~many], h[start[count > 1]], cls, n


KIND = "kind int, key long, class long, v long, t long, packed binary"


def _rows(kind: int, key, cls, v, packed: list | None = None, t=0) -> pa.RecordBatch:
    n = len(key)
    full = lambda x: x if isinstance(x, pa.Array) else pa.array(np.broadcast_to(np.asarray(x, dtype=np.int64), n))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), full(key), full(cls), full(v), full(t), pa.array(packed or [None] * n, pa.binary())], names=["kind", "key", "class", "v", "t", "packed"])


def _counted(cls: np.ndarray, n: np.ndarray, parts: int):
    """Counts by class, packed into a row for each part of the classes: as many rows as parts, not as classes."""
    part = cls % parts
    order = np.argsort(part, kind="stable")
    cls, n, edge = cls[order], n[order], np.searchsorted(part[order], np.arange(parts + 1))
    full = np.flatnonzero(np.diff(edge))
    if len(full):
        yield _rows(MATCHED, full, 0, 0, [cls[edge[k] : edge[k + 1]].tobytes() + n[edge[k] : edge[k + 1]].astype(np.int64).tobytes() for k in full])


def _added(batches):
    """(class, hits): the packed counts of this task's parts, added up."""
    cls, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for b in batches:
        for x in b.column(0):
            v = np.frombuffer(x.as_py(), dtype=np.int64)
            cls.append(v[: len(v) // 2]), n.append(v[len(v) // 2 :])
    c, at = np.unique(np.concatenate(cls), return_inverse=True)
    hits = np.bincount(at, weights=np.concatenate(n), minlength=len(c)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(hits)], names=["class", "hits"])


SINGLE, SEVERAL, MATCHED, DOCUMENT = range(4)


def _settled(hs: list, cs: list, parts: int):
    if hs:
        h, c, several, cls, n = _settle(np.concatenate(hs), np.concatenate(cs))
        yield _rows(SINGLE, h.view(np.int64), c, 0)
        yield _rows(SEVERAL, several.view(np.int64), 0, 0)
        yield from _counted(cls, n, parts)


def _emit(batches, parts: int):
    """Documents with their class and size; hashes to be matched, settled within the task as far as it goes."""
    shingle = Shingler()
    hs, cs, held = [], [], 0

    for b in batches:
        ids, cls, size = [], [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1)):
            s = shingle(t.as_py())
            n = len(s)
            c = _class_of(s) if n else 0
            ids.append(i), cls.append(c), size.append(n)
            if n:
                hs.append(s[: first_hashes(n)])
                cs.append(np.full(len(hs[-1]), c, np.int64))
                held += len(hs[-1])
                if held >= FLUSH:
                    yield from _settled(hs, cs, parts)
                    hs, cs, held = [], [], 0
        yield _rows(DOCUMENT, pa.array(ids, pa.int64()), np.array(cls, np.int64), np.array(size, np.int64), t=b.column(2))
    yield from _settled(hs, cs, parts)


def _match(batches, parts: int):
    """Per class, how many of its hashes another class holds, as far as this task's hashes go."""
    hs, cs, several = [], [], []
    for b in batches:
        kind = b.column(0).to_numpy()
        keep = np.flatnonzero(kind >= MATCHED)
        if len(keep):
            yield b.take(pa.array(keep))
        one = b.take(pa.array(np.flatnonzero(kind == SINGLE)))
        hs.append(one.column(1).to_numpy())
        cs.append(one.column(2).to_numpy())
        several.append(b.take(pa.array(np.flatnonzero(kind == SEVERAL))).column(1).to_numpy())
    if hs:
        h, c, s = np.concatenate(hs), np.concatenate(cs), np.unique(np.concatenate(several))
        elsewhere = np.isin(h, s)
        _, _, _, cls, n = _settle(h[~elsewhere], c[~elsewhere]) if (~elsewhere).any() else (None, None, None, np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield from _counted(cls, n, parts)
        yield from _counted(*np.unique(c[elsewhere], return_counts=True), parts)


def _sets(batches):
    shingle = Shingler()
    for b in batches:
        out = []
        for c, t in zip(b.column(0).to_pylist(), b.column(1)):
            s = shingle(t.as_py())
            if len(s) and _class_of(s) == c:  # another row of that doc_id may hold another text
                out.append((c, len(s), s.tobytes()))
        if out:
            c, n, h = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(n, pa.int64()), pa.array(h, pa.binary())], names=["class", "n", "hashes"])


def _by_part(hashes: list[np.ndarray], parts: int):
    """Distinct hashes of a chunk in order of part, their counts, where each part begins, and for each entry its hash."""
    u, at, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    part = ((u >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return u[order], count[order], np.searchsorted(part[order], np.arange(parts + 1)), place[at]


def _held(group: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), dtype=np.uint64) for x in group.column("hashes")]


ASKED = "part int, chunk int, hashes binary, counts binary"


def _asking(parts: int):
    def run(group: pa.Table) -> pa.Table:
        """A chunk's distinct hashes and in how many of its sets each is, packed for each part of the hashes."""
        u, n, edge, _ = _by_part(_held(group), parts)
        full = np.flatnonzero(np.diff(edge))
        cut = lambda v, t: pa.array([v[edge[k] : edge[k + 1]].astype(t).tobytes() for k in full], pa.binary())
        return pa.table({"part": pa.array(full, pa.int32()), "chunk": pa.array([group.column("chunk")[0].as_py()] * len(full), pa.int32()), "hashes": cut(u, np.uint64), "counts": cut(n, np.uint32)})

    return run


REPLY = "chunk int, part int, sets binary"


def _replying(group: pa.Table) -> pa.Table:
    """For each chunk, in how many sets of all chunks its hashes of this part are."""
    h = _held(group)
    u, at = np.unique(np.concatenate(h), return_inverse=True)
    n = np.bincount(at, weights=np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint32) for x in group.column("counts")]), minlength=len(u))
    reply = np.split(n[at].astype(np.uint32), np.cumsum([len(x) for x in h])[:-1])
    return pa.table({"chunk": group.column("chunk"), "part": group.column("part"), "sets": pa.array([x.tobytes() for x in reply], pa.binary())})


PREFIX = "class long, n long, prefix binary"


def _prefixes(parts: int):
    def run(sets: pa.Table, replies: pa.Table) -> pa.Table:
        """Of classes with enough shared hashes the rarest ones, as many as hold a common one with every partner."""
        cls, out = sets.column("class").to_pylist() if sets.num_rows else [], []
        if cls:
            h = _held(sets)
            u, _, edge, at = _by_part(h, parts)
            total = np.zeros(len(u), dtype=np.uint32)
            for p, x in zip(replies.column("part").to_pylist(), replies.column("sets")):
                total[edge[p] : edge[p + 1]] = np.frombuffer(x.as_py(), dtype=np.uint32)
            for c, s, n in zip(cls, h, np.split(total[at], np.cumsum([len(x) for x in h])[:-1])):
                if (n > 1).sum() >= need(len(s)):
                    order = np.lexsort((s, n))[: len(s) - need(len(s)) + 1]
                    out.append((c, len(s), s[order[n[order] > 1]].tobytes()))
        c, n, x = zip(*out) if out else ((), (), ())
        return pa.table({"class": pa.array(c, pa.int64()), "n": pa.array(n, pa.int64()), "prefix": pa.array(x, pa.binary())})

    return run


def _linking(batches):
    """Edges between classes with a common hash in their prefix here, and one (hash, class) for each hash."""
    hs, cs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for b in batches:
        for c, x in zip(b.column(0).to_pylist(), b.column(1)):
            hs.append(np.frombuffer(x.as_py(), dtype=np.int64))
            cs.append(np.full(len(hs[-1]), c, np.int64))
    yield from _forest(np.concatenate(hs), np.concatenate(cs))


def _postings(batches):
    """(hash, grp, block, class) for the prefix of each class."""
    for b in batches:
        for g, k, c, x in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
            s = np.frombuffer(x.as_py(), dtype=np.int64)
            full = lambda v, t: pa.array(np.full(len(s), v, t))  # noqa: E731,B023
            yield pa.RecordBatch.from_arrays([pa.array(s), full(g, np.int64), full(k, np.int32), full(c, np.int64)], names=["h", "grp", "block", "class"])


def _forest(h: np.ndarray, c: np.ndarray):
    """Rows (0, hash, a class with it) and spanning edges (1, class, smallest connected class)."""
    if not len(h):
        return
    order = np.lexsort((c, h))
    h, c = h[order], c[order]
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    lead = np.repeat(c[start], np.diff(np.r_[start, len(h)]))
    apart = lead != c
    if apart.any():
        nodes, label = local_labels(c[apart], lead[apart])
        off = nodes != label
        yield _pairs(1, nodes[off], label[off])
    yield _pairs(0, h[start], c[start])


def _pairs(kind: int, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])


def _meet(batches):
    """Edges among classes that hold a hash in different tasks."""
    hs, cs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for b in batches:
        kind = b.column(0).to_numpy()
        yield b.take(pa.array(np.flatnonzero(kind == 1)))
        hs.append(b.column(1).to_numpy()[kind == 0])
        cs.append(b.column(2).to_numpy()[kind == 0])
    for out in _forest(np.concatenate(hs), np.concatenate(cs)):
        yield out.take(pa.array(np.flatnonzero(out.column(0).to_numpy() == 1)))


def block_links(cls: np.ndarray, side: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the links between the classes of side 0 and of side 1 (side 2: both)."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    doc = np.repeat(np.arange(len(sets)), size)
    _, col = np.unique(np.concatenate(sets), return_inverse=True)
    # a document can link only if enough of its columns have an entry on the other side; those that can't go, and
    # with them their entries, until all that are left could
    while True:
        n = int(col.max()) + 1 if len(col) else 0
        on = side[doc]
        a, b = np.bincount(col[on != 1], minlength=n), np.bincount(col[on != 0], minlength=n)
        met = np.where(on == 0, b[col] > 0, np.where(on == 1, a[col] > 0, a[col] > 1))
        doc, col = doc[met], col[met]
        able = np.bincount(doc, minlength=len(sets)) >= need(size)
        stay = able[doc]
        if stay.all():
            break
        doc, col = doc[stay], col[stay]
    if not len(col):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, col = np.unique(col, return_inverse=True)
    i, j = _product(doc, col, np.flatnonzero((side != 1) & able), np.flatnonzero((side != 0) & able), size)
    apart = i != j
    if not apart.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    nodes, label = local_labels(cls[i[apart]], cls[j[apart]])
    off = nodes != label
    return nodes[off], label[off]


def _links(overlap, a, b):
    return (100 * overlap >= PERCENT * (a + b - overlap)) & (overlap >= need(np.maximum(a, b)))


class _Incidence:
    """Rows (documents) of a block's incidence matrix, by document, each with its columns in order."""

    def __init__(self, doc: np.ndarray, col: np.ndarray, n: int):
        order = np.lexsort((col, doc))
        self.doc, self.col = doc[order], col[order]
        self.edge = np.searchsorted(self.doc, np.arange(n + 1))

    def entries(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among `which`, column) of their entries."""
        n = self.edge[which + 1] - self.edge[which]
        at = np.repeat(self.edge[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(np.arange(len(which)), n), self.col[at]


def _dense(row: np.ndarray, place: np.ndarray, rows: int, first: int, last: int) -> np.ndarray:
    """A range of columns as a matrix of 0 and 1."""
    m = np.zeros((rows, last - first), dtype=np.float32)
    on = (place >= first) & (place < last)
    m[row[on], place[on] - first] = 1
    return m


def _tile(x: tuple, y: tuple, nx: int, ny: int, least: np.ndarray) -> np.ndarray:
    """Overlaps of two tiles' documents, given by their entries: products of one range of common columns after the other added up.

    It ends early where no pair can reach its least overlap any more.
    """
    common = np.intersect1d(x[1], y[1])
    place = lambda c: np.searchsorted(common, c)
    keep = [np.isin(t[1], common) for t in (x, y)]
    (ri, ci), (rj, cj) = ((t[0][k], place(t[1][k])) for t, k in zip((x, y), keep))
    left_i, left_j = np.bincount(ri, minlength=nx).astype(np.float32), np.bincount(rj, minlength=ny).astype(np.float32)
    overlap = np.zeros((nx, ny), dtype=np.float32)
    for first in range(0, len(common), COLUMNS):
        if not (overlap + np.minimum(left_i[:, None], left_j[None, :]) >= least).any():
            break
        a, b = (_dense(r, c, n, first, min(first + COLUMNS, len(common))) for r, c, n in ((ri, ci, nx), (rj, cj, ny)))
        overlap += a @ b.T
        left_i -= a.sum(1)
        left_j -= b.sum(1)
    return overlap


def _product(doc, col, left, right, size):
    """All linked pairs of documents `left` and `right`: the blocked product of their incidence, tile by tile of like sizes."""
    rows = _Incidence(doc, col, len(size))
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    left, right = left[np.argsort(size[left], kind="stable")], right[np.argsort(size[right], kind="stable")]
    tiles = [right[k : k + TILE] for k in range(0, len(right), TILE)]
    held = [rows.entries(t) for t in tiles]
    same = np.array_equal(left, right)  # a block with itself: each pair of tiles once
    for number, k in enumerate(range(0, len(left), TILE)):
        x = left[k : k + TILE]
        own = rows.entries(x)
        for y, other in list(zip(tiles, held))[number if same else 0 :]:
            if size[y[0]] * PERCENT > 100 * size[x[-1]] or size[x[0]] * PERCENT > 100 * size[y[-1]]:
                continue
            a, b = size[x][:, None], size[y][None, :]
            overlap = _tile(own, other, len(x), len(y), need(np.maximum(a, b)))
            i, j = np.nonzero(_links(overlap, a, b))
            found_i.append(x[i]), found_j.append(y[j])
            if sum(map(len, found_i)) > GATHER:  # a spanning forest stands for the links so far
                n, lab = local_labels(np.concatenate(found_i), np.concatenate(found_j))
                found_i, found_j = [n], [lab]
    return np.concatenate(found_i), np.concatenate(found_j)


def _products(batches):
    """Rows come sorted by task; each task's classes are multiplied when its rows are complete."""
    held, now = [], None

    def flush():
        if len(held) > 1:
            cls = np.array([x[0] for x in held], np.int64)
            a, b = block_links(cls, np.array([x[1] for x in held]), [np.frombuffer(x[2], dtype=np.uint64) for x in held])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for b in batches:
        g, i, j, c, side, h = (b.column(k) for k in range(6))
        for key, cc, s, x in zip(zip(g.to_pylist(), i.to_pylist(), j.to_pylist()), c.to_pylist(), side.to_pylist(), h):
            if key != now:
                yield from flush()
                held, now = [], key
            held.append((cc, s, x.as_py()))
    yield from flush()


def _multiply(tasks: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """tasks(grp, i, j, class, side) -> spanning edges (a, b)."""
    rows = tasks.join(sets.select("class", "hashes"), "class").select("grp", "i", "j", "class", "side", "hashes")
    return rows.repartition(n, "grp", "i", "j").sortWithinPartitions("grp", "i", "j").mapInArrow(_products, "a long, b long")


def _blocks(members: DataFrame) -> DataFrame:
    """members(grp, class, n) with their block within the group: blocks follow steps of size, and within a step a hash of the class."""
    m = members.withColumn("step", F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(STEP)))).cast("int"))
    step = m.groupBy("grp", "step").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_ENTRIES)).cast("int").alias("parts"))
    earlier = Window.partitionBy("grp").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    step = step.withColumn("first", F.coalesce(F.sum("parts").over(earlier), F.lit(0)))
    at = F.pmod(F.xxhash64("class", F.lit(5)), F.col("parts"))
    return m.join(step, ["grp", "step"]).withColumn("block", (F.col("first") + at).cast("int")).select(*members.columns, "block")


def _task_rows(pairs: DataFrame, blocks_i: DataFrame, blocks_j: DataFrame) -> DataFrame:
    left = pairs.join(blocks_i.select("grp", F.col("block").alias("i"), "class"), ["grp", "i"]).withColumn("side", F.when(F.col("i") == F.col("j"), 2).otherwise(0))
    right = pairs.filter("i != j").join(blocks_j.select("grp", F.col("block").alias("j"), "class"), ["grp", "j"]).withColumn("side", F.lit(1))
    return left.select("grp", "i", "j", "class", "side").union(right.select("grp", "i", "j", "class", "side"))


def _ranges(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("grp", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))


def _matched(found: DataFrame, classes: DataFrame) -> DataFrame:
    """Classes with as many matched hashes as their smallest possible partner has to find."""
    packed = found.filter(F.col("kind") == MATCHED).select("key", "packed").repartition(partitions(found.sparkSession), "key")
    hits = packed.select("packed").mapInArrow(_added, "class long, hits long")
    least = F.floor(F.floor((F.col("n") * PERCENT + 99) / 100) * FIRST / 100)
    return classes.join(hits, "class").filter(F.col("hits") >= F.greatest(F.lit(1), least))


def link_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, class, label): each row's class and the label of its class's component."""
    spark = docs.sparkSession
    n = partitions(spark)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("t"))
    found = stored(text.mapInArrow(lambda b: _emit(b, n), KIND).repartition(n, "key").mapInArrow(lambda b: _match(b, n), KIND), "match")
    docs_t = found.filter(F.col("kind") == DOCUMENT).select(F.col("key").alias("doc_id"), "class", F.col("v").alias("n"), "t")
    # one document stands for a class: known by doc_id and text, as several rows may share either
    each = docs_t.filter("n > 0").groupBy("class", "doc_id", "t").agg(F.count("*").alias("rows"), F.max("n").alias("n"))
    classes = each.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "t", "rows")).alias("rep"), F.max("n").alias("n"))
    alive = stored(_matched(found, classes).select("class", F.col("rep.doc_id").alias("rep"), F.col("rep.t").alias("rep_t"), F.col("rep.rows").alias("rows")), "alive")
    right = alive.hint("shuffle_hash")
    reps = text.join(right, text["doc_id"].eqNullSafe(right["rep"]) & (text["t"] == right["rep_t"])).select("class", "text", "rows")
    once = reps.filter("rows = 1").select("class", "text")
    reps = once.union(reps.filter("rows > 1").select("class", "text").dropDuplicates(["class"])) if alive.filter("rows > 1").limit(1).count() else once
    sets = stored(reps.mapInArrow(_sets, "class long, n long, hashes binary"), "sets")
    # in how many sets each hash is: asked for by chunks of sets, answered by parts of the hashes
    chunks = sets.select(F.pmod("class", F.lit(n)).cast("int").alias("chunk"), "class", "hashes")
    replies = stored(chunks.groupBy("chunk").applyInArrow(_asking(n), ASKED).groupBy("part").applyInArrow(_replying, REPLY), "replies")
    prefixes = stored(chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_prefixes(n), PREFIX), "prefixes")
    discard(replies)
    edges = prefixes.select("class", "prefix").mapInArrow(_linking, "kind int, a long, b long")
    edges = edges.repartition(n, "a").mapInArrow(_meet, "kind int, a long, b long").select("a", "b")
    groups = components(edges)
    members = stored(groups.join(prefixes.select(F.col("class").alias("node"), "n").distinct(), "node").select(F.col("label").alias("grp"), F.col("node").alias("class"), "n"), "members")
    blocks = stored(_blocks(members), "blocks")
    own = _ranges(blocks)
    near = own.select("grp", F.col("block").alias("i"), F.col("high")).join(own.select("grp", F.explode(F.array(F.col("block"), F.col("block") - 1)).alias("i"), F.col("block").alias("j"), F.col("low")), ["grp", "i"])
    near = near.filter(F.col("high") * 100 >= F.col("low") * PERCENT).select("grp", "i", "j")
    links = stored(_multiply(_task_rows(near, blocks, blocks), sets, n), "links")
    # classes outside their group's largest component so far meet the blocks that they haven't met
    large = own.groupBy("grp").agg(F.max("block").alias("last")).filter("last > 1").select("grp")
    rest = blocks.join(large, "grp", "left_semi")
    if rest.limit(1).count():
        so_far = components(links)
        lab = rest.join(so_far.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
        lab = stored(lab, "labelled")
        count = lab.groupBy("grp", "label").agg(F.count("*").alias("k"))
        main = count.groupBy("grp").agg(F.max_by("label", F.struct("k", "label")).alias("main"))
        strays = stored(_blocks(lab.join(main, "grp").filter("label != main").select("grp", "class", "n")), "strays")
        # on either side just the classes with a prefix hash that the other side holds; strays' blocks are numbered
        # below zero, so that one is never taken for the block it meets
        held = prefixes.select("class", "prefix").join(lab.select("class", "grp", "block"), "class").select("grp", "block", "class", "prefix")
        post = stored(held.mapInArrow(_postings, "h long, grp long, block int, class long"), "postings")
        lone = post.drop("block").join(strays.select("grp", "class", (-1 - F.col("block")).alias("i")), ["grp", "class"])
        mine = lone.join(post.select("h", "grp", F.col("block").alias("j")).distinct(), ["h", "grp"]).select("grp", "i", "j", "class").distinct()
        theirs = lone.select("h", "grp", "i").distinct().join(post.withColumnRenamed("block", "j"), ["h", "grp"]).select("grp", "i", "j", "class").distinct()
        far = mine.withColumn("side", F.lit(0)).union(theirs.withColumn("side", F.lit(1)))
        more = stored(_multiply(far, sets, n), "far-links")
        links = links.union(more)
    labels = components(links).select(F.col("node").alias("class"), "label")
    out = docs_t.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    out = stored(out.select("doc_id", F.col("n").alias("n_shingles"), "class", "label"), "classes")
    discard(alive, sets, members, blocks)
    return out


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    t = link_classes(docs)
    least = t.filter("n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    return t.join(least, "label", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Rows of docs, all columns: of each component the one with the smallest doc_id (null last).

    Rows equal in doc_id and text are one document: the first by the remaining columns stays.  Documents without words
    all stay, repeated rows too.
    """
    bare = ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")
    every, docs = docs, docs.filter(~bare)
    row = F.xxhash64("doc_id", F.xxhash64("text"), F.length("text"))
    t = link_classes(docs.select(row.alias("doc_id"), "text")).withColumnRenamed("doc_id", "_row")
    ids = docs.select(row.alias("_row"), F.col("doc_id").cast("long").alias("doc_id"))
    linked = t.distinct().join(ids, "_row")
    first = linked.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_row")).alias("x")).select(F.col("x._row").alias("_row"))
    rest = [c for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map<" not in kind and kind != "variant"]
    place = F.row_number().over(Window.partitionBy("_row").orderBy(*rest or ["_row"]))
    kept = docs.withColumn("_row", row).join(first, "_row", "left_semi").withColumn("_place", place).filter("_place = 1")
    return kept.select(*every.columns).union(every.filter(bare))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


#: Pairs by their common shingles, then the closure of the links; for small tables.
SQL = rf"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT row, unnest(CASE WHEN len(w) >= {WORDS} THEN list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (
  SELECT row, count(*) AS n FROM s GROUP BY row
), p AS (
  SELECT a.row AS x, b.row AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g GROUP BY ALL
), e AS (
  SELECT x, y FROM p JOIN n a ON a.row = x JOIN n b ON b.row = y WHERE 100 * c >= {PERCENT} * (a.n + b.n - c)
), r(row, other) AS (
  SELECT x, y FROM e UNION SELECT r.row, e.y FROM r JOIN e ON r.other = e.x
), m AS (
  SELECT r.row, min(w.doc_id) AS least FROM r JOIN w ON r.other = w.row GROUP BY r.row
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, CASE WHEN n.n IS NULL THEN w.doc_id ELSE m.least END AS component_id FROM w LEFT JOIN n ON w.row = n.row LEFT JOIN m ON w.row = m.row
"""
