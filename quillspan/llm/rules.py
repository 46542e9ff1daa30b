"""Quality rules: isolation forests on rule statistics.

Statistics of each whole text (words, characters in words, symbols, repeated
lines, words in repeated 8-word windows) become ratios on a logarithmic scale.  Random splits of
all documents, labelled or not, isolate unusual ones after few splits: one forest
splits all ratios together, and one forest each a single ratio, so that a document that is unusual in one
way isn't hidden by being usual in the others.  A mean path length becomes an anomaly score in (0, 1); a
document is dropped if any forest's score exceeds that forest's threshold.  The thresholds are
calibrated in turn on all rows labelled by `quality`: the forest that errs least first,
each further one on what is left, and none that doesn't lessen the errors drops anything.

Nothing is sampled.  The statistics are a table; trees grow a level at a time, where one pass over it gives each newest node the number of
its rows and their range in each ratio, and thresholds are chosen among GRID steps by how many labelled rows lie in each.  So
the driver gets what the nodes and the grid bound, however long the table.

Edge cases: null and empty texts have no words and fail the base rule; very long texts are read whole; repeated
rows are judged each, and counted each, ties alike; with no labelled row of one of the classes, or too few documents for a forest,
nothing is dropped but by the base rule; an empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import best_cut, discard, dropping_shuffles, stored, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
RUN = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Trees of a forest, splits on a path, documents without which there is no forest, steps of a threshold.
TREES, DEPTH, LEAST, GRID = 128, 8, 8, 1 << 16
#: Rows that a task goes through at once.
CHUNK = 16_384
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(w: list[str]) -> int:
    """Words covered by 8-word windows that occur at least twice in the text."""
    if len(w) <= RUN:
        return 0
    windows = list(zip(*(w[i:] for i in range(RUN))))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    total, covered = 0, 0  # words before `covered` are counted
    for i, x in enumerate(windows):
        if count[x] > 1:
            total += i + RUN - max(i, covered)
            covered = i + RUN
    return total


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    t = text or ""
    w = WORD.findall(t)
    seen: set[str] = set()
    dup = 0
    for line in t.split("\n"):
        if WORD.search(line):
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return len(w), sum(map(len, w)), sum(map(t.count, SYMBOLS)), dup, _repeat_words(w)


def base_failed(s: np.ndarray) -> np.ndarray:
    return (s[:, 0] < MIN_WORDS) | (100 * s[:, 4] > MAX_REPEAT_PERCENT * s[:, 0])


def ratios(s: np.ndarray) -> np.ndarray:
    """Word length, symbols, repeated lines and repeated words a word, and the number of words, as logarithms."""
    n = np.maximum(s[:, :1], 1).astype(float)
    return np.c_[np.log(np.maximum(s[:, 1:2] / n, 0.1)), np.log1p(100 * s[:, 2:] / n), np.log(n)]


def _leaf(tree: tuple, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The leaf that each row comes to."""
    feature, cut, left = tree[:3]
    at = np.zeros(len(x), dtype=np.int64)
    while True:
        f = feature[at]
        inner = f >= 0
        if not inner.any():
            return at
        step = (x[rows, np.maximum(f, 0)] >= cut[at]).astype(np.int64)
        at = np.where(inner, left[at] + step, at)


class Forest:
    """Isolation trees as flat arrays: feature (-1: leaf), cut, left child, path length at a leaf.

    They grow a level at a time: `ranges` tells of rows how many of them lie in each newest node, and between which values;
    from those of all rows together, `split` makes the next level.  Children of a node are neighbours.
    """

    def __init__(self, x: np.ndarray | None = None, seed: int = 5, width: int = 1):
        self.random, self.size, self.depth = np.random.default_rng(seed), 0, 0
        self.width = width if x is None else x.shape[1]
        self.trees = [(np.array([-1]), np.zeros(1), np.zeros(1, dtype=np.int64), np.zeros(1))] * TREES
        # the newest nodes: tree, node, and what a single ratio's values lie between
        self.new = (np.arange(TREES), np.zeros(TREES, dtype=np.int64), np.full(TREES, -np.inf), np.full(TREES, np.inf))
        while x is not None and len(self.new[0]):
            self.split(*self.ranges(x))

    @staticmethod
    def _rest(n: int) -> float:
        """Expected further splits among n rows."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def nothing(self) -> tuple[np.ndarray, ...]:
        """The ranges of no rows."""
        m = len(self.new[0])
        return np.zeros(m, dtype=np.int64), np.full((m, self.width), np.inf), np.full((m, self.width), -np.inf)

    def ranges(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each newest node: number of rows, least and greatest value of each ratio."""
        n, lo, hi = self.nothing()
        tree, node, lower, upper = self.new
        if not len(x):
            return n, lo, hi
        if self.width == 1:
            z = np.sort(x[:, 0])
            first, end = np.searchsorted(z, lower), np.searchsorted(z, upper)
            some = end > first
            n[:], lo[some, 0], hi[some, 0] = end - first, z[first[some]], z[end[some] - 1]
            return n, lo, hi
        rows, edges = np.arange(len(x)), np.searchsorted(tree, np.arange(TREES + 1))
        for t in np.unique(tree):
            at = _leaf(self.trees[t], x, rows).astype(np.int16)
            order = np.argsort(at, kind="stable")
            found, first, many = np.unique(at[order], return_index=True, return_counts=True)
            z = x[order]
            # the newest nodes of a tree are numbered in order, its finished leaves are passed over
            mine = node[edges[t] : edges[t + 1]]
            k = np.minimum(np.searchsorted(mine, found), len(mine) - 1)
            fits, k = mine[k] == found, k + edges[t]
            n[k[fits]] = many[fits]
            lo[k[fits]], hi[k[fits]] = np.minimum.reduceat(z, first)[fits], np.maximum.reduceat(z, first)[fits]
        return n, lo, hi

    def split(self, n: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """The next level, from the ranges of all rows: nodes with unlike rows part at random, the others are leaves."""
        tree, node, lower, upper = self.new
        if not self.depth:
            self.size = int(n[0])
        free = hi > lo
        inner = free.any(1) & (n > 1) & (self.depth < DEPTH)
        f = np.argmax(np.where(free, self.random.random(free.shape), -1.0), 1)
        low, high = np.where(inner, lo[np.arange(len(n)), f], 0.0), np.where(inner, hi[np.arange(len(n)), f], 1.0)
        at = np.clip(low + self.random.random(len(n)) * (high - low), np.nextafter(low, high), high)
        new = []
        for t in np.unique(tree):
            mine = np.flatnonzero(tree == t)
            feature, cut, left, length = (v.copy() for v in self.trees[t])
            length[node[mine]] = [self.depth + self._rest(int(k)) for k in n[mine]]
            parting = mine[inner[mine]]
            child = len(feature) + 2 * np.arange(len(parting))
            feature[node[parting]], cut[node[parting]], left[node[parting]], length[node[parting]] = f[parting], at[parting], child, 0.0
            m = 2 * len(parting)
            self.trees[t] = (np.r_[feature, np.full(m, -1)], np.r_[cut, np.zeros(m)], np.r_[left, np.zeros(m, dtype=np.int64)], np.r_[length, np.zeros(m)])
            pairs = lambda a, b: np.stack([a, b], 1).ravel()
            new.append((np.full(m, t), pairs(child, child + 1), pairs(lower[parting], at[parting]), pairs(at[parting], upper[parting])))
        self.new, self.depth = tuple(np.concatenate(v) for v in zip(*new)), self.depth + 1

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected length): near 1 for rows that few splits isolate."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for tree in self.trees:
            total += tree[3][_leaf(tree, x, rows)]
        return 2.0 ** (-total / TREES / max(self._rest(self.size), 1e-9))


class Steps:
    """A forest on one statistic: its score changes only at the cuts, so that a look-up takes the place of the walk."""

    def __init__(self, forest: Forest):
        self.cuts = np.unique(np.concatenate([cut[feature >= 0] for feature, cut, _, _ in forest.trees]))
        self.scores = forest.score(np.r_[self.cuts[:1] - 1, self.cuts][:, None]) if len(self.cuts) else forest.score(np.zeros((1, 1)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.scores[np.searchsorted(self.cuts, x[:, 0], side="right")]


def _kinds(forest) -> list[tuple[list[int], object]]:
    """forest(columns, seed) for each ratio by itself, then for all."""
    width = len(STATS)
    return [*(([k], forest([k], 6 + k)) for k in range(width)), ([*range(width)], forest([*range(width)], 5))]


def _with_steps(forests: list) -> list[tuple[list[int], Forest | Steps]]:
    return [(cols, Steps(f) if len(cols) == 1 else f) for cols, f in forests]


def grown(x: np.ndarray) -> list[tuple[list[int], Forest | Steps]]:
    """The forests on rows of ratios, with the columns that each looks at: each by itself, then all."""
    return _with_steps(_kinds(lambda cols, seed: Forest(x[:, cols], seed)))


def _chunks(batches):
    """Rows of statistics, CHUNK or some more at a time, from batches that hold them as their last columns."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= CHUNK:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _numbers(chunk: pa.Table) -> np.ndarray:
    return np.stack([chunk.column(c).to_numpy() for c in STATS], axis=1)


def grown_on(stats: DataFrame) -> list[tuple[list[int], Forest | Steps]]:
    """The forests on all rows of a table of statistics; a pass over it for each level."""
    spark, width = stats.sparkSession, len(STATS)
    forests = _kinds(lambda cols, seed: Forest(None, seed, len(cols)))
    edge = [f"{e}{k}" for e in ("lo", "hi") for k in range(width)]

    def run(batches):
        found = [f.nothing() for _, f in forests]
        for chunk in _chunks(batches):
            x = ratios(_numbers(chunk))
            for (cols, f), (n, lo, hi) in zip(forests, found):
                more = f.ranges(x[:, cols])
                n += more[0]
                np.minimum(lo, more[1], out=lo)
                np.maximum(hi, more[2], out=hi)
        for k, ((cols, _), (n, lo, hi)) in enumerate(zip(forests, found)):
            some = np.flatnonzero(n)
            none = pa.nulls(len(some), pa.float64())
            sides = [pa.array(v[some, cols.index(c)]) if c in cols else none for v in (lo, hi) for c in range(width)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, dtype=np.int32)), pa.array(some.astype(np.int32)), pa.array(n[some]), *sides], names=["forest", "place", "n", *edge])

    # as many tasks as run at once: each gives every node's range once
    few = stats.select(*STATS).coalesce(spark.sparkContext.defaultParallelism)
    while any(len(f.new[0]) for _, f in forests):
        part = few.mapInArrow(run, "forest int, place int, n long, " + ", ".join(f"{e} double" for e in edge))
        with dropping_shuffles(spark):
            level = part.groupBy("forest", "place").agg(F.sum("n").alias("n"), *((F.min if e.startswith("lo") else F.max)(e).alias(e) for e in edge)).toArrow()
        of, place, n = (level.column(c).to_numpy() for c in ("forest", "place", "n"))
        for k, (cols, f) in enumerate(forests):
            if len(f.new[0]):
                all_n, lo, hi = f.nothing()
                mine = of == k
                all_n[place[mine]] = n[mine]
                for side, name in ((lo, "lo"), (hi, "hi")):
                    for j, c in enumerate(cols):
                        side[place[mine], j] = level.column(f"{name}{c}").to_numpy()[mine]
                f.split(all_n, lo, hi)
    return _with_steps(forests)


def anomalies(forests: list, x: np.ndarray) -> np.ndarray:
    """(rows, forests): the score of each forest."""
    return np.stack([f.score(x[:, cols]) for cols, f in forests], axis=1)


def _lessened(columns: int, left) -> np.ndarray:
    """A threshold for each column of scores, so that dropping what exceeds any of them errs little.

    left(cuts, k): (score in column k, whether bad, weight) of what no threshold drops.
    """
    cuts, errors = np.full(columns, np.inf), []
    for k in range(columns):
        z, bad, w = left(cuts, k)
        errors.append(w[(z > best_cut(z, bad, w)) != (bad == 1)].sum())
    for k in np.argsort(errors, kind="stable"):
        z, bad, w = left(cuts, k)
        if not len(z):
            break
        cut = best_cut(z, bad, w)
        if (z > cut).any():
            cuts[k] = cut
    return cuts


def calibrated(z: np.ndarray, bad: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Thresholds from rows of scores."""

    def left(cuts, k):
        rows = (z <= cuts).all(1)
        return z[rows, k], bad[rows], w[rows]

    return _lessened(z.shape[1], left)


def calibrated_on(scores: DataFrame, columns: int) -> np.ndarray:
    """Thresholds from all rows (bad, z0, z1, ...) of a table: how many of either class lie in each step of the grid.

    A step is open below, so that what lies in it is on one side of either of its ends.
    """
    names = [f"z{k}" for k in range(columns)]

    def left(cuts, k):
        kept = scores.filter(" and ".join(f"{n} <= double('{c!r}')" for n, c in zip(names, cuts.tolist()) if c < np.inf) or "true")
        with dropping_shuffles(scores.sparkSession):
            got = kept.groupBy((F.ceil(F.col(names[k]) * GRID) - 1).alias("step"), "bad").agg(F.count("*").alias("n")).orderBy("step", "bad").toArrow()
        step, bad, n = (got.column(c).to_numpy() for c in ("step", "bad", "n"))
        return (step + 0.5) / GRID, bad, n.astype(float)

    return _lessened(columns, left)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row; one pass, no shuffle."""

    def run(batches):
        for b in batches:
            s = np.array([statistics(t) for t in b.column(1).to_pylist()], dtype=np.int64).reshape(b.num_rows, len(STATS))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(s[:, k]) for k in range(len(STATS)))], names=["doc_id", *STATS])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in STATS))


def fit_on(stats: DataFrame, labels: DataFrame) -> dict:
    """The model from all rows of a table of statistics that pass the base rule, and the labels of those that have one."""
    nothing: dict = {"forests": []}
    lab = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") > 0).cast("int")).alias("y"))
    sound = stats.filter((F.col("n_words") >= MIN_WORDS) & (100 * F.col("n_repeat_words") <= MAX_REPEAT_PERCENT * F.col("n_words")))
    known = stored(sound.join(lab, "doc_id").select((1 - F.col("y")).alias("bad"), *STATS), "known")
    if known.select("bad").distinct().count() < 2 or len(sound.limit(LEAST).collect()) < LEAST:
        discard(known)
        return nothing
    forests = grown_on(sound)

    def run(batches):
        for chunk in _chunks(batches):
            z = anomalies(forests, ratios(_numbers(chunk)))
            yield from pa.table([chunk.column("bad"), *(pa.array(z[:, k]) for k in range(z.shape[1]))], names=["bad", *(f"z{k}" for k in range(z.shape[1]))]).to_batches()

    scores = stored(known.mapInArrow(run, "bad int, " + ", ".join(f"z{k} double" for k in range(len(forests)))), "scores")
    cuts = calibrated_on(scores, len(forests))
    discard(known, scores)
    return {"forests": forests, "cuts": cuts}


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    stats = stored(measured(docs), "statistics")
    model = fit_on(stats, labels)
    discard(stats)
    return model


def verdicts(stats: DataFrame, model: dict) -> DataFrame:
    """doc_id, the statistics, base_failed, kept and the highest share of its threshold that a forest's score reaches; one pass, no shuffle."""

    def run(batches):
        for chunk in _chunks(batches):
            s = _numbers(chunk)
            failed = base_failed(s)
            z = (anomalies(model["forests"], ratios(s)) / model["cuts"]).max(1) if model["forests"] else np.zeros(len(s))
            more = pa.table([pa.array(failed), pa.array(~failed & (z <= 1)), pa.array(z)], names=["base_failed", "kept", "anomaly"])
            yield from pa.table([*chunk.columns, *more.columns], names=["doc_id", *STATS, *more.column_names]).to_batches()

    return stats.select("doc_id", *STATS).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in STATS) + ", base_failed boolean, kept boolean, anomaly double")


def judge(docs: DataFrame, model: dict) -> DataFrame:
    """The verdict on each row of docs."""
    return verdicts(measured(docs), model)


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stored(measured(table(spark, sf_dir, "documents")), "statistics")
    return verdicts(stats, fit_on(stats, table(spark, sf_dir, "labels")))
