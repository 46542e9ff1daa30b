"""Connected components over edge tables, and union-find on arrays within one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import discard, stored


def local_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) and the smallest node that each is connected with."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        new = new[label]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of edges(a, b), label the smallest node of its component.

    Alternates two steps on a table of edges: every node hands its larger neighbours, then its smaller ones, to its
    smallest neighbour.  Each step groups by node with minima only, so that a node with many edges is aggregated
    before it is shuffled; each round is written to the shared folder.
    """
    e = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        # large star: larger neighbours of n point to the smallest of n and its neighbours
        large = both.join(low, both.a == low.n).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = stored(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        # small star: n and its smaller neighbours point to the smallest of them
        small = large.join(least, large.a == least.n).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("n"), "m")).filter("a != b").distinct()
        small = stored(small, "small")
        changed = small.exceptAll(e).limit(1).count() or small.count() != e.count()
        discard(e, large)
        e = small
        if not changed:
            break
    return e.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label").union(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
