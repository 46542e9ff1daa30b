"""Quality classifier by positive-unlabelled learning.

Trusted positives (rows of the training fold labelled 1) and unlabelled text
(rows of the training fold whatever their label) train a small network on
statistics of the whole text.  It minimises the non-negative unbiased risk
    pi * R_p(+1) + max(0, R_u(-1) - pi * R_p(-1))
where the class prior pi is estimated from a first classifier's scores on held
back samples: the least ratio, over score cuts, of the unlabelled share above
the cut to the positives' share above it.

Edge cases: null and empty texts count as texts without words and are scored
like any other; very long texts are read whole; repeated rows are scored each, ties in score stay ties; a null doc_id falls in the
training fold's remainder of the empty text; without positives or unlabelled
rows every score is 0.5.  Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import best_cut, by_label, pick, remainder, table, texts_of

MODULUS, HELD = 4, 2
CUT = 0.7
#: Bounds of the fit sample: positives, unlabelled rows, and bytes of their text in all.  Texts that no longer fit in are
#: left out, so very long ones are fewer in the sample than in the corpus.
FIT_POSITIVE, FIT_UNLABELLED, FIT_BYTES = 4000, 4000, 32_000_000
HIDDEN, EPOCHS, RATE = 12, 400, 0.02
SYMBOLS = "#*$%&|<>"


def features(text: str | None) -> list[float]:
    """Statistics of a whole text; ratios, so that length alone decides little."""
    t = text or ""
    w = t.split()
    n = len(w)
    if not n:
        return [0.0] * 13
    c = Counter(w)
    chars = len(t)
    lines = [x for x in t.split("\n") if x.strip()]
    marks = sum(t.count(s) for s in SYMBOLS)
    adjacent = sum(a == b for a, b in zip(w, w[1:]))
    pairs = len(set(zip(w, w[1:])))
    top = c.most_common(1)[0][1]
    return [
        np.log1p(n),
        (chars - n) / n,
        marks / chars,
        t.count("|") / n,
        len(c) / n,
        top / n,
        adjacent / n,
        pairs / n,
        1 - len(set(lines)) / max(1, len(lines)),
        (t.count(".") + t.count(",")) / n,
        sum(ch in t for ch in SYMBOLS) / len(SYMBOLS),
        len(lines) / n,
        min(1.0, 50 * marks / chars),
    ]


def _standard(x: np.ndarray, m: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.clip((x - m) / s, -6, 6)


def _forward(net: dict, x: np.ndarray):
    h = np.tanh(x @ net["a"] + net["b"])
    return h, h @ net["c"] + net["d"]


def _train(xp: np.ndarray, xu: np.ndarray, prior: float | None, seed: int = 1) -> dict:
    """Adam on the non-negative risk with the sigmoid loss; with no prior, on positives against unlabelled."""
    g = np.random.default_rng(seed)
    net = {"a": g.normal(0, 0.5, (xp.shape[1], HIDDEN)), "b": np.zeros(HIDDEN), "c": g.normal(0, 0.5, HIDDEN), "d": np.zeros(1)}
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))
    x = np.r_[xp, xu]
    p, u = len(xp), len(xu)
    for step in range(1, EPOCHS + 1):
        h, z = _forward(net, x)
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        slope = q * (1 - q)
        # sigmoid loss: l(z, +1) = 1 - q, l(z, -1) = q
        if prior is None:
            grad = np.r_[-slope[:p] / p, slope[p:] / u]
        else:
            negative = q[p:].mean() - prior * q[:p].mean()
            if negative >= 0:
                grad = np.r_[-2 * prior * slope[:p] / p, slope[p:] / u]
            else:  # the negatives' risk can't be below zero: step back from overfitting
                grad = np.r_[prior * slope[:p] / p, -slope[p:] / u]
        dh = grad[:, None] * net["c"] * (1 - h * h)
        gr = {"a": x.T @ dh, "b": dh.sum(0), "c": h.T @ grad, "d": np.array([grad.sum()])}
        for k in net:
            gr[k] = gr[k] + 1e-5 * net[k]
            m1[k] = 0.9 * m1[k] + 0.1 * gr[k]
            m2[k] = 0.999 * m2[k] + 0.001 * gr[k] ** 2
            net[k] = net[k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return net


def estimate_prior(zp: np.ndarray, zu: np.ndarray) -> float:
    """Share of positives among the unlabelled: least ratio of the two upper tails, each with its confidence margin."""
    cuts = np.quantile(zp, np.linspace(0.0, 0.95, 96))
    margin = lambda n: np.sqrt(np.log(4 / 0.1) / (2 * n))
    qp, qu = ((z[None, :] >= cuts[:, None]).mean(1) for z in (zp, zu))
    upper = (qu + 0.5 * margin(len(zu))) / np.maximum(qp - 0.5 * margin(len(zp)), 1e-3)
    k = int(np.argmin(upper))
    return float(np.clip(qu[k] / max(qp[k], 1e-3), 0.02, 0.98))


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    lab = by_label(labels, "quality", MODULUS, HELD)
    positive = pick(lab.filter("y = 1"), FIT_POSITIVE, 1)
    free = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter(F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), MODULUS) != HELD))
    unlabelled = pick(free, FIT_UNLABELLED, 2)
    mixed = [i for pair in zip(positive, unlabelled) for i in pair] + positive[len(unlabelled):] + unlabelled[len(positive):]
    text = texts_of(docs, list(dict.fromkeys(mixed)), FIT_BYTES)
    known = {i: np.array(features(t)) for i, t in text.items()}
    p = np.array([known[i] for i in positive if i in known])
    u = np.array([known[i] for i in unlabelled if i in known])
    if len(p) < 8 or len(u) < 8:
        return {"net": None}
    m, s = u.mean(0), u.std(0) + 1e-6
    p, u = _standard(p, m, s), _standard(u, m, s)
    first = _train(p[::2], u[::2], None)
    prior = estimate_prior(_forward(first, p[1::2])[1], _forward(first, u[1::2])[1])
    net = _train(p, u, prior)
    zp, zu = _forward(net, p)[1], _forward(net, u)[1]
    # the sign of the network's output is its verdict; the score maps that boundary to CUT
    cut = best_cut(np.r_[zp, zu[zu < 0]], np.r_[np.ones(len(zp)), np.zeros(int((zu < 0).sum()))], np.r_[np.full(len(zp), prior / len(zp)), np.full(int((zu < 0).sum()), 1 / len(zu))])
    return {"net": net, "mean": m, "scale": s, "prior": prior, "shift": np.log(CUT / (1 - CUT)) - min(cut, 0.0)}


def score_texts(model: dict, texts: list) -> np.ndarray:
    if model["net"] is None:
        return np.full(len(texts), 0.5)
    x = np.array([features(t) for t in texts], dtype=np.float64).reshape(len(texts), 13)
    z = _forward(model["net"], _standard(x, model["mean"], model["scale"]))[1] + model["shift"]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; one pass over the text, no shuffle."""

    def run(batches):
        for b in batches:
            s = score_texts(model, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (remainder(F.col("doc_id"), MODULUS) == HELD).alias("held_out"))
    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
