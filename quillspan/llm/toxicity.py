"""Toxicity by compression distance.

Two zstandard dictionaries are made from the training fold's texts: one by zstandard's
trainer from ordinary text, one by contrast from toxic text, mostly words that mark it.  A document is cut into windows of a few words, twice, so that what one cut
parts the other leaves whole; each
window is compressed with the ordinary dictionary alone and with the toxic one
laid over it.  The bytes that the toxic dictionary saves are counted over all windows
of the whole text; the log likelihood ratio of these counts goes through a
logistic curve whose cut is calibrated on documents that the dictionaries compared
haven't seen (k folds of the training rows; the final dictionaries come from all).

The ordinary dictionary is made by zstandard's own trainer.  The toxic one isn't:
most of a toxic text is ordinary, and what that trainer picks from it drowns the
rest (the README has figures).  It is made by the same kind of cover, by contrast: byte
5-grams within words that significantly more toxic than ordinary documents hold (likelihood
ratio test on numbers of documents, near copies once) mark stretches of the toxic texts, and the
stretches that most documents hold are laid into the dictionary until their 5-grams are
covered.  No word list or lexicon enters; stretches begin and end anywhere.

Edge cases: a null or empty text has no window and gets the score of zero
savings; very long texts are read whole, window by window; repeated rows are scored each on
their own, ties in score stay ties; a null doc_id counts as training fold by the empty text's checksum;
with fewer than MIN_EACH different labelled texts of one of the classes every score is the share of
label 1 among training labels (0 without labels), an empty table gives an empty
result.  Extra columns of the input are ignored by `score` and kept by `without_toxic`.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import best_cut, by_label, logit_fit, pick, remainder, table, texts_of

WINDOW = 4
MODULUS, HELD = 3, 1
CUT = 0.7
#: Bounds of the fit sample: labelled documents of either class, and bytes of their text in all.  Texts that no longer
#: fit in are left out, so very long ones are fewer in the sample than in the corpus.
FIT_TOXIC, FIT_ORDINARY, FIT_BYTES = 3000, 4000, 16_000_000
FOLDS, MIN_EACH, FEW = 4, 4, 4
#: Sizes in bytes of the dictionaries, of the segments of the ordinary one, and of the ordinary text it is made from.
TOXIC_BYTES, ORDINARY_BYTES, SEGMENT, ORDINARY_TEXT = 1024, 4096, 24, 3_000_000
#: A text is cut into windows twice: from its first word, and with a first window of two words.
CUTS = (0, 2)
#: Least test statistic (2 log likelihood ratio) and least ratio of shares of documents for a 5-gram of toxic text.
GRAM, SURE, LIFT = 5, 20.0, 2.0
#: Ends of a stretch whose 5-grams fewer documents hold than this share of its peak are cut off.
CORE = 0.7
#: Savings of a window are counted by the byte between these bounds.
LEAST, MOST = -3, 10
BINS = MOST - LEAST + 1


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _joined(text: str | None) -> bytes:
    return b" " + b" ".join(_words(text))


def _unlike(texts: list[bytes]) -> list[bytes]:
    """The texts without near copies of earlier ones: those that share one of their FEW least hashes of five words."""
    seen: set[int] = set()
    out = []
    for x in texts:
        w = x.split()
        least = sorted({xxhash.xxh3_64_intdigest(b" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))})[:FEW]
        if seen.isdisjoint(least):
            out.append(x)
        seen.update(least)
    return out


def _codes(x: bytes) -> np.ndarray:
    """The text's byte grams in order, as integers."""
    a = np.frombuffer(x, dtype=np.uint8).astype(np.int64)
    n = max(0, len(a) - GRAM + 1)
    return sum((a[k : k + n] << (8 * k) for k in range(GRAM)), np.zeros(n, np.int64))


def _held(texts: list[bytes], among: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """(FOLDS, len(among)): how many documents of each fold hold each of these grams."""
    out = np.zeros((FOLDS, len(among)), dtype=np.int64)
    for x, f in zip(texts, fold):
        c = np.unique(_codes(x))
        i = np.searchsorted(among, c)
        ok = i < len(among)
        ok[ok] = among[i[ok]] == c[ok]
        out[f, i[ok]] += 1
    return out


def _candidates(texts: list[bytes], least: int) -> np.ndarray:
    """Grams that at least so many of the texts hold, sorted; none that a space parts."""
    known, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for k in range(0, len(texts), 256):
        c, n = np.unique(np.concatenate([np.unique(_codes(x)) for x in texts[k : k + 256]]), return_counts=True)
        both, at = np.unique(np.r_[known, c], return_inverse=True)
        known, count = both, np.bincount(at, weights=np.r_[count, n], minlength=len(both)).astype(np.int64)
    inner = np.zeros(len(known), dtype=bool)
    for k in range(1, GRAM - 1):
        inner |= (known >> (8 * k)) & 255 == 32
    return known[(count >= least) & ~inner]


def significant(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Whether a of n1 toxic documents against b of n0 ordinary ones is significantly and clearly more."""
    a, b, n = a.astype(float), b.astype(float), float(n1 + n0)
    t = lambda v: np.where(v > 0, v * np.log(np.maximum(v, 1e-9)), 0.0)
    g = 2 * (t(a) + t(b) + t(n1 - a) + t(n0 - b) + t(n) - t(a + b) - t(n - a - b) - t(np.float64(n1)) - t(np.float64(n0)))
    return (g >= SURE) & (a / n1 >= LIFT * (b + 0.5) / n0)


def _stretches(x: bytes, grams: np.ndarray, count: np.ndarray) -> set[bytes]:
    """Stretches of a text that the grams cover, without ends that few documents share."""
    c = _codes(x)
    i = np.searchsorted(grams, c)
    ok = i < len(grams)
    ok[ok] = grams[i[ok]] == c[ok]
    at = np.flatnonzero(ok)
    out = set()
    for run in np.split(at, np.flatnonzero(np.diff(at) > GRAM) + 1) if len(at) else ():
        n = count[i[run]]
        core = run[n >= CORE * n.max()]
        out.add(x[core[0] : core[-1] + GRAM])
    return out


def _toxic_dictionary(texts: list[bytes], grams: np.ndarray, count: np.ndarray) -> bytes:
    """Stretches in order of the number of texts that hold them, each for grams that aren't covered yet; the first stands last."""
    seen: Counter = Counter()
    for x in texts:
        seen.update(_stretches(x, grams, count))
    covered: set[int] = set()
    out = b""
    for s, _ in sorted(seen.items(), key=lambda y: (-y[1], y[0])):
        own = set(_codes(s).tolist())
        if 2 * len(own - covered) > len(own) and len(out) + len(s) <= TOXIC_BYTES:
            covered |= own
            out = s + out
    return out


def _windows(w: list[bytes], first: int = 0) -> list[bytes]:
    """The words by windows; the first one of `first` words."""
    starts = [*([0] if first and w else []), *range(first, len(w), WINDOW)]
    return [b" " + b" ".join(w[i:j]) for i, j in zip(starts, [*starts[1:], len(w)])]


def _ordinary_dictionary(texts: list[bytes]) -> bytes:
    enough = np.cumsum([0, *map(len, texts)])[:-1] < ORDINARY_TEXT
    samples = [w for x, ok in zip(texts, enough) if ok for w in _windows(x.split()) if len(w) >= 8]
    try:
        return zstandard.train_dictionary(ORDINARY_BYTES, samples, k=SEGMENT, d=6).as_bytes()
    except zstandard.ZstdError:  # too little text for the trainer: the text itself is the dictionary
        return b"".join(samples)[:ORDINARY_BYTES]


def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        write_content_size=0, write_checksum=0, write_dict_id=0, window_log=17, chain_log=14, hash_log=15,
        strategy=zstandard.STRATEGY_GREEDY, search_log=5, min_match=5, target_length=32,
    )
    # the dictionaries' content without their entropy tables: literals then cost the same under both
    d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params)


class Saver:
    """Bytes that the toxic dictionary saves in each window of a text."""

    def __init__(self, model: dict):
        # a lead-in that both dictionaries end with lets zstandard compress windows that are short on their own
        self.lead = model["lead"]
        self.toxic = _compressor(model["toxic"] + model["ordinary"] + model["lead"]).compress
        self.ordinary = _compressor(model["ordinary"] + model["lead"]).compress

    def histogram(self, x: bytes) -> np.ndarray:
        """(cuts, bins): how many windows of the text save how many bytes, from LEAST to MOST."""
        lead, a, b, w, out = self.lead, self.toxic, self.ordinary, x.split(), np.zeros((len(CUTS), BINS), dtype=np.int64)
        for k, first in enumerate(CUTS):
            s = [len(b(y)) - len(a(y)) for y in [lead + v for v in _windows(w, first)]]
            out[k] = np.bincount(np.clip(np.array(s, dtype=np.int64), LEAST, MOST) - LEAST, minlength=BINS)
        return out


def _dictionaries(toxic: list[bytes], ordinary: list[bytes], grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict:
    good = significant(a, b, len(toxic), len(ordinary))
    first = next(filter(None, (x[:32] for x in ordinary)), b" ")
    return {"toxic": _toxic_dictionary(toxic, grams[good], a[good]), "ordinary": _ordinary_dictionary(ordinary), "lead": first}


def _features(h: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each cut the log likelihood ratio of the windows' savings: summed, by root of the window count, averaged; the log count; and how many windows save little, more and much."""
    out = []
    for k in range(len(CUTS)):
        n = np.maximum(h[:, k].sum(1), 1)
        r = h[:, k] @ weights[k]
        out += [r, r / np.sqrt(n), r / n, np.log(n), *[np.log1p(h[:, k, i:j].sum(1)) for i, j in ((4, 6), (6, 8), (8, None))]]
    return np.stack(out, axis=1)


def train(one: list[bytes], zero: list[bytes], n1: float, n0: float) -> dict:
    """The model of toxic and ordinary texts, which stand for n1 and n0 documents."""
    fold1, fold0 = np.arange(len(one)) % FOLDS, np.arange(len(zero)) % FOLDS
    grams = _candidates(one, 3)
    a, b = _held(one, grams, fold1), _held(zero, grams, fold0)
    h1, h0 = (np.zeros((len(t), len(CUTS), BINS), dtype=np.int64) for t in (one, zero))
    for f in range(FOLDS):
        rest = lambda texts, fold: [x for x, k in zip(texts, fold) if k != f]  # noqa: B023,E731
        saver = Saver(_dictionaries(rest(one, fold1), rest(zero, fold0), grams, a.sum(0) - a[f], b.sum(0) - b[f]))
        for texts, fold, h in ((one, fold1, h1), (zero, fold0, h0)):
            for i in np.flatnonzero(fold == f):
                h[i] = saver.histogram(texts[i])
    share = lambda h: (h.sum(0) + 1) / (h.sum((0, 2)) + BINS)[:, None]
    weights = np.log(share(h1)) - np.log(share(h0))
    x, y = _features(np.r_[h1, h0], weights), np.r_[np.ones(len(one)), np.zeros(len(zero))]
    w = np.r_[np.full(len(one), n1 / len(one)), np.full(len(zero), n0 / len(zero))]
    mean, scale, coef, bias = logit_fit(x, y, w / w.mean())
    z = ((x - mean) / scale) @ coef + bias
    made = _dictionaries(one, zero, grams, a.sum(0), b.sum(0))
    return made | {"weights": weights, "mean": mean, "scale": scale, "coef": coef, "bias": bias + np.log(CUT / (1 - CUT)) - best_cut(z, y, w / w.mean())}


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Train on a bounded sample of labelled rows outside the held-out fold."""
    lab = by_label(labels, "toxic", MODULUS, HELD)
    counts = {r.y: r.n for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    nothing = {"prior": n1 / (n1 + n0) if n1 + n0 else 0.0, "toxic": None}
    if not n1 or not n0:
        return nothing
    one = pick(lab.filter("y = 1"), FIT_TOXIC, 8)
    zero = pick(lab.filter("y = 0"), FIT_ORDINARY, 8)
    mixed = [i for k in range(max(len(one), (len(zero) + 1) // 2)) for i in (*one[k : k + 1], *zero[2 * k : 2 * k + 2])]
    text = texts_of(docs, mixed, FIT_BYTES)
    one, zero = (_unlike([_joined(text.pop(i)) for i in ids if i in text]) for ids in (one, zero))  # copies once
    return nothing | train(one, zero, n1, n0) if min(len(one), len(zero)) >= MIN_EACH else nothing


def score_texts(model: dict, texts: list, saver: Saver | None) -> np.ndarray:
    if saver is None:
        return np.full(len(texts), model["prior"])
    h = np.array([saver.histogram(_joined(t)) for t in texts], dtype=np.int64).reshape(len(texts), len(CUTS), BINS)
    z = ((_features(h, model["weights"]) - model["mean"]) / model["scale"]) @ model["coef"] + model["bias"]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def saver_of(model: dict) -> Saver | None:
    return None if model["toxic"] is None else Saver(model)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; one pass over the text, no shuffle."""

    def run(batches):
        saver = saver_of(model)
        for b in batches:
            s = score_texts(model, b.column(1).to_pylist(), saver)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (remainder(F.col("doc_id"), MODULUS) == HELD).alias("held_out"))
    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs, all columns, that the model doesn't call toxic."""
    at = docs.columns.index("text")

    def run(batches):
        saver = saver_of(model)
        for b in batches:
            keep = score_texts(model, b.column(at).to_pylist(), saver) < CUT
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
