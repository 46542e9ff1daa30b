"""Language-model scoring with an Elias-Fano n-gram trie.

Documents are gathered in chunks.  Each chunk sends its distinct words, pairs and triples, with their counts among
training documents, to hash shards: one shuffle.  A shard adds the counts up, makes a trie of Elias-Fano levels with a byte
for each pair and triple, maps it into memory from a temporary file, and looks up what its chunks have sent by
successor search within each context; each distinct word, pair and triple is looked up once.  The answers return to the chunk,
which sums up its documents: the second shuffle.

The model interpolates:  p(w | h) = ((c(h w) - D)+ + r(h) * (c(w) + 1) / (N + V + 1)) / (m(h) + r(h)),
with m(h) the discounted counts of the pairs seen after h, and r(h) = max(c(h) - m(h), D) what is left for all others;
and in the same way  p(w | g h) = ((c(g h w) - D)+ + r(g h) * p(w | h)) / (m(g h) + r(g h)),  where the pair g h was seen,
p(w | h) where it wasn't.  All pairs and triples seen are kept.  Word counts are exact; a byte holds the quantised count of a pair or triple,
from which the discounted one and the context's mass follow (contexts of frequent words lie in several shards, so a probability
is whole only where their masses meet, in the chunk).  Words are told apart by 64-bit hashes, successors of a word
by 32 bits, of a pair by 24; the mass of a pair's successors travels as a logarithm of 16 bits.  A document begins after the end token of the one before; its first
word has no other context, so that no triple reaches across documents.

Pairs of very frequent first words (found on a bounded sample; only the
distribution of work depends on it) are spread over several shards.  Triples lie
with their first two words.

Edge cases: null and empty texts are one end token; very long texts are read whole and may make a chunk alone; repeated rows count and are
scored each, ties in score stay ties; a null doc_id counts as training fold by the empty text's
checksum; with nothing in the training fold N and V are 0; an empty table gives
an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import partitions, pick, remainder, stored, table, texts_of
from .eliasfano import CODES, FINGER, THIRD, Trie

MODULUS, HELD = 7, 2
DISCOUNT, LEAST = 0.75, 1
#: Tokens of a chunk; with the number of shards they set the size of what is sent from chunk to shard.
CHUNK_TOKENS = 500_000
#: Pairs and triples that are looked up at once.
AT_ONCE = 250_000
END = b" "  # no word holds a space
HOT_SAMPLE, HOT_BYTES, HOT_SHARE, HOT_WAYS, STRIDE = 2000, 16_000_000, 0.002, 128, 7919
U64 = np.uint64


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Chunk:
    """Documents' tokens as local numbers, ordered by shard and hash once the chunk is closed."""

    def __init__(self):
        self.local: dict[bytes, int] = {END: 0}
        self.seq: list[np.ndarray] = [np.zeros(1, np.int32)]
        self.docs: list[tuple] = []
        self.size = 0

    def add(self, doc_id, held, text) -> None:
        local = self.local
        w = [local.setdefault(x, len(local)) for x in tokens(text)]
        w.append(0)
        self.seq.append(np.array(w, dtype=np.int32))
        self.docs.append((doc_id, held, len(w)))
        self.size += len(w)

    def close(self, shards: int, hot: frozenset):
        """(word hashes, their home shards, which are frequent, the token sequence); words in order of shard and of how often they occur here."""
        digest = xxhash.xxh3_64_intdigest
        h = np.fromiter((digest(w) for w in self.local), dtype=U64, count=len(self.local))
        home = (h % U64(shards)).astype(np.int64)
        seq = np.concatenate(self.seq)
        order = np.lexsort((h, -np.bincount(seq, minlength=len(h)), home))
        rank = np.empty(len(h), dtype=np.int64)
        rank[order] = np.arange(len(h))
        h = h[order]
        is_hot = np.isin(h, np.array(sorted(hot), dtype=U64)) if hot else np.zeros(len(h), bool)
        return h, home[order], is_hot, rank[seq]


def _pairs(words, home, is_hot, seq, shards):
    """Distinct pairs of local numbers by (shard, first, second), and for each token its pair.

    A pair lies in the shard of its first word; those of a frequent word are spread by the shard of the second.
    """
    code, at = np.unique(seq[:-1] * words + seq[1:], return_inverse=True)
    first, second = code // words, code % words
    shard = home[first]
    hot = is_hot[first]
    shard[hot] = (shard[hot] + home[second[hot]] % min(HOT_WAYS, shards) * STRIDE) % shards
    order = np.argsort(shard, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return first[order], second[order], shard[order], place[at]


def _triples(words, seq, place, pairs):
    """Distinct triples of local numbers by pair and third word: how many each pair has, their third words,
    the tokens that end a triple of one document, and for each of these its triple."""
    # the chunk begins with an end token
    inside = np.flatnonzero(seq[1:-1] != seq[0])
    code, at = np.unique(place[inside] * words + seq[inside + 2], return_inverse=True)
    return np.bincount(code // words, minlength=pairs), code % words, inside + 1, at


def _under(at, n):
    """Places of what belongs to each of `at`, where each has n in order."""
    begin, size = (np.cumsum(n) - n)[at], n[at]
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _keys(home, is_hot, first, shard, shards):
    """For each shard: its keys (local numbers), how many pairs each has, and its slice of the pairs.

    A frequent word is a key of all shards that its pairs may lie in, so that its mass is always whole.
    """
    edge = np.searchsorted(shard, np.arange(shards + 1))
    own = np.searchsorted(home, np.arange(shards + 1))
    guests: dict[int, list] = {}
    for w in np.flatnonzero(is_hot).tolist():
        for s in {(int(home[w]) + k * STRIDE) % shards for k in range(min(HOT_WAYS, shards))} - {int(home[w])}:
            guests.setdefault(s, []).append(w)
    at = np.empty(len(home), dtype=np.int64)
    for s in range(shards):
        f = first[edge[s] : edge[s + 1]]
        keys = np.r_[np.arange(own[s], own[s + 1]), np.array(guests.get(s, []), dtype=np.int64)]
        if len(keys):
            at[keys] = np.arange(len(keys))
            yield s, keys, np.bincount(at[f], minlength=len(keys)), edge[s] + np.argsort(at[f], kind="stable")


def _packed(v: np.ndarray, width: int) -> bytes:
    """The low bytes of integers."""
    return np.ascontiguousarray(v.astype(U64)).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(raw: bytes, width: int) -> np.ndarray:
    a = np.zeros((len(raw) // width, 8), dtype=np.uint8)
    a[:, :width] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, width)
    return a.view(U64).ravel()


FINGER_BYTES, THIRD_BYTES = FINGER // 8, THIRD // 8
#: Steps of the logarithm to base 2 that stands for a mass.
MASS_STEPS = 1500


def _finger(h: np.ndarray, bits: int) -> np.ndarray:
    return h >> U64(64 - bits)


def mass_code(m: np.ndarray) -> np.ndarray:
    return np.round(np.log2(1 + m) * MASS_STEPS).astype(np.uint16)


def mass_of(code: np.ndarray) -> np.ndarray:
    return 2.0 ** (code / MASS_STEPS) - 1


def _small(v: np.ndarray) -> bytes:
    """Non-negative integers, most of them small, in the narrowest type that holds them, compressed."""
    top = int(v.max()) if len(v) else 0
    kind = next(t for t in "BHIQ" if top <= np.iinfo(t).max)
    return kind.encode() + zstandard.ZstdCompressor(level=1).compress(v.astype(kind).tobytes())


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), dtype=chr(raw[0])).astype(np.int64)


def _tokens_out(seq: np.ndarray, home: np.ndarray, shards: int) -> bytes:
    """The token sequence: home shards and ranks within them, byte by byte, as both have few frequent values."""
    first = np.searchsorted(home, np.arange(shards))
    of = home[seq]
    planes = [((v >> (8 * k)) & 255).astype(np.uint8).tobytes() for v, n in ((of, 2), (seq - first[of], 4)) for k in range(n)]
    packed = [zstandard.ZstdCompressor(level=3).compress(p) for p in planes]
    return b"".join(len(p).to_bytes(4, "little") + p for p in packed)


def _tokens_in(raw: bytes, home: np.ndarray, shards: int) -> np.ndarray:
    planes, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 4], "little")
        planes.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[at + 4 : at + 4 + n]), np.uint8).astype(np.int64))
        at += 4 + n
    of = planes[0] | planes[1] << 8
    return np.searchsorted(home, np.arange(shards))[of] + sum(p << (8 * k) for k, p in enumerate(planes[2:]))


def _chunks(batches):
    chunk = Chunk()
    for b in batches:
        for i, held, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            chunk.add(i, held, t.as_py())
            if chunk.size >= CHUNK_TOKENS:
                yield chunk
                chunk = Chunk()
    if chunk.docs:
        yield chunk


BLOBS = ("words", "counts", "n_succ", "fingers", "pair_counts", "n_third", "thirds", "third_counts")
#: What a chunk sends to a shard; where `asks` is false, the chunk itself, in the first three columns.
SENT = "chunk string, shard int, asks boolean, " + ", ".join(f"{c} binary" for c in BLOBS)


def _sent(chunk: str, shard: int, asks: bool, *blobs: bytes) -> pa.RecordBatch:
    blobs = (*blobs, *[b""] * (len(BLOBS) - len(blobs)))
    return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([shard], pa.int32()), pa.array([asks]), *(pa.array([x], pa.binary()) for x in blobs)], names=["chunk", "shard", "asks", *BLOBS])


def _sending(shards: int, hot: frozenset):
    def run(batches):
        part = TaskContext.get().partitionId()
        for number, chunk in enumerate(_chunks(batches)):
            name = f"{part}-{number}"
            size = np.array([n for _, _, n in chunk.docs], dtype=np.int64)
            held = np.array([x for _, x, _ in chunk.docs])
            learnt = np.repeat(~held, size).astype(np.float64)  # for each token, whether it is learnt from
            h, home, is_hot, seq = chunk.close(shards, hot)
            first, second, shard, place = _pairs(len(h), home, is_hot, seq, shards)
            n3, third, ends, at3 = _triples(len(h), seq, place, len(first))
            times = lambda at, of, n: np.bincount(at, weights=of, minlength=n).astype(np.int64)
            n, count, count3 = times(seq[1:], learnt, len(h)), times(place, learnt, len(first)), times(at3, learnt[ends], len(third))
            finger, finger3 = _finger(h[second], FINGER), _finger(h[third], THIRD)
            for s, keys, k, at in _keys(home, is_hot, first, shard, shards):
                mine = np.where(home[keys] == s, n[keys], 0)
                at_3 = _under(at, n3)
                yield _sent(name, s, True, h[keys].tobytes(), _small(mine), _small(k), _packed(finger[at], FINGER_BYTES), _small(count[at]), _small(n3[at]), _packed(finger3[at_3], THIRD_BYTES), _small(count3[at_3]))
            # the chunk itself: its documents, and what the order of keys and pairs follows from
            ids = np.array([0 if i is None else i for i, _, _ in chunk.docs], dtype=np.int64)
            null = np.array([i is None for i, _, _ in chunk.docs])
            meta = np.int64(len(ids)).tobytes() + ids.tobytes() + size.tobytes() + null.tobytes() + held.tobytes()
            plan = np.r_[len(h), np.bincount(home, minlength=shards), np.flatnonzero(is_hot)].astype(np.int32).tobytes()
            yield _sent(name, number % shards, False, meta, plan, _tokens_out(seq, home, shards))

    return run


def _merged(key: np.ndarray, count: np.ndarray):
    """Distinct keys in order, their counts summed up, and the rank of each key given."""
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    new = np.r_[True, key[1:] != key[:-1]][: len(key)]
    start, rank = np.flatnonzero(new), np.empty(len(key), dtype=np.int32 if len(key) < 1 << 31 else np.int64)
    rank[order] = np.cumsum(new) - 1
    return key[start], np.add.reduceat(count, start) if len(start) else count, rank


class Shard:
    """What all chunks have sent to one shard, added up: its trie, and where each chunk's words, pairs and triples are."""

    def __init__(self, asked: pa.Table):
        joined = lambda parts, t: np.concatenate([np.zeros(0, t), *parts])
        words = [np.frombuffer(x.as_py(), dtype=U64) for x in asked.column("words")]
        hashes = lambda k, width: joined([_unpacked(x.as_py(), width) for x in asked.column(k)], U64)
        numbers = lambda k: joined([_numbers(x.as_py()) for x in asked.column(k)], np.int64)
        self.sizes = [(len(w), len(a.as_py()) // FINGER_BYTES, len(b.as_py()) // THIRD_BYTES) for w, a, b in zip(words, asked.column("fingers"), asked.column("thirds"))]
        self.words, self.at = np.unique(joined(words, U64), return_inverse=True)
        self.total = np.bincount(self.at, weights=numbers("counts"), minlength=len(self.words)).astype(np.int64)
        key = lambda owner, n, f, bits: (np.repeat(owner.astype(U64) << U64(bits), n)) | f
        self.pair, self.pair_count, self.at2 = _merged(key(self.at, numbers("n_succ"), hashes("fingers", FINGER_BYTES), FINGER), numbers("pair_counts"))
        self.triple, self.triple_count, self.at3 = _merged(key(self.at2, numbers("n_third"), hashes("thirds", THIRD_BYTES), THIRD), numbers("third_counts"))

    @staticmethod
    def _parted(key: np.ndarray, n: int, bits: int):
        return np.bincount((key >> U64(bits)).astype(np.int64), minlength=n), key & U64((1 << bits) - 1)

    def levels(self) -> bytes:
        return Trie.build(self.words, self.total, *self._parted(self.pair, len(self.words), FINGER), self.pair_count, *self._parted(self.triple, len(self.pair), THIRD), self.triple_count, LEAST)

    def found(self, trie: Trie):
        """For each distinct word its count and its pairs' mass, for each pair its byte and its triples' mass, for each triple its byte."""
        n2, f2 = self._parted(self.pair, len(self.words), FINGER)
        n3, f3 = self._parted(self.triple, len(self.pair), THIRD)
        edge2, edge3 = np.r_[0, np.cumsum(n2)], np.r_[0, np.cumsum(n3)]
        weight = np.cumsum(1 + n2 + np.add.reduceat(np.r_[n3, 0], np.minimum(edge2[:-1], len(n3))) * (n2 > 0)) if len(n2) else np.zeros(0)
        out = [[np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.uint8)], [np.zeros(0)], [np.zeros(0, np.uint8)]]
        lo = 0
        while lo < len(self.words):
            hi = max(lo + 1, int(np.searchsorted(weight, (weight[lo - 1] if lo else 0) + AT_ONCE)))
            a, b = edge2[lo], edge2[hi]
            for to, x in zip(out, trie.query(self.words[lo:hi], n2[lo:hi], f2[a:b], n3[a:b], f3[edge3[a] : edge3[b]], DISCOUNT)):
                to.append(x)
            lo = hi
        return [np.concatenate(x) for x in out]


def _mapped(levels: bytes, use):
    """What `use` makes of a trie whose levels are mapped from a temporary file; the file goes when the answer is there."""
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "levels")
        with open(path, "wb") as f:
            f.write(levels)
        trie = Trie(np.memmap(path, dtype=np.uint8, mode="r"))
        out = use(trie)
        del trie
    return out


ANSWER = "chunk string, shard int, asks boolean, a binary, b binary, c binary, d binary, e binary, n_tokens long, n_types long"


def _answered(group: pa.Table) -> pa.Table:
    """Each chunk's answers from one shard, the chunks themselves, and a row without a chunk that holds the shard's totals."""
    asked = group.filter(group.column("asks"))
    own = [(c, s, False, a, b, d, b"", b"", 0, 0) for c, s, asks, a, b, d in zip(*(group.column(k).to_pylist() for k in ("chunk", "shard", "asks")), *([x.as_py() if not q else None for x, q in zip(group.column(k), group.column("asks").to_pylist())] for k in BLOBS[:3])) if not asks]
    shard = Shard(asked)
    count, mass, code, mass2, code3 = _mapped(shard.levels(), shard.found)
    number = group.column("shard")[0].as_py()
    rows, i, j, k = own, 0, 0, 0
    for chunk, (n1, n2, n3) in zip(asked.column("chunk").to_pylist(), shard.sizes):
        w, p, t = shard.at[i : i + n1], shard.at2[j : j + n2], shard.at3[k : k + n3]
        rows.append((chunk, number, True, _small(count[w]), mass[w].astype(np.float32).tobytes(), code[p].tobytes(), mass_code(mass2[p]).tobytes(), code3[t].tobytes(), 0, 0))
        i, j, k = i + n1, j + n2, k + n3
    rows.append((None, number, False, b"", b"", b"", b"", b"", int(shard.total.sum()), int((shard.total > 0).sum())))
    kinds = (pa.string(), pa.int32(), pa.bool_(), *[pa.binary()] * 5, pa.int64(), pa.int64())
    return pa.table({c.split()[0]: pa.array(v, t) for c, v, t in zip(ANSWER.split(", "), zip(*rows), kinds)})


TRIE = "shard int, n_tokens long, n_types long, levels binary"


def _built(group: pa.Table) -> pa.Table:
    """One shard's trie from the counts of all chunks."""
    shard = Shard(group.filter(group.column("asks")))
    return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int32()), "n_tokens": pa.array([int(shard.total.sum())], pa.int64()), "n_types": pa.array([int((shard.total > 0).sum())], pa.int64()), "levels": pa.array([shard.levels()], pa.binary())})


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _summing(shards: int, total: int, types: int):
    def run(group: pa.Table) -> pa.Table:
        answers = {}
        for asks, s, a, b, c, d, e in zip(group.column("asks").to_pylist(), group.column("shard").to_pylist(), *(group.column(k) for k in "abcde")):
            if asks:
                answers[s] = [_numbers(a.as_py()), *(np.frombuffer(x.as_py(), t) for x, t in ((b, np.float32), (c, np.uint8), (d, np.uint16), (e, np.uint8)))]
            else:
                meta, plan, raw = a.as_py(), np.frombuffer(b.as_py(), np.int32).astype(np.int64), c.as_py()
        n = int(np.frombuffer(meta, np.int64, 1)[0])
        ids, size = np.frombuffer(meta, np.int64, n, 8), np.frombuffer(meta, np.int64, n, 8 + 8 * n)
        null, held = np.frombuffer(meta, bool, n, 8 + 16 * n), np.frombuffer(meta, bool, n, 8 + 17 * n)
        words, home = int(plan[0]), np.repeat(np.arange(shards), plan[1 : shards + 1])
        seq = _tokens_in(raw, home, shards)
        is_hot = np.zeros(words, dtype=bool)
        is_hot[plan[shards + 1 :]] = True
        first, second, shard, place = _pairs(words, home, is_hot, seq, shards)
        n3, third, ends, at3 = _triples(words, seq, place, len(first))
        count, mass, kept = np.zeros(words), np.zeros(words), np.zeros(len(first))
        count2, mass2, kept3 = np.zeros(len(first)), np.zeros(len(first)), np.zeros(len(third))
        left = lambda codes: np.where(codes > 0, np.maximum(CODES[codes] - DISCOUNT, 0), 0)
        for s, keys, _, at in _keys(home, is_hot, first, shard, shards):
            c, m, codes, m2, codes3 = answers[s]
            np.add.at(count, keys, np.where(home[keys] == s, c, 0))
            np.add.at(mass, keys, m)
            kept[at], count2[at], mass2[at] = left(codes), CODES[codes], mass_of(m2)
            kept3[_under(at, n3)] = left(codes3)
        base = (count + 1) / (total + types + 1)
        # quantised mass may reach the count: what is left over for other words is then one discount
        rest = np.maximum(count[first] - mass[first], DISCOUNT)
        p = np.where(count[first] > 0, (kept + rest * base[second]) / (mass[first] + rest), base[second])
        p = p[place]
        # a pair is the context of the token after it
        given = place[ends - 1]
        rest = np.maximum(count2[given] - mass2[given], DISCOUNT)
        p[ends] = np.where(count2[given] > 0, (kept3[at3] + rest * p[ends]) / (mass2[given] + rest), p[ends])
        edge = np.r_[0, np.cumsum(size)][:-1]
        word = seq[1:]
        add = lambda v: np.add.reduceat(v, edge) if n else np.zeros(0)
        return pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=null), "held_out": pa.array(held), "n_tokens": pa.array(size), "n_known": pa.array(add((count[word] > 0).astype(np.int64))),
            "train_tokens": pa.array(np.full(n, total, np.int64)), "base_score": pa.array(add(np.log10(base)[word])), "score": pa.array(add(np.log10(p))),
        })

    return run


def _frequent(docs: DataFrame) -> frozenset:
    ids = pick(docs.filter(F.col("doc_id").isNotNull()).select("doc_id"), HOT_SAMPLE, 7)
    c: Counter = Counter([END] * 1)
    for t in texts_of(docs, ids, HOT_BYTES).values():
        c.update(tokens(t))
        c[END] += 1
    n = sum(c.values())
    return frozenset(xxhash.xxh3_64_intdigest(w) for w, k in c.items() if k >= HOT_SHARE * n)


def _ready(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), MODULUS) == HELD).alias("held_out"), F.col("text").cast("string").alias("text"))


def _shards(docs: DataFrame) -> int:
    return 4 * partitions(docs.sparkSession)


def train(docs: DataFrame) -> DataFrame:
    """The model as a table: a row (shard, n_tokens, n_types, levels) for each shard."""
    return stored(_ready(docs).mapInArrow(_sending(_shards(docs), _frequent(docs.select("doc_id", "text"))), SENT).groupBy("shard").applyInArrow(_built, TRIE), "trie")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    shards = _shards(docs)
    sent = _ready(docs).mapInArrow(_sending(shards, _frequent(docs.select("doc_id", "text"))), SENT)
    answered = stored(sent.groupBy("shard").applyInArrow(_answered, ANSWER), "answers", "zstd")
    sums = answered.filter("chunk is null").agg(F.sum("n_tokens").alias("n"), F.sum("n_types").alias("v")).first()
    return answered.filter("chunk is not null").drop("n_tokens", "n_types").groupBy("chunk").applyInArrow(_summing(shards, int(sums.n or 0), int(sums.v or 0)), SCORES)


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
