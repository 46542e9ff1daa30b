"""Two tokenizers' tokens of the same text, aligned by byte offsets.

`aligned` is the alignment as relational steps, for any table of encoded texts: token arrays are exploded with their positions,
byte offsets are windowed sums of token lengths, an equi-join on (text, end) finds the offsets where tokens of both end (cuts), and
running counts of cuts number the groups between them.  Links come by group order: both sides tile the same bytes, so between
two neighbouring ends, of either side, lies exactly one token of A and one of B that overlap, and each overlapping pair has one
such stretch.  The joined rows are therefore the links; each takes its tokens from the next end of either side, where a join within
groups would make as many pairs as the square of a group's size.

The corpus isn't encoded text by text.  Both tokenizers always break before a space or line break that follows another character, and between
most signs and letters, so a document is cut there into pieces that encode, align and link by themselves (`cut_pattern` looks
this up in the vocabularies, and cuts nothing where it doesn't hold).  The steps above run once for each distinct piece; a pair's count is the sum over
pieces of their occurrences, and a document is the sequence of its pieces.  Pieces and pairs that make up more than a fixed share
of all rows, so that their number is bounded (HOT_PIECES, HOT_PAIRS), come to their rows by broadcast; the others by a shuffled join,
in which no key can be hot.

Edge cases: null and empty texts have no tokens, nor has a document with any piece whose tokens don't spell its bytes
(its pieces aren't counted); texts without spaces are one piece; repeated rows are counted and returned as often as they
stand; a null doc_id is kept; ties for a B id's highest count are all best; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import string
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import discard, dropping_shuffles, stored, table

#: Folder of the vocabulary files, on every machine.
VOCABULARIES = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pieces are broadcast that are shorter than a number of code points and make up more than one in so many of all pieces: (points, so many).
HOT_PIECES, HOT_PAIRS = ((24, 4_000_000), (10_000, 1_000)), 100_000
#: Pieces of documents that are put together at once, if one document doesn't have more.
AT_ONCE = 500_000
SPACE = "▁"
COPARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def _tokenizers(folder: str):
    """(A, bytes of its ids, B, bytes of its ids, B's id of a lone space); read once a task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{folder}/{A_FILE}")
    a.encode_special_tokens = True
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(c): c for c in shown} | {chr(0x100 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}
    a_bytes = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in a.get_vocab().items()}
    b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{B_FILE}")
    b_bytes = {i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace(SPACE, " ").encode() for i in range(b.get_piece_size())}
    return a, a_bytes, b, b_bytes, b.piece_to_id(SPACE)


def cut_pattern(folder: str = VOCABULARIES) -> str | None:
    """Where a text may be cut without a change to its tokens; None: nowhere.

    Cuts lie before a space or line break that follows another character, behind a single line break, and between letters and those
    signs that B has in no entry beside a letter.  A must split by the byte-level pattern, in which white space after
    another character, and signs (but apostrophes) after letters and letters after signs, always begin a new word.  B may have no entry in which
    a space follows another character, and none that holds a line break.
    """
    with open(f"{folder}/{A_FILE}") as f:
        split = json.load(f)["pre_tokenizer"]
    b = _tokenizers(folder)[2]
    entries = [b.id_to_piece(i) for i in range(b.get_piece_size()) if not (b.is_byte(i) or b.is_control(i) or b.is_unknown(i))]
    if split["type"] != "ByteLevel" or not split["use_regex"] or any("\n" in e or SPACE in e.lstrip(SPACE) for e in entries):
        return None
    beside = {x for e in entries for pair in zip(e, e[1:]) if any(c.isalpha() for c in pair) for x in pair}
    signs = "".join("\\" + c for c in string.punctuation if c != "'" and c not in beside)
    between = rf"|(?<=\p{{L}})(?=[{signs}])|(?<=[{signs}])(?=\p{{L}})" if signs else ""
    return rf"(?<=[^\p{{Z}}\p{{C}}])(?=[ \n])|(?<=[\p{{L}}\p{{N}}\p{{P}}]\n)(?=\p{{L}})" + between


_ENCODED = "array<int>", "array<int>", "array<int>", "array<int>", "boolean"


def encoded(texts: DataFrame, folder: str = VOCABULARIES) -> DataFrame:
    """texts (..., piece) with a_ids, a_lens, b_ids, b_lens (token bytes) and ok: both sides spell the piece's bytes.

    B puts a space before what it encodes (but not before nothing): it stands for a piece's own, or goes with the line break that is put
    between it and any other piece.
    """
    names = [c for c in texts.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, a_bytes, b, b_bytes, lone = _tokenizers(folder)
        for batch in batches:
            pieces = batch.column("piece").to_pylist()
            ids_a = [e.ids for e in a.encode_batch_fast(pieces, add_special_tokens=False)]
            ids_b = b.encode([p[1:] if p[:1] == " " else "\n" + p for p in pieces], num_threads=1)
            ids_b = [[lone] if p == " " else t if p[:1] == " " else t[2:] for p, t in zip(pieces, ids_b)]
            spelt_a, spelt_b = [[a_bytes[i] for i in x] for x in ids_a], [[b_bytes[i] for i in x] for x in ids_b]
            ok = [b"".join(x) == b"".join(y) == p.encode() for x, y, p in zip(spelt_a, spelt_b, pieces)]
            ints = pa.list_(pa.int32())
            more = [ids_a, [[*map(len, x)] for x in spelt_a], ids_b, [[*map(len, x)] for x in spelt_b]]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(m, ints) for m in more), pa.array(ok)], [*names, "a_ids", "a_lens", "b_ids", "b_lens", "ok"])

    new = ", ".join(f"{n} {t}" for n, t in zip(("a_ids", "a_lens", "b_ids", "b_lens", "ok"), _ENCODED))
    return texts.mapInArrow(run, f"{', '.join(f'`{n}` {t}' for n, t in texts.dtypes)}, {new}")


@contextmanager
def keeping_partitions(spark: SparkSession):
    """Joins on (id, ...) of tables that are both partitioned by id shuffle nothing again."""
    before = spark.conf.get(COPARTITION)
    spark.conf.set(COPARTITION, "false")
    try:
        yield
    finally:
        spark.conf.set(COPARTITION, before)


def _tokens(texts: DataFrame, side: str) -> DataFrame:
    """(id, end, <side>): a row for each token, at the byte where it ends."""
    t = texts.select("id", F.posexplode(F.arrays_zip(F.col(f"{side}_ids").alias("tok"), F.col(f"{side}_lens").alias("len"))).alias("pos", "t"))
    end = F.sum("t.len").over(Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return t.select("id", end.alias("end"), F.col("t.tok").alias(side))


def aligned(texts: DataFrame) -> DataFrame:
    """The links of each text: (id, at, grp, a, b, a_ends, b_ends).

    texts: (id, a_ids, a_lens, b_ids, b_lens), both sides of equal bytes in all, no token empty.  A link is a pair of overlapping
    tokens; at: the byte where their overlap ends; grp: the number of the group, from 0; a_ends, b_ends: whether the token ends there
    too, so that each token ends at exactly one link.
    """
    t = texts.repartition("id")
    both = _tokens(t, "a").join(_tokens(t, "b"), ["id", "end"], "full")
    back = Window.partitionBy("id").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.select("id", "end", F.col("a").isNotNull().alias("a_ends"), F.col("b").isNotNull().alias("b_ends"), F.last("a", True).over(back).alias("a"), F.last("b", True).over(back).alias("b"))
    before = Window.partitionBy("id").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    cuts = F.coalesce(F.sum((F.col("a_ends") & F.col("b_ends")).cast("int")).over(before), F.lit(0))
    return filled.select("id", F.col("end").alias("at"), cuts.cast("int").alias("grp"), "a", "b", "a_ends", "b_ends")


def group_text(links: Column) -> Column:
    """a1,a2|b1;a3|b2,b3 from a text's links: tokens by group, side and place, each behind the sign that parts it from the one before."""
    side = lambda k, ends, tok: F.transform(F.filter(links, lambda x: x[ends]), lambda x: F.struct(x["grp"].alias("grp"), F.lit(k).alias("side"), x["at"].alias("at"), x[tok].alias("tok")))
    tokens = F.array_sort(F.concat(side(0, "a_ends", "a"), side(1, "b_ends", "b")))

    def signed(all_: Column) -> Column:
        last = lambda k: F.get(all_, k - 1)
        sign = lambda x, k: F.when(k == 0, "").when(last(k)["grp"] != x["grp"], ";").when(last(k)["side"] != x["side"], "|").otherwise(",")
        return F.array_join(F.transform(all_, lambda x, k: F.concat(sign(x, k), x["tok"].cast("string"))), "")

    # the sorted array is settled as the one element of an array: an expression would run again at each look-up
    return F.get(F.transform(F.array(tokens), signed), F.lit(0))


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, n, rows, best): how often each id pair is linked, weighted by n; best: no other A id has more with this B id.

    A B id's pairs are at most as many as A has ids, so the window over them is bounded.
    """
    pairs = links.groupBy("a", "b").agg(F.sum("occ").alias("n"), F.count("*").alias("rows"))
    return pairs.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def by_share(left: DataFrame, right: DataFrame, on: list[str], hot: Column) -> DataFrame:
    """left's rows with right's: those of hot keys by broadcast, the others by a shuffled join.

    hot must hold for a bounded number of right's rows, and for every key with a large share of left's.
    """
    large = right.filter(hot)
    rest = left.join(F.broadcast(large.select(*on)), on, "left_anti").join(right.filter(~hot), on)
    return left.join(F.broadcast(large), on).unionByName(rest)


def _key(docs: DataFrame) -> DataFrame:
    """(d, none, h, text) for each row: doc_id (0 where there is none), whether there is none, a hash of the text, and the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("none"), F.xxhash64(text).alias("h"), text.alias("text"))


ROW = ["d", "none", "h"]


def _pieces(text: Column, cuts: str | None) -> Column:
    """space + text, cut into pieces; null for empty texts."""
    whole = F.concat(F.lit(" "), text)
    return F.when(text != "", F.split(whole, cuts) if cuts else F.array(whole))


def _counted(docs: DataFrame, cuts: str | None, folder: str) -> DataFrame:
    """(id, piece, occ, a_ids, ...) of each distinct piece: occurrences in documents whose tokens spell their bytes."""
    words = lambda x: x.select(*(c for c in x.columns if c != "text"), F.explode(_pieces(F.col("text"), cuts)).alias("piece"))
    found = words(docs.select("text")).groupBy("piece").agg(F.count("*").alias("occ"))
    out = stored(encoded(found, folder).withColumn("id", F.monotonically_increasing_id()), "pieces")
    bad = out.filter("not ok").select("piece")
    if bad.isEmpty():
        return out
    # documents with such a piece have no tokens: their other pieces are taken off again
    spoilt = words(docs).join(bad, "piece", "left_semi").select(*ROW).distinct()
    less = words(docs.join(spoilt, ROW, "left_semi")).groupBy("piece").agg(F.count("*").alias("less"))
    kept = stored(out.join(less, "piece", "left").withColumn("occ", F.col("occ") - F.coalesce("less", F.lit(0))).drop("less"), "pieces")
    discard(out)
    return kept


SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def piece_facts(pieces: DataFrame) -> DataFrame:
    """(piece, occ, ok, groups, n_a, n_b, n_groups, n_links, n_best, count_sum) of each distinct piece; a stored table."""
    spark = pieces.sparkSession
    link = F.struct("at", "grp", "a", "b", "a_ends", "b_ends")
    with keeping_partitions(spark):
        found = aligned(pieces.filter("ok").select("id", "a_ids", "a_lens", "b_ids", "b_lens")).groupBy("id").agg(F.collect_list(link).alias("links"))
        own = pieces.select("id", "piece", "occ", "ok", F.size("a_ids").alias("n_a"), F.size("b_ids").alias("n_b")).repartition("id")
        lists = stored(own.join(found, "id", "left"), "links")
    links = lists.select("id", "occ", F.explode("links").alias("l")).select("id", "occ", "l.a", "l.b")
    pairs = stored(pair_counts(links), "pairs")
    total = pairs.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    scored = by_share(links.drop("occ"), pairs, ["a", "b"], F.col("rows") * HOT_PAIRS > total).groupBy("id").agg(F.count_if("best").alias("n_best"), F.sum("n").alias("count_sum"))
    last = F.array_max(F.transform("links", lambda x: x["grp"]))
    shown = lists.select("id", "piece", "occ", "ok", "n_a", "n_b", (last + 1).alias("n_groups"), F.when(F.col("links").isNotNull(), F.size("links")).alias("n_links"), group_text(F.col("links")).alias("groups"))
    out = shown.join(scored, "id", "left")
    facts = stored(out.select("piece", "occ", "ok", "groups", *(F.coalesce(F.col(n).cast("long"), F.lit(0)).alias(n) for n in SUMS)), "facts")
    discard(lists, pairs)
    return facts


def _code(piece: Column, seed: int) -> Column:
    return F.xxhash64(piece, F.lit(seed))


def telling_seed(facts: DataFrame, first: int = 0) -> int:
    """A seed by which no two of the corpus' distinct pieces have the same code, so that codes can stand for pieces."""
    with dropping_shuffles(facts.sparkSession):
        return next(s for s in itertools.count(first) if facts.groupBy(_code(F.col("piece"), s)).count().filter("count > 1").isEmpty())


def documents(docs: DataFrame, facts: DataFrame, cuts: str | None) -> DataFrame:
    """(doc_id, sums of its pieces' facts, groups_sha256): a row for each row of docs, put together from the facts of its pieces.

    Facts of frequent pieces go to every task: their number is bounded by HOT_PIECES.  A document's other pieces, named by their
    place, are joined with their facts and come back to it as one list.  Pieces travel as codes of 64 bits, all different.
    """
    spark = docs.sparkSession
    total = facts.agg(F.coalesce(F.sum("occ"), F.lit(0))).first()[0]
    seed = telling_seed(facts)
    is_hot = functools.reduce(lambda a, b: a | b, ((F.length("piece") < points) & (F.col("occ") * share > total) for points, share in HOT_PIECES))
    coded = facts.withColumn("code", _code(F.col("piece"), seed)).select("code", is_hot.alias("hot"), "ok", "groups", *SUMS)
    hot, rest = coded.filter("hot").drop("hot"), coded.filter("not hot").drop("hot")
    frequent, sink = hot.toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, frequent.schema) as out:
        out.write_table(frequent)
    known = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    # a text travels once: both uses below read the same exchange
    one = docs.groupBy(*ROW).agg(F.first("text").alias("text"), F.count("*").alias("copies")).filter("copies > 0")
    codes = F.transform(_pieces(F.col("text"), cuts), lambda p: _code(p, seed))
    words = one.select(*ROW, F.posexplode(codes).alias("pos", "code"))
    rare = words.join(F.broadcast(hot.select("code")), "code", "left_anti").join(rest, "code")
    fetched = rare.groupBy(*ROW).agg(F.min("ok").alias("ok"), *(F.sum(s).alias(s) for s in SUMS), F.collect_list(F.struct("pos", "groups")).alias("said"))
    fetched = fetched.withColumn("said", F.transform(F.array_sort("said"), lambda x: x["groups"]))
    x = one.join(fetched, ROW, "left").select(F.when(~F.col("none"), F.col("d")).alias("doc_id"), "copies", codes.alias("codes"), "ok", *SUMS, "said")
    put = x.mapInArrow(_put_together(known), f"doc_id long, copies long, {', '.join(f'{s} long' for s in SUMS)}, groups_sha256 string")
    return put.withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).drop("copies")


def _put_together(known):
    """Documents from the facts of their pieces, many at a time and by column; frequent pieces are looked up by their codes."""
    names = ["doc_id", "copies", *SUMS, "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pandas as pd
        import pyarrow.compute as pc

        frequent = pa.ipc.open_stream(known.value).read_all().combine_chunks()
        place = pd.Index(frequent.column("code").to_numpy())
        whole = lambda c: pa.concat_arrays(frequent.column(c).chunks) if len(frequent) else pa.array([], frequent.schema.field(c).type)
        groups, last = whole("groups"), len(frequent)
        # behind the frequent pieces stands one for all others, which adds nothing
        ok = np.r_[whole("ok").to_numpy(zero_copy_only=False).astype(bool), True]
        sums = [np.r_[whole(c).to_numpy(zero_copy_only=False), 0].astype("int64") for c in SUMS]

        def put(b: pa.RecordBatch) -> pa.RecordBatch:
            n = pc.fill_null(pc.list_value_length(b.column("codes")), 0).to_numpy(zero_copy_only=False).astype("int64")
            at = place.get_indexer(b.column("codes").flatten().to_numpy())
            # the pieces that aren't frequent stand in the order of what was fetched for them
            other = at < 0
            known_at = np.where(other, last, at)
            at[other] = last + np.arange(other.sum())
            said = pa.concat_arrays([groups, b.column("said").flatten().cast(groups.type)]).take(pa.array(at))
            ends = np.r_[0, np.cumsum(n)]
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), said), ";")
            some = n > 0
            per = np.zeros(len(n), "int64")
            each = lambda v, f: f.reduceat(v[known_at], ends[:-1][some]) if some.any() else v[:0]
            good = some & pc.fill_null(b.column("ok"), True).to_numpy(zero_copy_only=False).astype(bool)
            good[some] &= each(ok, np.logical_and)
            out = []
            for c, v in zip(SUMS, sums):
                mine = per.copy()
                mine[some] = each(v, np.add)
                out.append(pa.array(np.where(good, mine + pc.fill_null(b.column(c), 0).to_numpy(zero_copy_only=False), 0)))
            digests = [hashlib.sha256(t.as_buffer()).hexdigest() if g else "" for g, t in zip(good, text)]
            return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("copies"), *out, pa.array(digests, pa.string())], names)

        for batch in batches:
            n = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("codes")), 0).to_numpy(zero_copy_only=False).astype("int64"))
            first = 0
            while first < batch.num_rows:
                before = n[first - 1] if first else 0
                end = max(first + 1, int(np.searchsorted(n, before + AT_ONCE, side="right")))
                yield put(batch.slice(first, end - first))
                first = end

    return run


def alignment(docs: DataFrame, folder: str = VOCABULARIES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of documents."""
    rows, cuts = _key(docs), cut_pattern(folder)
    pieces = _counted(rows, cuts, folder)
    facts = piece_facts(pieces)
    discard(pieces)
    return documents(rows, facts, cuts)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"))
