"""Chat formatting, filter audit and token alignment beyond their queries: other templates, cuts, odd texts."""

import random

import pytest
from brute_alignment import alignment, encoders
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quillspan.llm import align as A, audit, chat as C

TEXT = st.text(alphabet="<>[]/sINST\\ a\n", max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), min_size=1, max_size=5))
def test_tagged_is_read_back(turns):
    out = C.tagged(turns)
    spans = [s.rendered for s in C.spans_of(C.Template(), iter(turns))]
    assert "".join(spans) == out and [C.read_tagged(s) for s in spans] == turns
    assert out.count("<s>") == out.count("</s>") == len(turns) and "[INST]" not in out and "[/INST]" not in out


def spans(template, turns):
    return list(C.spans_of(template, iter(turns)))


TURNS = [("user", "one"), ("assistant", "<think>x</think>two"), ("user", "three"), ("assistant", "four")]


def test_spans_of_unknown_templates():
    plain = C.Template(render=lambda ts: "BOS" + "".join(f"{r}: {t}\n" for r, t in ts), context=None)
    got = spans(plain, TURNS)
    assert [s.rendered for s in got] == [f"{r}: {t}\n" for r, t in TURNS] and not any(s.rewrites for s in got)
    assert [s.rendered[s.begin : s.end] for s in got] == [t for _, t in TURNS]

    def forgets(ts):  # what was thought goes when the user speaks again
        last = max((k for k, t in enumerate(ts) if t[0] == "user"), default=0)
        return "".join(f"{r}: {t.split('</think>')[-1] if k < last else t}\n" for k, (r, t) in enumerate(ts))

    assert [s.rewrites for s in spans(C.Template(render=forgets, context=None), TURNS)] == [False, False, True, False]
    assert all(s.rewrites for s in spans(C.Template(render=lambda ts: "".join(t for _, t in ts) + "END", context=None), TURNS))
    trims = spans(C.Template(render=lambda ts: "".join(f"[{t.strip()}]" for _, t in ts)), [("user", " a "), ("user", "b")])
    assert [s.rendered for s in trims] == ["[a]", "[b]"] and not any(s.rewrites for s in trims)
    hides = spans(C.Template(render=lambda ts: "".join(f"({r})" for r, _ in ts)), TURNS)
    assert all(s.rewrites for s in hides)  # the text isn't shown: nothing to train on


def test_a_long_conversation_by_windows():
    turns = [("user" if k % 2 else "assistant", f"t{k}") for k in range(3 * C.WINDOW + 5)]
    first = C.Template(render=lambda ts: "".join(f"{'' if k else 'BOS '}{ts[k - 1][0] if k else ''}>{r}: {t}\n" for k, (r, t) in enumerate(ts)), context=1)
    whole = C.Template(render=first.render, context=None)
    assert [s.rendered for s in spans(first, turns)] == [s.rendered for s in spans(whole, turns)]


def test_formatted_rows(spark):
    rows = [(1, 0, "user", "hi <s>"), (1, 1, "assistant", "</s>ö"), (None, 0, "assistant", None)]
    df = C.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r.conv_id, r.n): r for r in df.collect()}
    out = got[1, 0].rendered + got[1, 1].rendered
    assert out == C.tagged([(r, t) for _, _, r, t in rows[:2]])
    assert [C.unescape(out[r.text_start : r.text_end]) for r in (got[1, 0], got[1, 1])] == ["hi <s>", "</s>ö"]
    assert [got[k].trained for k in ((1, 0), (1, 1), (None, 0))] == [False, True, True] and got[None, 0].text_start == got[None, 0].text_end
    forgets = C.Template(render=lambda ts: "".join(f"{len(ts)}{t}" for _, t in ts), read=lambda s: ("assistant", s), plain=lambda t: t, context=None)
    two = [(1, 0, "user", "a"), (1, 1, "assistant", "b")]
    d = C.digests(spark.createDataFrame(two, "conv_id long, turn long, role string, text string"), forgets).first()
    assert d.rewrites == 1 and d.n_turns == 2


def test_replay_of_other_filters(spark):
    df = spark.createDataFrame([("p", True, False, True), ("p", True, True, False), ("q", False, False, True)], "part string, x boolean, y boolean, bad boolean")
    got = {(r.part, r.filter_order, r.step): r for r in audit.replay(df, ["x", "y"], {"bad_lost": "bad"}).collect()}
    assert len(got) == 8
    r = got["p", "yx", 2]
    assert (r.kept, r.removed, r.redundant, r.unique_fails, r.bad_lost, r.shapley) == (0, 1, 1, 1, 1, 3)
    assert got["q", "xy", 2].kept == 1 and got["q", "xy", 2].shapley == 0
    for bad in (["x"] * 2, [], list("abcdefgh")):
        with pytest.raises(ValueError, match="different filters"):
            audit.replay(df, bad, {})


def test_large_groups_of_copies(spark, monkeypatch):
    monkeypatch.setattr(audit, "HOT_GROUPS", 3)
    rows = [(k, "same") for k in range(50, 0, -1)] + [(k, f"t{k // 2}") for k in range(100, 120)] + [(None, "same"), (1, "same"), (None, None), (7, None)]
    got = audit.with_copies(spark.createDataFrame(rows, "doc_id long, key string"), "key", "copy").collect()
    seen = {k: min((i for i, x in rows if x == k and i is not None), default=None) for _, k in rows}
    assert sorted((r.doc_id is None, r.doc_id or 0, r.key or "", r.copy) for r in got) == sorted((i is None, i or 0, k or "", i is not None and k is not None and i > seen[k]) for i, k in rows)


ODD = [(1, None), (2, ""), (3, " "), (None, "abc def\nghi"), (None, None), (4, "a▁b the"), (5, "the the  x\n\n y \t z"), (5, "the the  x\n\n y \t z"), (5, "the other"), (6, "z" * 30_000), (7, "日本語 テキスト　全角 \U0001f600 x́ y"),
       (8, "<s> </s> <|endoftext|> <0x41> don't I'LL (a)b 1234567 a1b2\r\n\r\nq w\x00e \x85 f\x0b g ²."), (9, " lead"), (10, "trail "), (11, "\nnew"), (12, "\n"), (13, "▁"), (14, "x' 's 'sa a'.s !'s ...'t (don't) _a_ a--b\nC\n\nD\n E")]


def aligned(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit("clash")).repartition(3)
    out = A.alignment(df).select("doc_id", *A.SUMS, "groups_sha256")
    return sorted(repr(tuple(r)) for r in out.collect())


def test_alignment_of_odd_texts(spark):
    g = random.Random(3)
    noise = [(100 + k, "".join(g.choice("ab Zé'.,\n\t(-1９　́_") for _ in range(g.randint(1, 60)))) for k in range(150)]
    assert aligned(spark, ODD + noise) == sorted(map(repr, alignment(ODD + noise)))


def test_alignment_with_nothing_frequent_and_without_cuts(spark, monkeypatch):
    monkeypatch.setattr(A, "HOT_PIECES", ((0, 1),))
    monkeypatch.setattr(A, "HOT_PAIRS", 1)
    want = sorted(map(repr, alignment(ODD)))
    assert aligned(spark, ODD) == want
    monkeypatch.setattr(A, "cut_pattern", lambda folder: None)
    assert aligned(spark, ODD) == want


def test_pieces_tokenize_by_themselves(spark):
    """The cuts change no token: pieces' tokens one after the other are the text's."""
    of_a, of_b = encoders()
    texts = [t for _, t in ODD if t and "▁" not in t]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    e = A.encoded(rows.select("k", F.posexplode(A._pieces(F.col("text"), A.cut_pattern())).alias("pos", "piece"))).orderBy("k", "pos").collect()
    for k, t in enumerate(texts):
        assert [i for r in e if r.k == k for i in r.a_ids] == [i for i, _ in of_a(t)]
        assert [i for r in e if r.k == k for i in r.b_ids] == [i for i, _ in of_b(t)]
    assert all(r.ok for r in e)


def test_codes_tell_pieces_apart(spark, monkeypatch):
    """Where two pieces have one code, another seed is taken; few documents are put together at once without a difference."""
    monkeypatch.setattr(A, "_code", lambda piece, seed: F.xxhash64(F.substring(piece, 1, 1 + 3 * seed), F.lit(seed)))
    facts = spark.createDataFrame([(" the",), (" thus",), (" x",)], "piece string")
    assert A.telling_seed(facts) == 1
    monkeypatch.setattr(A, "AT_ONCE", 7)
    rows = [(k, t) for k, t in enumerate(["the thus x", None, "x x x x x x x x x x", "", "thus"])]
    assert aligned(spark, rows) == sorted(map(repr, alignment(rows)))
