"""The corpus operators against brute force, and on the cases that their docstrings define."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import decontaminate as D, eliasfano as E, fmindex as FM, jaccard as J, linededup as L, lm, mixing as M, quality as Q, rules as R, sharding as S, toxicity as T, urlfilter as U
from quillspan.llm.graph import components, local_labels

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def corpus(spark):
    """Random words, near and exact copies, shared passages, repeats, and every odd case: null, empty, long, doubled rows."""
    g = random.Random(7)
    vocab = [f"w{k}" for k in range(400)]
    say = lambda n: " ".join(g.choice(vocab) for _ in range(n))
    passage = say(60)
    rows = [(k, say(g.randint(1, 120)) if k % 5 else f"{say(20)}\n{passage}\n{say(20)}", f"s{k % 4}" if k % 3 else "hot") for k in range(120)]
    base = say(200)
    for k in range(200, 240):
        w = base.split()
        for _ in range(g.randint(0, 4)):
            w[g.randrange(len(w))] = g.choice(vocab)
        rows.append((k, " ".join(w), "hot"))
    rows += [(300, None, "s1"), (301, "", None), (302, "   \n ", "s2"), (None, say(30), "s3"), (303, base, "hot"), (303, base, "hot"), (304, "one", "s1"), (305, "ONE", "s1"), (306, "x" * 50_000, "s2"), (307, say(9000), "s0"), (308, "$$$ ### | a | b", "s0")]
    return rows


@pytest.fixture(scope="module")
def labels(spark, corpus):
    return spark.createDataFrame([(i, int(k % 3 > 0), int(k % 7 == 0)) for k, (i, _, _) in enumerate(corpus)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")


def collected(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_jaccard_join(spark, corpus, monkeypatch):
    def expected():
        sets = []
        for i, t, _ in corpus:
            w = (t or "").encode().lower().split()
            sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
        up = list(range(len(sets)))

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a in range(len(sets)):
            for b in range(a):
                x, y = sets[a][1], sets[b][1]
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    up[find(a)] = find(b)
        least = {}
        for k, (i, s) in enumerate(sets):
            if i is not None:
                least[find(k)] = min(i, least.get(find(k), i))
        return sorted(repr((i, len(s), least.get(find(k)) if s else i)) for k, (i, s) in enumerate(sets))

    want = expected()
    df = frame(spark, corpus).repartition(3)
    assert collected(J.near_groups(df)) == want
    # small blocks, tiles and flushes: links across blocks, products in ranges of columns and strays come into play
    for name, value in (("BLOCK", 3), ("GATHER", 5), ("TILE", 2), ("COLUMNS", 16), ("FLUSH", 50)):
        monkeypatch.setattr(J, name, value)
    assert collected(J.near_groups(df)) == want
    assert J.near_groups(df.limit(0)).count() == 0
    kept = J.one_of_each(df.withColumn("label", F.lit("clash"))).collect()
    assert {r.doc_id for r in kept} == {eval(x)[2] for x in want if eval(x)[1] and eval(x)[2] is not None} | {i for i, t, _ in corpus if not (t or "").split()} | {i for i, _, _ in corpus if i is None}


def test_one_of_each_keeps_rows_without_words(spark):
    rows = [(None, "", "a"), (None, "", "b"), (None, None, "a"), (None, None, "a"), (1, "", "x"), (1, "", "y"), (2, " \n\t", "x"), (3, "one two three", "z"), (3, "one two three", "y"), (4, "one two three", "x"), (5, " ", "x")]
    got = J.one_of_each(frame(spark, rows).repartition(3)).collect()
    assert sorted(repr((r.doc_id, r.text, r.source)) for r in got) == sorted(map(repr, rows[:7] + [rows[8], rows[10]]))


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 6), (9, 7), (7, 8), (3, 10)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.label for r in components(df).collect()} == {1: 1, 2: 1, 3: 1, 10: 1, 5: 5, 6: 5, 7: 7, 8: 7, 9: 7}
    n, lab = local_labels(*map(np.array, zip(*edges)))
    assert dict(zip(n.tolist(), lab.tolist())) == {1: 1, 2: 1, 3: 1, 10: 1, 5: 5, 6: 5, 7: 7, 8: 7, 9: 7}


def test_fm_index():
    g = np.random.default_rng(3)
    s = g.integers(1, 6, 700)
    f = FM.FMIndex(s, 6)
    for m in (1, 2, 5, 9):
        p = np.array([s[i : i + m] for i in range(0, 650, 50)] + [g.integers(1, 6, m) for _ in range(10)])
        lo, hi = f.ranges(p, np.full(len(p), m))
        for row, a, b in zip(p, lo, hi):
            assert sorted(f.locate(np.arange(a, b)).tolist()) == [i for i in range(len(s) - m + 1) if (s[i : i + m] == row).all()]


def test_decontamination(spark, corpus, monkeypatch):
    passage = corpus[0][1].split("\n")[1]
    items = [(1, " ".join(passage.upper().split()[5:30])), (2, "one"), (3, None), (4, "!!"), (10, corpus[3][1]), (10, passage)]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def brute(text):
        w, hit, found = D.words(text), set(), set()
        for name, t in items:
            v = D.words(t)
            for k in range(max(1, len(v) - 9) if v else 0):
                x = v[k : k + 10]
                for a in range(len(w) - len(x) + 1):
                    if w[a : a + len(x)] == x:
                        hit.update(range(a, a + len(x))), found.add(str(name))
        return len(w), len(hit), sorted(found)

    want = sorted(repr((i, *brute(t))) for i, t, _ in corpus)
    df = frame(spark, corpus)
    for _ in range(2):
        got = D.spans(df.select("doc_id", "text"), bench)
        n = F.aggregate("_spans", F.lit(0), lambda a, s: a + s["stop"] - s["start"])
        assert collected(got.select("doc_id", "_words", n, "_items")) == want
        for k, v in (("BLOCK_WORDS", 20), ("SHARD_TOKENS", 500), ("LOCATE", 7)):
            monkeypatch.setattr(D, k, v)
    one = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert D.spans(D.clean(df, one), one).filter("size(_spans) > 0").count() == 0
    dropped = D.clean(df.withColumn("n_words", F.lit(1)), one, cut=False)
    assert dropped.columns == [*DOCS.replace(",", "").split()[::2], "n_words"] and dropped.count() == sum(passage not in (t or "") for _, t, _ in corpus)
    assert D.cut_spans("A b-c, D e", [(1, 3)]) == "A , D e"
    assert D.spans(df.limit(0), bench).count() == 0 and D.spans(df.select("doc_id", "text"), bench.limit(0)).count() == len(corpus)


def test_elias_fano():
    g = np.random.default_rng(1)
    for top in (5, 1000, 1 << 40, 1 << 64):
        v = np.sort(g.integers(0, top - 1, 300, dtype=np.uint64))
        q = np.concatenate([v, g.integers(0, top - 1, 300, dtype=np.uint64)])
        low, high = E.Sequence.parts(v, top)
        s = E.Sequence(len(v), low, high)
        assert (s.get(np.arange(len(v))) == v).all() and (s.successor(q) == np.searchsorted(v, q)).all()


def test_language_model_of_order_three(spark, corpus, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 1500)
    got = lm.score(frame(spark, corpus)).collect()
    text = [(i, lm.tokens(t) + [lm.END]) for i, t, _ in corpus]
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    as_kept = lambda k: float(E.CODES[E.quantised(np.array([k]))[0]])
    seen = [t for i, t in text if not fold(i)]
    one = Counter(w for t in seen for w in t)
    two = {k: as_kept(c) for k, c in Counter(p for t in seen for p in zip([lm.END, *t], t)).items()}
    three = {k: as_kept(c) for k, c in Counter(p for t in seen for p in zip([lm.END, *t], t, t[1:])).items()}
    n, v, mass = sum(one.values()), len(one), Counter()
    for g in (two, three):
        for k, c in g.items():
            mass[k[:-1]] += max(c - lm.DISCOUNT, 0)
    for k, m in mass.items():
        if len(k) == 2:
            mass[k] = float(lm.mass_of(lm.mass_code(np.array([m])))[0])

    def p(context, w):
        if not context:
            return (one[w] + 1) / (n + v + 1)
        c = one[context[0]] if len(context) == 1 else two.get(context, 0)
        g, lower = (two if len(context) == 1 else three).get((*context, w), 0), p(context[1:], w)
        rest = max(c - mass[context], lm.DISCOUNT)
        return (max(g - lm.DISCOUNT, 0) + rest * lower) / (mass[context] + rest) if c else lower

    want = []
    for i, t in text:
        tokens = [p((lm.END,), t[0])] + [p(x, w) for x, w in zip(zip([lm.END, *t], t), t[1:])]
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t)
        want.append((i, fold(i), len(t), sum(one[w] > 0 for w in t), n, round(base, 5), round(sum(math.log10(x) for x in tokens), 5)))
    assert sorted(repr((*tuple(r)[:5], round(r.base_score, 5), round(r.score, 5))) for r in got) == sorted(map(repr, want))
    monkeypatch.setattr(lm, "AT_ONCE", 40)
    assert collected(lm.score(frame(spark, corpus)).select("doc_id", F.round("score", 5))) == sorted(repr((x[0], x[-1])) for x in want)
    assert lm.train(frame(spark, corpus)).agg(F.sum("n_tokens"), F.sum("n_types")).first()[:] == (n, v)
    assert lm.score(frame(spark, corpus).limit(0)).count() == 0


def test_op7_scores_passages_seen_once(spark, tmp_path):
    """A held-out copy of one training document scores far above the same words in another order."""
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2]
    free = [i for i in range(100) if i not in held]
    g = random.Random(3)
    w = [f"v{k}" for k in range(40)]
    say = lambda n: " ".join(g.choice(w) for _ in range(n))
    once = say(50)
    mixed = once.split()
    g.shuffle(mixed)
    rows = [(i, say(60), "s") for i in free[1:]] + [(free[0], once, "s"), (held[0], once, "s"), (held[1], " ".join(mixed), "s")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    score = {r.doc_id: r.score / r.n_tokens for r in lm.op7_lm(spark, str(tmp_path)).collect()}
    assert score[held[0]] > score[held[1]] + 0.4


def test_lm_with_nothing_to_learn(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.score(frame(spark, [(held, "a b", "s")])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_mixing(spark, corpus):
    df = frame(spark, corpus)
    m = M.mix(df).collect()
    assert len(m) == len(corpus)
    size = Counter()
    for _, t, s in corpus:
        size[s] += len((t or "").split())
    weights = dict(zip(sorted(size, key=lambda s: (s is None, s or "")), [3, 1, 2] * 9))
    budget, open_, target = 1.5 * sum(size.values()), set(size), {}
    while open_:
        level = (budget - sum(target.values())) / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * level > 2 * size[s]}
        if not full:
            target |= {s: weights[s] * level for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in full}
        open_ -= full
    taken = Counter()
    for r in m:
        assert r._mix_target == pytest.approx(target[r.source]) and r._mix_times in (0, 1, 2) and r._mix_source_size == size[r.source]
        taken[r.source] += r._mix_size * r._mix_times
    assert sum(taken.values()) <= budget
    assert all(taken[s] <= target[s] + 1e-6 for s in size)
    assert M.mixed(df).count() == sum(r._mix_times for r in m) and M.mixed(df).columns == df.columns
    assert collected(M.mix(df, ["doc_id", "source"])) == collected(M.mix(df.repartition(5), ["doc_id", "source"]))
    assert M.mix(df.limit(0)).count() == 0


def test_sharding(spark):
    names = S.shard_names(7)
    t = S.lookup_table(names, 211)
    assert max(Counter(t).values()) - min(Counter(t).values()) <= 1
    fewer = S.lookup_table(names[:-1], 211)
    assert sum(a != b for a, b in zip(t, fewer) if a != 6) < 211 / 4
    for bad in (([], 211), (names, 210), (["a", "a"], 211), (names, 5)):
        with pytest.raises(ValueError):
            S.lookup_table(*bad)
    df = frame(spark, [(1, "a", "s"), (1, "b", "s"), (None, None, None)]).withColumn("slot", F.lit("clash"))
    got = S.place(df, names=names, slots=211).collect()
    assert got[0].shard == got[1].shard
    for r in got:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.slot == int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 211 and r.shard == t[r.slot]


def test_url_filter(spark):
    rows = [("spam.org", "block", "add", "2024-01-10"), ("spam.org", "block", "remove", "2024-02-10"), ("ok.spam.org", "allow", "add", "2024-01-01"), ("b.net", "block", "add", "2024-03-01"), ("b.net", "block", "remove", "2024-03-01")]
    caps = [("http://spam.org/x", "2024-01-09"), ("http://www.SPAM.org", "2024-01-10"), ("https://u@ok.spam.org:8/", "2024-01-15"), ("http://spam.org", "2024-02-10"), ("http://notspam.org", "2024-01-15"), (None, "2024-01-15"), ("nonsense", "2024-01-15"), ("http://spam.org", None), ("http://b.net/", "2024-03-02"), ("http://spam.org/x", "2024-01-20"), ("http://spam.org/x", "2024-01-20")]
    df = spark.createDataFrame([(u, d, "clash") for u, d in caps], "url string, fetched string, host string")
    e = spark.createDataFrame([*rows, (None, "block", "add", "2024-01-01")], "domain string, verdict string, action string, day string")
    got = sorted((r.url or "", r.fetched or "", r.blocked, r.matched_domain) for r in U.filter_urls(df, e).collect())
    want = [(u or "", d or "", False, None) for u, d in caps]
    want[1], want[2] = (*caps[1], True, "spam.org"), (*caps[2], False, "ok.spam.org")
    want[9] = want[10] = (*caps[9], True, "spam.org")
    assert got == sorted(want, key=lambda x: x[:2]) or sorted(map(repr, got)) == sorted(map(repr, want))
    assert U.filter_urls(df, e.limit(0)).filter("blocked").count() == 0 and U.filter_urls(df.limit(0), e).count() == 0


def test_line_dedup(spark):
    rows = [(k, f"own text number{'abcdefgh'[k % 8]} {chr(97 + k)}{chr(98 + k)} is here\nPosted by user{k} on day {k} in May 2024\nshort\n\nall rights reserved here", "s") for k in range(8)] + [(90, None, "s"), (91, "", "s"), (92, "no\nsuch", "s")]
    got = {r.doc_id: r for r in L.dedup(frame(spark, rows).withColumn("line", F.lit(1))).collect()}
    assert all(got[k].text == rows[k][1].split("\n")[0] + "\nshort\n" for k in range(8)) and got[3]._ld_dropped == 2 and got[3]._ld_lines == 5
    assert got[90].text is None and got[91].text == "" and got[92].text == "no\nsuch" and got[92]._ld_dropped == 0
    assert L.dedup(frame(spark, rows).limit(0)).count() == 0


def test_rules(spark, corpus, labels):
    def brute(t):
        w = (t or "").split()
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines, old, dup = (t or "").split("\n"), set(), 0
        for x in lines:
            if x.split():
                dup += x in old
                old.add(x)
        return len(w), sum(map(len, w)), sum((t or "").count(s) for s in "#*$%&|<>"), dup, len(again)

    for t in ("a b c d e f g h " * 3, "x\nx\n \n\nx y", None, "", "a b c d e f g h", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8"):
        assert R.statistics(t) == brute(t)
    df = frame(spark, corpus)
    out = R.judge(df, R.fit(df, labels)).collect()
    assert len(out) == len(corpus) and all(not r.kept for r in out if r.base_failed)
    assert all(r.kept != r.base_failed for r in R.judge(df, R.fit(df, labels.limit(0))).collect())
    g = np.random.default_rng(0)
    x = np.r_[g.normal(0, 1, (300, 2)), [[9, 9]]]
    z = R.Forest(x).score(x)
    assert z.argmax() == 300


def test_quality(spark):
    g = random.Random(1)
    good = lambda: " ".join(g.choice("alpha beta gamma delta mu nu pi rho tau chi".split()) + str(g.randint(0, 99)) for _ in range(80))
    bad = lambda: " | ".join(["$$$", "x"] * 30)
    rows = [(k, bad() if k % 4 == 0 else good(), "s") for k in range(400)]
    df = frame(spark, rows)
    lab = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    model = Q.fit(df, lab)
    assert 0.55 < model["prior"] < 0.95
    out = Q.score(df, model).collect()
    right = [r.predicted == int(r.doc_id % 4 > 0) for r in out if r.held_out]
    assert sum(right) / len(right) > 0.95 and all(0 <= r.score <= 1 and (r.score >= 0.7) == bool(r.predicted) for r in out)
    assert {r.score for r in Q.score(df, Q.fit(df, lab.limit(0))).collect()} == {0.5}
    assert 0.4 < Q.estimate_prior(np.ones(500), np.r_[np.ones(250), np.zeros(250)]) < 0.6


def test_toxicity(spark, corpus, labels):
    g = random.Random(2)
    words = ["".join(g.choice("abcdefghilmnoprstu") for _ in range(g.randint(3, 8))) for _ in range(3000)]
    say = lambda tox: " ".join(g.choice(["wretchling", "snivelbag", "grubmuncher"]) if tox and g.random() < 0.1 else g.choice(words) for _ in range(120))
    df = frame(spark, [(k, say(k % 5 == 0), "s") for k in range(500)])
    lab = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(500)], "doc_id long, quality int, toxic int")
    model = T.fit(df, lab)
    out = T.score(df, model).collect()
    right = [r.predicted == int(r.doc_id % 5 == 0) for r in out if r.held_out]
    assert len(right) > 100 and sum(right) / len(right) > 0.95
    odd = frame(spark, corpus)
    assert T.score(odd, model).count() == len(corpus) and T.score(odd.limit(0), model).count() == 0
    assert {r.score for r in T.score(odd, T.fit(odd, labels.limit(0))).collect()} == {0.0}
    kept = T.without_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == sum(not r.predicted for r in out)


def test_pipeline(spark, corpus, labels, tmp_path):
    import corpus_pipeline as P

    df = frame(spark, corpus)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    passage = corpus[0][1].split("\n")[1]
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = P.run(spark, str(tmp_path)).collect()
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert out and all(passage not in (r.text or "") for r in out) and set(out[0].asDict()) == {*df.columns, "slot", "shard"}
    assert max(Counter((r.doc_id, r.text) for r in out).values()) <= 2
