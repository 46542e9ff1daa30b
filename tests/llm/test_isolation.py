"""The verdict of the isolation forests, row by row: the same trees walked one split at a time."""

import numpy as np

from quillspan.llm import rules as R


def walked(forest, row):
    total = 0.0
    for feature, cut, left, length in forest.trees:
        at = 0
        while feature[at] >= 0:
            at = left[at] + (1 if row[feature[at]] >= cut[at] else 0)
        total += length[at]
    n = forest.size
    expected = 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
    return 2.0 ** (-total / len(forest.trees) / expected)


def test_verdicts_follow_the_paths(spark):
    g = np.random.default_rng(4)
    words = lambda n: " ".join(g.choice(["kaber", "lodal", "mifen", "nugor"]) + str(g.integers(0, 400)) for _ in range(n))
    texts = [words(int(g.integers(25, 90))) for _ in range(150)] + [words(40).replace(" ", " ## ") for _ in range(12)] + ["\n".join([words(9)] * 2 + [words(30)]) for _ in range(12)] + ["", "few words", None]
    s = np.array([R.statistics(t) for t in texts])
    x = R.ratios(s[~R.base_failed(s)])
    forests = R.grown(x)
    # the same forests again, from the same rows and seeds, as trees
    trees = [R.Forest(x[:, [k]], 6 + k) for k in range(x.shape[1])] + [R.Forest(x)]
    cuts = np.quantile(R.anomalies(forests, x), 0.97, axis=0)
    cuts[1] = np.inf
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in R.judge(rows, {"forests": forests, "cuts": cuts}).collect()}
    dropped = 0
    for k, t in enumerate(texts):
        row = R.ratios(s[[k]])[0]
        score = [walked(f, row[[i]] if i < len(row) else row) for i, f in enumerate(trees)]
        failed = s[k][0] < 20 or 100 * s[k][4] > 30 * s[k][0]
        over = any(a > c for a, c in zip(score, cuts))
        assert abs(got[k].anomaly - max(a / c for a, c in zip(score, cuts))) < 1e-9
        assert got[k].base_failed == failed and got[k].kept == (not failed and not over)
        dropped += over and not failed
    assert 0 < dropped < 40


def test_thresholds_err_least():
    """Each threshold is the best single cut on what the better ones leave, by trying every cut."""
    g = np.random.default_rng(6)
    for _ in range(30):
        z, bad, w = g.integers(0, 12, (40, 3)) / 10, (g.random(40) < 0.3).astype(int), g.random(40) + 0.1
        z[:, 0] += bad * 0.5

        def least(col, rows):
            tries = [-1.0, *sorted(set(z[rows, col]))]
            return min(w[rows][(z[rows, col] > c) != (bad[rows] == 1)].sum() for c in tries)

        every = np.ones(40, dtype=bool)
        cuts = R.calibrated(z, bad, w)
        left = every.copy()
        for k in sorted(range(3), key=lambda k: (least(k, every), k)):
            if not left.any():
                break
            if cuts[k] < np.inf:
                assert abs(w[left][(z[left, k] > cuts[k]) != (bad[left] == 1)].sum() - least(k, left)) < 1e-9
                left &= z[:, k] <= cuts[k]


def test_trees_and_thresholds_of_every_row(spark, monkeypatch):
    """No row is left out: leaves count all sound documents, and the first threshold errs as little as any on all labelled ones."""
    monkeypatch.setattr(R, "CHUNK", 700, raising=False)
    g = np.random.default_rng(8)
    docs = [(k, " ".join([g.choice(["kaber", "lodal", "mi"]) + str(j) for j in range(g.integers(20, 90))] + [f"#{j}" for j in range(g.integers(1, 30) if k % 9 == 0 else g.integers(0, 3))])) for k in range(5000)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(k, int(k % 9 > 0)) for k in range(5000)], "doc_id long, quality int")
    model = R.fit(rows, labels)
    x = R.ratios(np.array([R.statistics(t) for _, t in docs]))
    (*_, (cols, every)) = model["forests"]
    assert every.size == len(docs) and len(model["cuts"]) == len(model["forests"]) == 6
    for feature, cut, left, length in every.trees[:3]:
        at = R._leaf((feature, cut, left), x, np.arange(len(x)))
        for leaf, n in zip(*np.unique(at, return_counts=True)):
            depth, up = 0, leaf
            while up:
                up, depth = next(k for k in range(len(left)) if feature[k] >= 0 and up - left[k] in (0, 1)), depth + 1
            assert abs(length[leaf] - depth - every._rest(int(n))) < 1e-9
    # the same forests, grown from the rows in one place
    assert all(np.allclose(a.score(x[:, c]), b.score(x[:, c])) for (c, a), (_, b) in zip(model["forests"], R.grown(x)))
    z, bad = R.anomalies(model["forests"], x), np.array([k % 9 == 0 for k, _ in docs])
    one = int(np.argmin([min(((z[:, k] > c) != bad).sum() for c in np.unique(z[:, k])) for k in range(6)]))
    least = min(((z[:, one] > c) != bad).sum() for c in np.unique(z[:, one]))
    assert ((z[:, one] > model["cuts"][one]) != bad).sum() <= least + 2
