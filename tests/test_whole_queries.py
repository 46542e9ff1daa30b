"""Registered queries on rows that the given tables lack: what they hand to their operators is whole."""

from quillspan.plans import catalog


def test_language_hint_reads_whole_texts(spark, tmp_path):
    rows = [(1, "a" * 300 + " \u0627\u0644\u0639", "web", "en"), (2, "a" * 300 + " \u0627\u0644", "web", "en"), (3, None, "web", "en"), (4, "x", "Arabic", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["language_hint"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.hint for r in got} == {1: "ar", 2: "en", 3: "en", 4: "ar"}


def test_character_error_rate_reads_whole_urls(spark, tmp_path):
    spark.createDataFrame([(1, "a" * 70 + "th" + "b" * 28), (2, "th" + "c" * 98)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = catalog.queries()["character_error_rate"](spark, str(tmp_path)).collect()
    assert {r.page_id: r.cer for r in got} == {1: 0.02, 2: 0.02}


def test_reading_order_of_pairs(spark, tmp_path):
    texts = {1: "a b c d e f g h", 2: "a b c d e f", 3: "a b a b c d a b e", 4: "one", 5: "one two three"}
    spark.createDataFrame(list(texts.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def brute(text):
        w = text.split()
        units, said = [w[i : i + 2] for i in range(0, len(w), 2)], w[len(w) // 2 :] + w[: len(w) // 2]
        found = []
        for k, u in enumerate(units):
            at = 0
            while at + len(u) <= len(said):
                hit = said[at : at + len(u)] == u
                found += [(at, k)] * hit
                at += len(u) if hit else 1
        a, b = list(range(len(units))), [k for _, k in sorted(found)]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1] / max(len(a), len(b)) if b else 0.0

    got = {r.item_id: r.accuracy for r in catalog.queries()["reading_order"](spark, str(tmp_path)).collect()}
    assert got == {i: brute(t) for i, t in texts.items()} and got[1] == 0.5
