"""What each filter removes under every order of the filters.

`failures` judges each document by five filters; `replay` takes any table of boolean failure columns.  Every document's row meets
every order of the filters (a broadcast table of n! rows, 120 for five, so its size is known), the first failing step follows from
the flags, the steps are exploded, and one aggregation by (part, order, step) counts them: partial sums leave a task as at most
parts x orders x steps rows, however hot a part is, so nothing is shuffled by document but keys of texts and labels.

Edge cases: a null text is the empty text (it fails A only, and E where a smaller doc_id has no text either); a null lang is the part
''; a row without doc_id is a copy of nothing and makes no row a copy, and has no label; rows that repeat a doc_id are
documents of their own and not copies of each other; several labels of a document: the largest counts; without documents there are
no parts, so no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import stored, table

WORDS = r"[^\x20\x09-\x0D]+"
#: Orders grow as a factorial: beyond this many filters a replay of all of them is refused.
MOST_FILTERS = 7
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 100, 80, 10, r"[#$%&*|]"
#: At most so many groups of copies are broadcast; every other group has less than this share of the rows.
HOT_GROUPS = 10_000


def text_failures(text: Column) -> dict[str, Column]:
    """Filters A to D: what a text fails by itself."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > CAPITAL_PERCENT * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def with_copies(docs: DataFrame, key: str, name: str) -> DataFrame:
    """docs (a stored table) with a boolean: a row of a smaller doc_id has the same key.

    Groups are found with partial aggregation; groups of one row are left out.  The largest (fewer than HOT_GROUPS by their share
    of the rows) come by broadcast, so that the shuffled join has no hot key.
    """
    total = docs.count()
    groups = docs.filter("doc_id is not null").groupBy(key).agg(F.count("*").alias("_n"), F.min("doc_id").alias("_least")).filter("_n > 1")
    hot = F.col("_n") * HOT_GROUPS > F.lit(total)
    large = F.broadcast(groups.filter(hot).select(key, F.col("_least").alias("_large")))
    small = groups.filter(~hot).select(F.col(key).alias("_k"), "_least")
    found = docs.join(large, key, "left")
    # rows of large groups are settled: they need no partner, and a key that is null in most rows would itself be hot
    rest = found.filter("_large is null").join(small, F.col(key) == F.col("_k"), "left").withColumn(name, F.coalesce(F.col("doc_id") > F.col("_least"), F.lit(False)))
    done = found.filter("_large is not null").withColumn(name, F.coalesce(F.col("doc_id") > F.col("_large"), F.lit(False)))
    cols = [*docs.columns, name]
    return rest.select(cols).unionByName(done.select(cols))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, good, toxic) for each row of documents: what it fails, and what its labels say."""
    text = F.coalesce("text", F.lit(""))
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("_key"), *(c.alias(k) for k, c in text_failures(text).items()))
    judged = with_copies(stored(seen, "audit"), "_key", "E").drop("_key")
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.expr("quality = 1")).alias("_q"), F.max(F.expr("toxic = 1")).alias("_t"))
    known = judged.join(marks, "doc_id", "left")
    return known.select("part", *"ABCDE", F.coalesce("_q", F.lit(False)).alias("good"), F.coalesce("_t", F.lit(False)).alias("toxic"))


def orders(spark: SparkSession, filters: list[str]) -> DataFrame:
    """(filter_order, bits): every order of the filters, with a bit for the filter at each step."""
    rows = [("".join(p), [1 << filters.index(x) for x in p]) for p in permutations(filters)]
    return spark.createDataFrame(rows, "filter_order string, bits array<int>")


def replay(flags: DataFrame, filters: list[str], lost: dict[str, str]) -> DataFrame:
    """One row for each part, order of the filters and step.

    flags: (part, a boolean for each filter: fails it, a boolean for each value of lost).  filters: names of one letter.  lost: name
    of a count -> the boolean column whose removed rows it counts.  Counts: kept (after this step), removed (here), redundant
    (fails this filter, removed earlier), unique_fails (fails this filter only), those of lost, and shapley (removed by this
    filter, over all orders).
    """
    if not 1 <= len(filters) <= MOST_FILTERS or len(set(filters)) < len(filters):
        raise ValueError(f"1 to {MOST_FILTERS} different filters are needed")
    n = len(filters)
    mask = sum((F.col(f).cast("int") * (1 << k) for k, f in enumerate(filters)), F.lit(0))
    docs = flags.select("part", mask.alias("fails"), *dict.fromkeys(lost.values()))
    crossed = docs.crossJoin(F.broadcast(orders(flags.sparkSession, filters)))
    first = F.coalesce(*(F.when(F.col("fails").bitwiseAND(F.get("bits", F.lit(k))) != 0, k + 1) for k in range(n)), F.lit(n + 1))
    steps = crossed.withColumn("first", first).select("*", F.explode(F.array(*(F.lit(k + 1) for k in range(n)))).alias("step"))
    bit = F.get("bits", F.col("step") - 1)
    one = lambda c: F.sum(c.cast("long"))
    removed = F.col("first") == F.col("step")
    out = steps.groupBy("part", "filter_order", "step").agg(
        one(F.col("first") > F.col("step")).alias("kept"), one(removed).alias("removed"), one((F.col("first") < F.col("step")) & (F.col("fails").bitwiseAND(bit) != 0)).alias("redundant"),
        one(F.col("fails") == bit).alias("unique_fails"), *(one(removed & F.col(c)).alias(k) for k, c in lost.items()))
    # one row for each part, order and step from here on
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", letter)))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return replay(flags, list("ABCDE"), {"good_lost": "good", "toxic_lost": "toxic"})


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
marks AS (SELECT doc_id, coalesce(bool_or(quality = 1), FALSE) AS good, coalesce(bool_or(toxic = 1), FALSE) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
flags AS (
    SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
        {'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
         'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(w.doc_id > least, FALSE)} AS f
    FROM w LEFT JOIN marks USING (doc_id)),
one AS (SELECT part, good, toxic, CASE WHEN f.A THEN 'A' ELSE '' END || CASE WHEN f.B THEN 'B' ELSE '' END || CASE WHEN f.C THEN 'C' ELSE '' END || CASE WHEN f.D THEN 'D' ELSE '' END || CASE WHEN f.E THEN 'E' ELSE '' END AS fails FROM flags),
grouped AS (SELECT part, good, toxic, fails, count(*) AS n FROM one GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
replayed AS (
    SELECT part, good, toxic, fails, n, filter_order, step, substr(filter_order, step, 1) AS letter,
        contains(fails, substr(filter_order, step, 1)) AS failing, length(regexp_replace(substr(filter_order, 1, step - 1), '[^' || fails || 'x]', '', 'g')) > 0 AS gone
    FROM grouped, orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
counted AS (
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, letter, sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN gone AND failing THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN NOT gone AND failing AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND failing AND toxic THEN n ELSE 0 END) AS toxic_lost
    FROM replayed GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM counted
"""
