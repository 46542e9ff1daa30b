"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash; a document's virtual finish
time is the source's cumulative tokens up to and with it, divided by the
source's weight.  A source may be gone through twice, which bounds each
document's and source's share.  All finish times stand in one global order
and the order is cut where the total budget is used up; a source that ran out
leaves its share to the others by weight.

Running sums go by buckets: each source has as many as its rows ask for, sums of
buckets and of groups of buckets give offsets, and windows stay within one bucket.  The
place where the budget ends is found by histograms of finish times, each within the bin before, until
a bin holds few documents; only these are put in exact order.  No task holds a whole source, and no step sorts all times.

Edge cases: null text has size 0; a null source comes last in the order of
sources; documents of size 0 take part with size 0; very long texts count whole; documents with the same doc_id (null, too) but
other texts are shuffled apart, identical rows tie, share a bucket and are
interchangeable; an empty table gives an empty result; other columns are
carried along untouched by `mix`, but for names that begin with `_mix`.  The table of sources, a row each, goes
through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import discard, stored, table

WEIGHTS = (3, 1, 2)
SHARE, REPEATS = 1.5, 2
#: Rows of a bucket (identical rows aside), bins of a histogram, and rows that are put in exact order at most, ties aside.
BUCKET_ROWS, BINS, EXACT_ROWS, DESCENTS = 2000, 1024, 20_000, 12
SPAN = 1 << 60


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _shuffled(doc_id: Column, text: Column) -> Column:
    """A number below SPAN by doc_id and text."""
    of = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(of.cast("binary")), 1, 15), 16, 10).cast("long")


def _keyed(docs: DataFrame) -> DataFrame:
    """Size and shuffle key for each row."""
    return docs.withColumns({"_mix_size": size_of(F.col("text")), "_mix_key": _shuffled(F.col("doc_id"), F.col("text"))})


def targets(sums: DataFrame) -> DataFrame:
    """source, size, weight, target: budget shared by weight, no source beyond REPEATS times its size.

    `sums` has a row (source, size) for each source; windows without a partition see only these.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(every) - 1) % len(WEIGHTS) + 1).cast("int"))
    s = sums.withColumn("rank", F.row_number().over(every)).withColumn("weight", w).withColumn("cap", F.col("size") * REPEATS)
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({
        "full": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "used": F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "budget": F.sum("size").over(whole) * F.lit(SHARE),
        "weights": F.sum("weight").over(whole),
    })
    # the level that the sources from this one on would reach, if all before are full
    s = s.withColumn("level", (F.col("budget") - F.col("full")) / (F.col("weights") - F.col("used")))
    s = s.withColumn("reached", F.min(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level"))).over(whole))
    return s.select("source", "size", "weight", F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce("reached", F.lit(0.0))).alias("target"), "budget")


def _of_source(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """rows with their source's figures and their bucket among as many as the source has."""
    g = goal.select(F.col("source").alias("_mix_source"), F.col("size").alias("_mix_source_size"), F.col("weight").alias("_mix_weight"), F.col("target").alias("_mix_target"), F.col("parts").alias("_mix_parts"))
    j = rows.join(g, rows["source"].eqNullSafe(g["_mix_source"])).drop("_mix_source")
    return j.withColumn("_mix_bucket", F.least(F.floor(F.col("_mix_key") / F.lit(float(SPAN)) * F.col("_mix_parts")), F.col("_mix_parts") - 1)).drop("_mix_parts")


def _offsets(sums: DataFrame) -> DataFrame:
    """sums(source, bucket, size) with `before`, the source's tokens in earlier buckets: by groups of buckets first, then within each."""
    earlier = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    s = sums.withColumn("far", F.floor(F.col("bucket") / BINS))
    far = s.groupBy("source", "far").agg(F.sum("size").alias("size")).withColumn("_far", F.coalesce(F.sum("size").over(earlier("source", "far")), F.lit(0))).select(F.col("source").alias("_s"), F.col("far").alias("_f"), "_far")
    s = s.withColumn("_near", F.coalesce(F.sum("size").over(earlier("source", "far", "bucket")), F.lit(0)))
    s = s.join(far, s["source"].eqNullSafe(far["_s"]) & (s["far"] == far["_f"]))
    return s.select("source", "bucket", (F.col("_far") + F.col("_near")).alias("before"))


def _timed(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """rows of `_of_source` with _mix_cum, the source's tokens up to and with the row."""
    inside = Window.partitionBy("source", "_mix_bucket").orderBy("_mix_key", "doc_id", "_mix_size").rowsBetween(Window.unboundedPreceding, 0)
    o = offsets.select(F.col("source").alias("_mix_source"), F.col("bucket").alias("_mix_b"), F.col("before").alias("_mix_before"))
    k = rows.withColumn("_mix_inside", F.sum("_mix_size").over(inside))
    j = k.join(o, k["source"].eqNullSafe(o["_mix_source"]) & (k["_mix_bucket"] == o["_mix_b"])).drop("_mix_source", "_mix_b")
    return j.withColumn("_mix_cum", F.col("_mix_before") + F.col("_mix_inside")).drop("_mix_before", "_mix_inside", "_mix_bucket")


def _finish(pass_no: Column) -> Column:
    return (F.col("_mix_cum") + pass_no * F.col("_mix_source_size")) / F.col("_mix_weight")


def _place(finish, null, source, pass_no, key, doc_id, size) -> Column:
    return F.struct(finish.alias("a"), null.alias("b"), source.alias("c"), pass_no.alias("d"), key.alias("e"), doc_id.alias("f"), size.alias("g"))


def _cut(times: DataFrame, latest: float, budget: float) -> Column | None:
    """The place of the first document that the budget doesn't hold any more; None if it holds all.

    Documents of size 0 take nothing of the budget and are left out of the search.
    """
    passes = F.explode(F.array(*map(F.lit, range(REPEATS))))
    t = times.filter("_mix_size > 0").withColumn("pass_no", passes).withColumn("finish", _finish(F.col("pass_no")))
    before, low, width = 0, 0.0, latest
    for _ in range(DESCENTS):
        width /= BINS
        at = F.greatest(F.lit(0), F.least(F.floor((F.col("finish") - F.lit(low)) / F.lit(width)), F.lit(BINS - 1)))
        # at most BINS rows reach the driver
        found = None
        for r in sorted(t.groupBy(at.alias("bin")).agg(F.sum("_mix_size").alias("size"), F.count("*").alias("n")).collect(), key=lambda r: r.bin):
            if before + r.size > budget:
                found = r
                break
            before += r.size
        if found is None:
            return None
        t = t.filter(at == found.bin)
        low += width * found.bin
        if found.n <= EXACT_ROWS or width <= latest * 1e-15:
            break
    order = ("finish", F.col("source").asc_nulls_last(), "pass_no", "_mix_key", "doc_id", "_mix_size")
    total = F.sum("_mix_size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) + F.lit(before)
    r = t.withColumn("total", total).filter(F.col("total") > budget).orderBy(*order).limit(1).collect()[0]
    long = lambda v: F.lit(v).cast("long")
    return _place(F.lit(r.finish), F.lit(r.source is None), F.lit(r.source or ""), F.lit(r.pass_no), long(r._mix_key), long(r.doc_id), long(r._mix_size))


def mix(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows of docs with _mix_size, _mix_source_size, _mix_target and _mix_times, how often the mix takes them (0 to 2)."""
    columns = list(columns or docs.columns)
    keyed = stored(_keyed(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "source", "_mix_size", "_mix_key"), "mix-keys")
    sums = stored(keyed.groupBy("source").agg(F.sum("_mix_size").alias("size"), F.count("*").alias("n")), "mix-sums")
    rank = sums.select("source", F.ceil(F.col("n") / BUCKET_ROWS).alias("parts"))
    t = targets(sums.select("source", "size"))
    goal = stored(t.join(rank.withColumnRenamed("source", "_s"), t["source"].eqNullSafe(F.col("_s"))).drop("_s"), "mix-targets")
    dealt = _of_source(keyed, goal)
    offsets = stored(_offsets(dealt.groupBy("source", F.col("_mix_bucket").alias("bucket")).agg(F.sum("_mix_size").alias("size"))), "mix-offsets")
    last = goal.agg(F.max(F.col("size") * REPEATS / F.col("weight")).alias("t"), F.first("budget").alias("b")).first()
    times = stored(_timed(dealt, offsets), "mix-times")
    cut = _cut(times, float(last.t or 0.0), float(last.b or 0.0)) if last.t else None
    mine = lambda p: _place(_finish(F.lit(p)), F.col("source").isNull(), F.coalesce("source", F.lit("")), F.lit(p), F.col("_mix_key"), F.col("doc_id").cast("long"), F.col("_mix_size"))
    taken = [F.lit(1)] * REPEATS if cut is None else [(mine(p) < cut).cast("int") for p in range(REPEATS)]
    discard(sums)
    if set(columns) <= {"doc_id", "source"}:
        full = times
    else:
        full = _timed(_of_source(_keyed(docs), goal), offsets)
        discard(times)
    discard(keyed)
    out = full.withColumn("_mix_times", sum(taken[1:], taken[0]))
    return out.select(*columns, "_mix_size", "_mix_source_size", "_mix_target", "_mix_times")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken."""
    m = mix(docs)
    return m.filter("_mix_times > 0").withColumn("_mix_n", F.explode(F.sequence(F.lit(1), F.col("_mix_times")))).select(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), ["doc_id", "source"])
    return m.select("doc_id", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), (F.col("_mix_size") * F.col("_mix_times")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS size FROM d GROUP BY source
), w AS (
  SELECT source, size, row_number() OVER (ORDER BY source NULLS LAST) AS rank,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM s
), f AS (
  SELECT *, 2 * size AS cap,
         coalesce(sum(2 * size) OVER (ORDER BY CAST(2 * size AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS filled,
         coalesce(sum(weight) OVER (ORDER BY CAST(2 * size AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used,
         CAST(sum(size) OVER () AS BIGINT) * CAST(1.5 AS DOUBLE) AS budget, CAST(sum(weight) OVER () AS BIGINT) AS weights
  FROM w
), l AS (
  SELECT *, (budget - filled) / CAST(weights - used AS DOUBLE) AS level FROM f
), t AS (
  SELECT source, size AS source_size, weight, budget,
         least(CAST(cap AS DOUBLE), weight * coalesce(min(CASE WHEN CAST(cap AS DOUBLE) / weight >= level THEN level END) OVER (), 0)) AS target
  FROM l
), c AS (
  SELECT d.doc_id, d.source, d.size, d.k, t.source_size, t.weight, t.target, t.budget,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT c.*, p.pass_no, CAST(cum + pass_no * source_size AS DOUBLE) / weight AS finish FROM c, (SELECT unnest([0, 1]) AS pass_no) p
), g AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, pass_no, k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM e
)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN total <= budget THEN size ELSE 0 END) AS BIGINT) AS taken
FROM g GROUP BY doc_id, source, k, size, source_size, target
"""
