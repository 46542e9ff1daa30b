"""URL filters by a temporal list join.

A list is dated entries: (domain, verdict, action, day), action `add` or
`remove`.  Entries become validity intervals [from, to) for each (domain,
verdict): from an addition to the next entry for the same pair.  Each capture,
a URL fetched at some time, is joined as of its fetch time with the entries of
its host and of all parent domains that are active then; the longest domain
decides, and `block` wins over `allow` for one domain.

Captures are first reduced to distinct (host, day) pairs, so a host with a third
of all captures is one row a day in the join; intervals are cut at months, which
with the domain is the join's key, so that a domain with many intervals isn't
gone through for every capture.  All of it is DataFrame operations; nothing is
broadcast by hint.

Edge cases: a null or unparsable URL has no host and is kept; a null fetch time
matches no entry; entries with a null field are ignored; of an addition and a
removal on one day the removal counts; repeated rows are judged each; very long URLs count whole; empty
lists keep everything.  Other columns are carried along; columns named host,
blocked, matched_domain or verdict are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import table

#: The list that the query applies.
ENTRIES = (
    ("spam-farm.example.org", "block", "add", "2024-01-15"),
    ("spam-farm.example.org", "block", "remove", "2024-05-01"),
    ("spam-farm.example.org", "block", "add", "2024-08-10"),
    ("cheap-pills.example.com", "block", "add", "2024-02-01"),
    ("www.cheap-pills.example.com", "allow", "add", "2024-06-01"),
    ("www.cheap-pills.example.com", "allow", "remove", "2024-07-01"),
    ("example.net", "block", "add", "2024-10-01"),
    ("blog.ththan.example.net", "allow", "add", "2024-09-01"),
    ("tionsh.example.net", "block", "add", "2024-03-01"),
    ("tionsh.example.net", "block", "remove", "2024-03-01"),
    ("tionsh.example.net", "block", "add", "2024-03-10"),
    ("tionsh.example.net", "block", "remove", "2024-04-20"),
    ("m.tiontion.example.com", "allow", "add", "2024-01-01"),
    ("tiontion.example.com", "block", "add", "2024-01-01"),
    ("tiontion.example.com", "block", "remove", "2024-11-30"),
    ("ththon.example.com", "block", "add", "2024-12-24"),
)
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, verdict, valid_from, valid_to): when each entry holds; valid_to is null while it still does."""
    e = entries.select(F.lower("domain").alias("domain"), "verdict", "action", F.col("day").cast("date").alias("day")).na.drop()
    # one action for each day: the removal, if there is one
    e = e.groupBy("domain", "verdict", "day").agg(F.max("action").alias("action"))
    w = Window.partitionBy("domain", "verdict").orderBy("day")
    e = e.withColumn("valid_to", F.lead("day").over(w)).filter("action = 'add'")
    return e.select("domain", "verdict", F.col("day").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """captures with host, matched_domain, verdict and blocked."""
    c = captures.drop("host", "matched_domain", "verdict", "blocked")
    host = F.lower(F.regexp_extract(F.col(url), HOST, 1))
    c = c.withColumn("host", F.when(F.length(host) > 0, host))
    asked = c.select("host", F.col(fetched).cast("date").alias("day")).na.drop().distinct()
    high = F.lit(c.agg(F.max(F.col(fetched).cast("date"))).first()[0]).cast("date")  # intervals need no months beyond the last capture
    held = intervals(entries).filter(F.col("valid_from") <= high)
    months = F.sequence(F.trunc("valid_from", "month"), F.trunc(F.least(F.coalesce("valid_to", high), high), "month"), F.expr("interval 1 month"))
    held = held.withColumn("month", F.explode(months)).select("domain", "verdict", "valid_from", "valid_to", "month")
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    tried = asked.withColumn("domain", F.explode(F.array_distinct(parents))).withColumn("month", F.trunc("day", "month"))
    hit = tried.join(held, ["domain", "month"]).filter((F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to"))))
    best = hit.groupBy("host", "day").agg(F.max(F.struct(F.length("domain").alias("n"), (F.col("verdict") == "block").alias("b"), "domain", "verdict")).alias("x"))
    best = best.select(F.col("host").alias("_h"), F.col("day").alias("_d"), F.col("x.domain").alias("matched_domain"), F.col("x.verdict").alias("verdict"))
    out = c.join(best, (c["host"] == best["_h"]) & (c[fetched].cast("date") == best["_d"]), "left").drop("_h", "_d")
    return out.withColumn("blocked", F.coalesce(F.col("verdict") == "block", F.lit(False)))


def entry_list(spark: SparkSession, rows=ENTRIES) -> DataFrame:
    """The list as a DataFrame; a parameter of fixed size, made of literals."""
    row = [F.struct(*(F.lit(v).alias(k) for k, v in zip(("domain", "verdict", "action", "day"), r))) for r in rows]
    return spark.range(1).select(F.explode(F.array(*row)).alias("e")).select("e.*")


def op4_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `pages`; as the table has no fetch time, page_id stands for one: a day of 2024 by its remainder of 366."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched"))
    out = filter_urls(pages, entry_list(spark))
    return out.select("page_id", "host", F.col("fetched").cast("string").alias("fetched"), "matched_domain", "verdict", "blocked")


def sql() -> str:
    rows = ", ".join("('{}', '{}', '{}', DATE '{}')".format(*e) for e in ENTRIES)
    return f"""
WITH e(domain, verdict, action, day) AS (VALUES {rows}),
o AS (SELECT domain, verdict, day, max(action) AS action FROM e GROUP BY ALL),
i AS (
  SELECT * FROM (SELECT domain, verdict, action, day AS valid_from, lead(day) OVER (PARTITION BY domain, verdict ORDER BY day) AS valid_to FROM o)
  WHERE action = 'add'
),
c AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '{HOST}', 1)), '') AS host,
         DATE '2024-01-01' + CAST(((page_id % 366) + 366) % 366 AS INTEGER) AS day
  FROM pages
),
m AS (
  SELECT c.page_id, c.host, c.day, i.domain, i.verdict,
         row_number() OVER (PARTITION BY c.page_id, c.host, c.day ORDER BY length(i.domain) DESC, i.verdict DESC) AS r
  FROM c JOIN i ON (c.host = i.domain OR ends_with(c.host, '.' || i.domain)) AND c.day >= i.valid_from AND (i.valid_to IS NULL OR c.day < i.valid_to)
)
SELECT c.page_id, c.host, strftime(c.day, '%Y-%m-%d') AS fetched, m.domain AS matched_domain, m.verdict, coalesce(m.verdict = 'block', false) AS blocked
FROM c LEFT JOIN m ON c.page_id = m.page_id AND m.r = 1
"""
