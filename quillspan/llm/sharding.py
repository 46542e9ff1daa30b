"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a table of prime size, made
from an offset and a step.  Shards take turns; at its turn a shard claims the
first slot of its permutation that is still free, until no slot is.  Shares
differ by at most one slot, and adding or removing a shard moves few slots.  A
document's slot is a hash of its key modulo the table's size; the table is
broadcast (its size is the parameter `slots`, not the data's).

Edge cases: a null key hashes like the empty text; repeated keys share a shard;
an empty table gives an empty result; a column of the input named slot or shard
is replaced by the placement.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table

SLOTS, SHARDS = 65537, 64
MOST_SLOTS = 1_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of the shard that claimed it."""
    if not names or len(set(names)) != len(names):
        raise ValueError("shards need distinct names")
    if not _is_prime(slots) or slots <= len(names) or slots > MOST_SLOTS:
        raise ValueError(f"slots must be a prime above the number of shards and up to {MOST_SLOTS}")
    h = [hashlib.md5(n.encode()).digest() for n in names]
    at = [int.from_bytes(x[:8], "big") % slots for x in h]
    step = [int.from_bytes(x[8:], "big") % (slots - 1) + 1 for x in h]
    out = [-1] * slots
    left = slots
    while True:
        for i in range(len(names)):
            while out[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            out[at[i]] = i
            left -= 1
            if not left:
                return out


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots))


def table_frame(spark: SparkSession, names: list[str], slots: int = SLOTS) -> DataFrame:
    text = ",".join(map(str, lookup_table(names, slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("slot", "owner")).select(F.col("slot").cast("long").alias("slot"), F.col("owner").cast("int").alias("shard"))


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def place(docs: DataFrame, key: str = "doc_id", names: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """docs with the columns slot and shard; a broadcast of the fixed-size table, no shuffle of docs."""
    owners = table_frame(docs.sparkSession, names or shard_names(), slots)
    d = docs.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    return d.join(F.broadcast(owners), "slot", "left").select(*[c for c in d.columns if c != "slot"], "slot", "shard")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id"))


def sql() -> str:
    text = ",".join(map(str, lookup_table(shard_names())))
    return f"""
WITH owners AS (
  SELECT unnest(range(0, {SLOTS})) AS slot, unnest(string_split('{text}', ',')) AS owner
), d AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents
)
SELECT d.doc_id, d.slot, CAST(o.owner AS INTEGER) AS shard FROM d LEFT JOIN owners o ON d.slot = o.slot
"""
