"""From raw documents to a sharded training mix, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns a DataFrame; `run` writes each result as a table in the shared
folder and reads it again for the next.  All but the last return the columns of
documents.

-   toxicity: documents that the classifier rejects go.
-   near_duplicates: of each component of the n-gram Jaccard join, the document
    with the smallest doc_id stays.
-   decontamination: documents that hold a window of a benchmark item go whole;
    cutting the spans out would leave the text around them without its middle.
-   mixing: rows as often as the mix takes them, up to twice.
-   sharding: adds slot and shard.

Edge cases: null and empty texts aren't toxic, are near to nothing, hold no window and have size 0, so they stay, as often as
documents of size 0 are taken; very long texts are worked on whole; rows that repeat in doc_id and text are one document in
near_duplicates, but for rows without words, which all stay; without labels, or too few, nothing is toxic; an empty benchmark
removes nothing; empty documents give no rows.  Columns of documents beyond the usual ones are carried along; slot and shard of
the input are replaced, names that begin with an underscore are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspan.llm import decontaminate, jaccard, mixing, sharding, toxicity
from quillspan.llm.common import discard, stored, table

#: No SQL for the whole: the first stage is a trained classifier.  The tests hold each stage against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), cut=False)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.place(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", place_in_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
