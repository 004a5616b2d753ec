"""The corpus pipeline: quality, near-duplicates, benchmark leaks, source mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import decontam, jaccard, mixing, quality, sharding
from spanloom.llm.shared import discard, stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labels of the documents, gives 0.7 or more.

    Null and empty texts have the score of the bias alone; long texts are scored whole; equal rows go or stay together;
    without documents or labels all weights are 0 and nothing reaches 0.7.
    """
    weights = quality.fit(docs, table(spark, sf_dir, "labels").filter(~quality.held_out("doc_id", 4, 2)))
    return quality.keep_good(docs, weights)


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id; of equal rows one row.

    Documents without words stay, all of them. Different texts of one doc_id are documents of their own, a null doc_id comes
    after all others. Long texts are compared whole; an empty table stays empty.
    """
    return jaccard.first_of_groups(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without half of a benchmark item.

    Null and empty texts have none and stay, equal rows go or stay together, long texts are read whole. Items without id
    count, empty ones do not; without documents or benchmark nothing goes.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them.

    Whole documents, each up to three times; null is a source; texts without words take nothing of a budget; equal rows
    are taken one after the other. An empty table stays empty.
    """
    return mixing.mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row: equal rows, as copies of the mix, share a shard and differ in their slots.

    Null doc_ids and texts, long texts and empty tables as sharding.shard_documents() says.
    """
    return sharding.shard_documents(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_first),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: No SQL: training a classifier and tiling strings are not expressible. Tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, last = stored(stage(spark, docs, sf_dir), f"pipeline-{name}"), before
        if last is not None:  # no later stage reads it
            discard(last)
        before = docs
    return docs
