"""Rendezvous hashing of record keys over weighted shards, in DataFrame expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups that each shard is split into for numbering its rows.
BUCKETS = 1024
#: Fixed odd multiplier that separates the shards' hash streams.
STEP = 7046029254386353087


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key: the one with the least -ln(u) / weight, u a hash of key and shard in (0, 1).

    A shard's score depends on the key and that shard alone, so adding a shard moves into it the keys that it
    wins and moves no other key. A shard of weight 0 gets nothing. Equal scores go to the lower shard number.
    Null is a key like any other.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be at least 0, and one above 0")
    scores = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            h = F.xxhash64(key, F.lit((shard + 1) * STEP % (1 << 63)))
            u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)
            scores.append(F.struct((-F.log(u) / float(weight)).alias("score"), F.lit(shard).alias("shard")))
    return F.array_min(F.array(*scores))["shard"]


def assign(rows: DataFrame, key: str, weights: Sequence[float], tie: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """rows with `shard` and `slot`, the row's number in its shard, gapless from 0.

    Both columns replace columns of the same names. Rows are numbered within (shard, bucket), a bucket being a
    hash of key and `tie` columns, and each bucket starts where the ones before it end: what is shuffled is
    `rows` once and one count for each bucket. Equal rows get different slots of the same shard. Rows whose key
    is null go to one shard, spread over buckets by their tie columns. An empty table gives an empty table.
    """
    by = [F.col(key), *map(F.col, tie)]
    placed = rows.drop("shard", "slot").withColumn("shard", rendezvous(F.col(key), weights))
    placed = placed.withColumn("__bucket", F.pmod(F.xxhash64(*by, F.lit(1)), F.lit(buckets)).cast("int"))
    counts = placed.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("shard", "__bucket").orderBy(*by)
    numbered = placed.withColumn("__i", F.row_number().over(within) - 1)
    return (
        numbered.join(starts, ["shard", "__bucket"])
        .withColumn("slot", (F.col("__start") + F.col("__i")).cast("long"))
        .drop("__bucket", "__start", "__i")
    )


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Documents over `shards` equal shards by doc_id, and the shard that each would have with one more.

    Returns doc_id, size (UTF-8 bytes of the text plus 16; 16 for a null text), text_crc32 (0 for a null text),
    law, shard, slot and grown_shard. The law is `key`. Other columns of docs are not read. Long texts count in full and
    are hashed whole; equal texts, and rows equal in all, get different slots; a null doc_id is a key like any other; an
    empty table gives an empty one.
    """
    text = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col("doc_id"), [1.0] * (shards + 1)).cast("int").alias("grown_shard"),
    )
    out = assign(rows, "doc_id", [1.0] * shards, ["text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", F.col("shard").cast("int").alias("shard"), "slot", "grown_shard")
