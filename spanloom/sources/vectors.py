"""Word vectors: text files read for a vocabulary alone, and vectors of unknown words from the pieces of their letters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The hash of pieces of letters, as published with the vectors (FNV-1a of 32 bits over signed bytes).
OFFSET, PRIME = 2166136261, 16777619


def read(spark: SparkSession, path: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """word and vector of text files of lines `word number number ...`; a first line of two numbers is a header.

    With a vocabulary (word) only its words are kept, before any number is parsed. Of a word that repeats one line stays.
    """
    lines = spark.read.text(path).select(F.split(F.rtrim("value"), " ").alias("x")).filter(F.size("x") > 2)
    rows = lines.select(F.element_at("x", 1).alias("word"), F.slice("x", F.lit(2), F.size("x") - 1).alias("x"))
    if vocabulary is not None:
        rows = rows.join(vocabulary.select(F.col("word").alias("__word")).distinct(), F.col("word") == F.col("__word"), "left_semi")
    return rows.select("word", F.col("x").cast("array<float>").alias("vector")).dropDuplicates(["word"])


def pieces(word: str, shortest: int = 3, longest: int = 6) -> list[str]:
    """The runs of letters of a word between < and >, of each size; single marks are none."""
    marked = f"<{word}>"
    out = [marked[a : a + n] for a in range(len(marked)) for n in range(shortest, longest + 1) if a + n <= len(marked)]
    return [p for p in out if len(p) > 1 or p not in "<>"]


def bucket(piece: str, buckets: int) -> int:
    h = OFFSET
    for b in piece.encode():
        h = ((h ^ (b if b < 128 else b | 0xFFFFFF00)) * PRIME) & 0xFFFFFFFF
    return h % buckets


def unknown(words: DataFrame, table: DataFrame, dims: int, buckets: int = 2_000_000, shortest: int = 3, longest: int = 6) -> DataFrame:
    """word and vector of words (word) as the mean of the vectors of their pieces' buckets; table has bucket and vector.

    A piece counts as often as it occurs; one whose bucket has no vector does not count, and a word without any has no row.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            found = [[bucket(p, buckets) for p in pieces(w, shortest, longest)] for w in own]
            rows = np.repeat(np.arange(len(own)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([b for x in found for b in x], pa.int64())], names=["word", "bucket"])

    spots = words.select("word").filter("word IS NOT NULL").distinct().mapInArrow(cut, "word string, bucket long")
    met = spots.join(table.select(F.col("bucket").alias("__b"), "vector"), F.col("bucket") == F.col("__b"))
    mean = F.array(*[F.avg(F.col("vector")[k]).cast("float") for k in range(dims)])
    return met.groupBy("word").agg(mean.alias("vector"))


def matrix(vocabulary: DataFrame, known: DataFrame, table: DataFrame, dims: int, **how) -> DataFrame:
    """word_id and vector of each word of a vocabulary (word, word_id): its own, else that of its pieces, else zeros."""
    own = vocabulary.join(known.select(F.col("word").alias("__word"), F.col("vector").alias("__own")), F.col("word") == F.col("__word"), "left")
    made = unknown(own.filter("__own IS NULL"), table, dims, **how).select(F.col("word").alias("__made"), F.col("vector").alias("__vector"))
    both = own.join(made, F.col("word") == F.col("__made"), "left")
    return both.select("word_id", F.coalesce("__own", "__vector", F.array_repeat(F.lit(0.0).cast("float"), dims)).alias("vector"))
