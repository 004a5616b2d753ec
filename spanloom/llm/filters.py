"""Audit of how filters interact: what each filter of an order removes, and what it would have removed elsewhere.

A partition packs its documents' failures into one bitmap for each filter, and one for each label. For every set of filters
that may have run before, and every filter that may come next, an AND-NOT and a count of bits tell what is left, removed,
removed already and lost; these counts of partitions are summed. An order of filters only reads the counts of its prefixes.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import hashing
from spanloom.llm.shared import SMALL, ship, stored

#: The filters, in the order of their bits.
FILTERS = "ABCDE"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
SIGNS = np.isin(np.arange(256), list(b"#$%&*|"))
FIRST = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point


def per_row(data: np.ndarray, bounds: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """How many bytes of each row are marked."""
    out = np.zeros(len(bounds) - 1, np.int64)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(marks[data[: bounds[-1]]], bounds[full], dtype=np.int64)
    return out


def word_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words and distinct words of each row."""
    total, distinct = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
    for row, h, bounds in hashing.words(column, hashing.WORDS, hashing.SAME):
        n = np.diff(bounds)
        owner = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        total[row : row + len(n)] = n
        distinct[row : row + len(n)] = np.bincount(owner[new], minlength=len(n))
    return total, distinct


def failures(column: pa.Array) -> np.ndarray:
    """The filters A to D that each text fails, as bits."""
    data, bounds = hashing.texts(column)
    words, distinct = word_counts(column)
    upper, points, signs = (per_row(data, bounds, m) for m in (UPPER, FIRST, SIGNS))
    fails = [words < 200, 100 * distinct < 50 * words, 100 * upper > 2 * points, signs > 0]
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bits of FILTERS), good and toxic of every document; texts are read once, then only their hashes."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    names = ["doc_id", "part", "mask", "print"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2)
            data, bounds = hashing.texts(text)
            ends = bounds.tolist()
            prints = [hashlib.sha256(data[a:b]).digest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(failures(text), pa.int32()), pa.array(prints, pa.binary())], names=names)

    narrow = stored(rows.mapInArrow(run, "doc_id long, part string, mask int, print binary"), "filter-marks")
    # only texts that occur again can fail E; equal rows are told from copies by their doc_id
    firsts = narrow.groupBy("print").agg(F.min("doc_id").alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    quality = labels.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(F.col("quality") == 1).alias("__good"), F.max(F.col("toxic") == 1).alias("__toxic"))
    copy = F.coalesce((F.col("doc_id").isNull() & F.col("__first").isNotNull()) | (F.col("doc_id") > F.col("__first")), F.lit(False))
    # what very many rows share is no key of a shuffle: at most SMALL texts can be in more than a SMALL-th of all rows
    firsts = stored(firsts, "filter-firsts")
    often = F.broadcast(firsts.filter(F.col("__n") > -(-narrow.count() // SMALL)).drop("__n"))
    rest = narrow.join(often, "print", "left_anti").join(firsts.drop("__n"), "print", "left")
    out = narrow.join(often, "print").unionByName(rest).join(quality, F.col("doc_id") == F.col("__id"), "left")
    mask = F.col("mask") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)
    return out.select("part", mask.alias("mask"), F.coalesce("__good", F.lit(False)).alias("good"), F.coalesce("__toxic", F.lit(False)).alias("toxic"))


def popcount(x: np.ndarray) -> int:
    return int(np.bitwise_count(x).sum())


def counted(bits: list[np.ndarray], good: np.ndarray, toxic: np.ndarray, all_: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """(prefix set, next filter, COUNTS) from packed bitmaps of one part."""
    n, out = len(bits), []
    gone = [np.zeros_like(all_)]
    for s in range(1, 1 << n):
        low = (s & -s).bit_length() - 1
        gone.append(gone[s & (s - 1)] | bits[low])
    for f in range(n):
        alone = popcount(bits[f] & ~gone[((1 << n) - 1) & ~(1 << f)])
        for s in range(1 << n):
            if not s >> f & 1:
                here = bits[f] & ~gone[s]
                out.append((s, f, [popcount(all_ & ~gone[s | 1 << f]), popcount(here), popcount(bits[f] & gone[s]), alone, popcount(here & good), popcount(here & toxic)]))
    return out


def prefix_counts(marks: DataFrame) -> DataFrame:
    """COUNTS for each part, set of filters before (bits) and next filter, summed over partitions."""
    ship(marks.sparkSession)
    names = ["part", "before", "next", *COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            which = parts.indices.to_numpy()
            order = np.argsort(which, kind="stable")
            mask, good, toxic = (batch.column(k).to_numpy(zero_copy_only=False)[order] for k in (1, 2, 3))
            cuts = np.searchsorted(which[order], np.arange(len(parts.dictionary) + 1)).tolist()
            rows: list[list] = []
            for name, a, b in zip(parts.dictionary.to_pylist(), cuts[:-1], cuts[1:], strict=True):
                bits = [np.packbits(mask[a:b] >> k & 1) for k in range(len(FILTERS))]
                found = counted(bits, np.packbits(good[a:b]), np.packbits(toxic[a:b]), np.packbits(np.ones(b - a, bool)))
                rows += [[name, s, f, *c] for s, f, c in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if k == 0 else pa.int64()) for k in range(len(names))], names=names)

    got = marks.mapInArrow(run, ", ".join(["part string", *(f"{c} long" for c in names[1:])]))
    return got.groupBy("part", "before", "next").agg(*[F.sum(c).alias(c) for c in COUNTS])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (source of docs), order of the filters and step: what the step's filter does there.

    Filters fail a text A: of under 200 words; B: of which fewer than half of the words are distinct; C: with over 2%
    letters A to Z; D: that holds one of #$%&*|; E: that equals the text of a document of smaller doc_id. Counts of documents:
    kept, removed, redundant (fails, but gone before), unique_fails (fails no other filter), good_lost and toxic_lost (removed here with
    that label), shapley (removed by the filter, summed over all orders).

    Null texts are empty and null sources the empty part; a null doc_id comes after all others, and rows of one
    doc_id are no copies of each other; a document with several rows of labels has a label if one of them has. Long texts are read
    whole; extra columns are not read; an empty table has no part and so no row.
    """
    spark = docs.sparkSession
    counts = stored(prefix_counts(marked(docs, labels)), "filter-counts")
    n = len(FILTERS)
    weight = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n)]), F.bit_count("before") + 1)
    shapley = counts.groupBy("part", "next").agg(F.sum(F.col("removed") * weight).alias("shapley"))
    steps = []
    for order in itertools.permutations(range(n)):
        for k, f in enumerate(order):
            steps.append(("".join(FILTERS[x] for x in order), k + 1, sum(1 << x for x in order[:k]), f))
    steps = spark.createDataFrame(steps, "filter_order string, step int, before long, next long")
    return counts.join(shapley, ["part", "next"]).join(F.broadcast(steps), ["before", "next"]).select("part", "filter_order", "step", *COUNTS, "shapley")


ORACLE = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
fails AS (SELECT doc_id, part,
    (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) OR (doc_id IS NULL AND min(doc_id) OVER (PARTITION BY t) IS NOT NULL) THEN 16 ELSE 0 END) AS m
  FROM words),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
counts AS (SELECT part, m, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n FROM fails LEFT JOIN marks USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest([0, 1, 2, 3, 4]) AS i),
orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT array_to_string(list_transform(o, lambda x: substr('ABCDE', x + 1, 1)), '') AS filter_order, s.k AS step, o[s.k] AS i, (1 << o[s.k]) AS bit,
    coalesce(list_sum(list_transform(o[1:s.k - 1], lambda x: 1 << x)), 0)::BIGINT AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS k) s),
found AS (SELECT part, filter_order, step, i,
    sum(CASE WHEN m & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN m & bit > 0 AND m & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN m & bit > 0 AND m & before > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN m = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN m & bit > 0 AND m & before = 0 AND good = 1 THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN m & bit > 0 AND m & before = 0 AND toxic = 1 THEN n ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, i))::BIGINT AS shapley
FROM found
"""
