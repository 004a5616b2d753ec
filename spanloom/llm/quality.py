"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from spanloom.llm import hashing
from spanloom.llm.hashing import U, mix
from spanloom.llm.shared import least, ship, stored

#: Most labelled documents of each label that a model is fitted on, those with the least hash, and most of their features.
SAMPLE, FEATURES = 4000, 8_000_000
#: In so many portions the sample goes to the driver.
PORTIONS = 16


@dataclass(frozen=True)
class Settings:
    """bits: log2 of the weights. grams: longest n-gram. The rest: FTRL-proximal's step, smoothing and penalties."""

    bits: int = 18
    grams: int = 2
    alpha: float = 0.6
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    epochs: int = 3


def features(column: pa.Array, how: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row's hashed n-grams and their values: square-rooted counts, scaled to length 1; a bias comes first.

    Tokens are runs of letters and digits, folded to lower case, or of other signs; the shapes of
    words (which letters are upper-case) give n-grams of their own, and a pair of words one for being equal or not.
    """
    size = U((1 << how.bits) - 1)
    folded = hashing.words(column, hashing.TOKENS, hashing.LOWER)
    exact = hashing.words(column, hashing.TOKENS, hashing.SHAPES)
    for (_, h, bounds), (_, shape, _) in zip(folded, exact, strict=True):
        grams = [h, mix(shape ^ U(0xA24BAED4963EE407))]
        for n in range(2, how.grams + 1):
            grams += [hashing.shingles(g, n) for g in (h, shape)]
        grams.append(mix((h[1:] == h[:-1]).astype(U) + U(0x9E6C63D0876A9A47)))
        steps = [1, 1, *[n for n in range(2, how.grams + 1) for _ in (0, 1)], 2]
        ids = [((g >> U(20)) & size).astype(np.int32) for g in grams]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = np.concatenate([i[a : max(b - n + 1, a)] for i, n in zip(ids, steps, strict=True)])
            found, count = np.unique(own, return_counts=True)
            value = np.sqrt(count)
            norm = np.sqrt((value * value).sum())
            yield np.append(found, 1 << how.bits), np.append(value / norm if norm else value, 1.0)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, float]], how: Settings) -> np.ndarray:
    """Weights after `epochs` passes over rows (ids, values, label), the bias last."""
    z, n = np.zeros((1 << how.bits) + 1), np.zeros((1 << how.bits) + 1)

    def weight(i: np.ndarray) -> np.ndarray:
        w = -(z[i] - np.sign(z[i]) * how.l1) / ((how.beta + np.sqrt(n[i])) / how.alpha + how.l2)
        return np.where(np.abs(z[i]) > how.l1, w, 0.0)

    ones = sum(label for *_, label in rows)
    odds = (max(ones, 1) / max(len(rows) - ones, 1)) ** 0.25  # the rarer label counts more, by the fourth root of its rarity
    for _ in range(how.epochs):
        for ids, values, label in rows:
            w = weight(ids)
            g = (sigmoid(w @ values) - label) * values * (1.0 if label else odds)
            z[ids] += g - (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / how.alpha * w
            n[ids] += g * g
    return weight(np.arange(len(z)))


def _views(column: pa.Array, kind: type) -> list[np.ndarray]:
    """Each row's bytes as numbers, without a copy."""
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).tolist()
    data = column.buffers()[2] or b""
    return [np.frombuffer(data, kind, (b - a) // np.dtype(kind).itemsize, a) for a, b in zip(ends, ends[1:])]


def _learned(batches: list[pa.RecordBatch], how: Settings) -> np.ndarray:
    """The weights of the rows (h, label, id, print, k, ids, vals), k times each, in the order of the first four."""
    if not batches:
        return np.zeros((1 << how.bits) + 1)
    got = pa.Table.from_batches(batches)
    order = pc.sort_indices(got.select(["h", "label", "id", "print"]), [(c, "ascending") for c in ("h", "label", "id", "print")]).to_pylist()
    ids, values = ([x for chunk in got[c].chunks for x in _views(chunk, kind)] for c, kind in (("ids", np.int32), ("vals", np.float32)))
    labels, times = got["label"].to_pylist(), got["k"].to_pylist()
    if len(set(labels)) < 2:
        weights = np.zeros((1 << how.bits) + 1)
        weights[-1] = 4.0 * (2 * labels[0] - 1)
        return weights
    return ftrl([(ids[at], values[at], labels[at]) for at in order for _ in range(times[at])], how)


def fit(docs: DataFrame, labels: DataFrame, how: Settings = Settings(), sample: int = SAMPLE, most: int = FEATURES) -> np.ndarray:
    """Weights learned from at most `sample` documents of each label (`text` of docs, `quality` of labels by doc_id).

    The rows of a label are those whose doc_id has the least hash, as many as have `most` features (distinct
    n-grams) together; a doc_id with many rows gives no more of them either. So what is sent to the driver, in PORTIONS, has a
    bound of 8 bytes a feature, 128 MB by default, whatever the size of documents and labels. The rows with null text, doc_id
    or label are left out; empty texts count; equal rows of docs count each, equal rows of labels are one. Without rows, or with
    one label only, all weights but the bias are 0.
    """
    spark = docs.sparkSession
    ship(spark)
    marks = labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("__label")).filter("__id IS NOT NULL AND __label IN (0, 1)")
    marks = least(marks, "__label", ["__id"], sample)
    text = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    chosen = text.join(F.broadcast(marks), text["doc_id"] == marks["__id"]).groupBy("__id", "__h", "__label", "text").agg(F.count(F.lit(1)).alias("__c"))
    schema = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("label", pa.float64()), ("c", pa.int64()), ("n", pa.int64()), ("print", pa.int64()), ("ids", pa.binary()), ("vals", pa.binary())])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [(i.astype(np.int32), v.astype(np.float32)) for i, v in features(batch.column(3), how)]
            cols = [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int64()), batch.column(2).cast(pa.float64()), batch.column(4)]
            marks = [pa.array([len(i) for i, _ in f], pa.int64()), pa.array([zlib.crc32(v.tobytes(), zlib.crc32(i.tobytes())) for i, v in f], pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, *marks, *(pa.array([x[k].tobytes() for x in f], pa.binary()) for k in (0, 1))], schema=schema)

    rows = stored(chosen.mapInArrow(listed, "id long, h long, label double, c long, n long, print long, ids binary, vals binary"), "quality-features")
    # bounded in rows and features on narrow columns, before any list goes to the driver; equal rows are told apart by number
    near = rows.select("label", "h", "id", "print", "c", "n").groupBy("label", "h", "id", "print").agg(F.sum("c").alias("c"), F.max("n").alias("n"))
    order = Window.partitionBy("label").orderBy("h", "id", "print").rowsBetween(Window.unboundedPreceding, -1)
    room = F.least(F.lit(sample) - F.coalesce(F.sum("c").over(order), F.lit(0)), F.floor((F.lit(most) - F.coalesce(F.sum(F.col("c") * F.col("n")).over(order), F.lit(0))) / F.col("n")))
    near = near.withColumn("k", F.least("c", room)).filter("k > 0").select("label", "h", "id", "print", "k")
    kept = rows.join(F.broadcast(near), ["label", "h", "id", "print"])
    kept = kept.groupBy("label", "h", "id", "print", "k").agg(F.any_value("ids").alias("ids"), F.any_value("vals").alias("vals"))
    # the lists come in portions of a few MB, so that the driver's JVM holds one of them at a time, and stay where Arrow put them
    kept = stored(kept.withColumn("portion", F.pmod(F.xxhash64("label", "id", "print"), F.lit(PORTIONS)).cast("int")), "quality-sample")
    batches = [b for p in range(PORTIONS) for b in kept.filter(F.col("portion") == p).select("h", "label", "id", "print", "k", "ids", "vals").toArrow().to_batches()]
    return _learned([b for b in batches if b.num_rows], how)


def _scores(text: pa.Array, w: np.ndarray, how: Settings) -> np.ndarray:
    return np.array([sigmoid(w[i] @ v) for i, v in features(text, how)], float)


def score(docs: DataFrame, weights: np.ndarray, how: Settings = Settings(), threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from `threshold` on), which replace columns of the same names.

    keep names the columns of docs to return, all by default. A null or empty text has the score of the bias
    alone; long texts are read whole, in pieces; equal texts have equal scores; an empty table gives an empty one. The
    weights are broadcast: 2**bits + 1 numbers.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(weights.astype(np.float32))
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    rest = docs.select(*kept) if "text" in kept else docs.select(*kept, "text")
    at, names = rest.columns.index("text"), [*kept, "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value.astype(float)
        for batch in batches:
            s = _scores(batch.column(at), w, how)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=names)

    schema = StructType([*rest.schema.fields[: len(kept)], StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return rest.mapInArrow(run, schema)


def keep_good(docs: DataFrame, weights: np.ndarray, how: Settings = Settings(), threshold: float = 0.7) -> DataFrame:
    """The rows of docs with a score of `threshold` or more, with their columns."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(weights.astype(np.float32))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value.astype(float)
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at), w, how) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id, mod: int, rest: int):
    """Whether crc32(doc_id as text) leaves `rest`; null doc_ids are never held out."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % mod == rest, F.lit(False))
