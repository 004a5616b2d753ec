"""Vocabularies, weights, distributions and corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.metrics import ratio


def label_counts(rows: DataFrame, labels: str) -> DataFrame:
    return rows.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def label_vocabulary(rows: DataFrame, labels: str, outside_first: bool = True) -> DataFrame:
    """label and label_id: distinct labels in order, O before all others if wanted. Few rows meet in one window."""
    order = [F.col("label") != "O", "label"] if outside_first else ["label"]
    return rows.select(F.explode(labels).alias("label")).distinct().select("label", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long").alias("label_id"))


def class_weights(rows: DataFrame, labels: str, weight_outside: float = 0.01, vocabulary: DataFrame | None = None) -> DataFrame:
    """Total over labels times count; the outside label has a fixed weight.

    With a vocabulary (label) there is a row for each of its labels: those that rows do not have weigh 1, and count as labels.
    """
    counts = label_counts(rows, labels)
    if vocabulary is not None:
        seen = vocabulary.select("label").distinct().join(counts.select(F.col("label").alias("__label"), "n"), F.col("label") == F.col("__label"), "left")
        weight = ratio(F.sum("n").over(Window.partitionBy()), F.count(F.lit(1)).over(Window.partitionBy()) * F.col("n"))
        return seen.select("label", F.round(F.when(F.col("label") == "O", F.lit(weight_outside)).when(F.col("n").isNull(), F.lit(1.0)).otherwise(weight), 6).alias("weight"))
    every = Window.partitionBy()
    weight = ratio(F.sum("n").over(every), F.count(F.lit(1)).over(every) * F.col("n"))
    return counts.select("label", F.round(F.when(F.col("label") == "O", F.lit(weight_outside)).otherwise(weight), 6).alias("weight"))


def label_distribution(rows: DataFrame, labels: str) -> DataFrame:
    counts = label_counts(rows, labels)
    return counts.select("label", "n", F.round(100 * ratio(F.col("n"), F.sum("n").over(Window.partitionBy())), 6).alias("percent"))


def word_vocabulary(words: DataFrame, most: int = 50_000, least: int = 2, reserved: int = 2) -> DataFrame:
    """word, n and word_id of the `most` - 2 most frequent lower-case words that occur `least` times.

    words has word, doc_id and pos; ties are in the order of first appearance. The cut to the most frequent is a
    top-k of counted words, so no single task sorts the vocabulary.
    """
    counts = words.groupBy(F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"))
    top = counts.orderBy(F.desc("n"), "first").limit(most - reserved)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "first"))
    return top.withColumn("word_id", (rank + reserved - 1).cast("long")).filter(F.col("n") >= least).select("word", "n", "word_id")


def char_vocabulary(words: DataFrame, reserved: int = 2) -> DataFrame:
    """char and char_id of the distinct lower-case characters, in code point order."""
    chars = words.select(F.explode(F.split(F.lower("word"), "")).alias("char")).filter("char <> ''").distinct()
    return chars.select("char", (F.row_number().over(Window.orderBy("char")) + reserved - 1).cast("long").alias("char_id"))


def oov(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """words, misses and hit_rate (%) of a vocabulary."""
    known = vocabulary.select(F.col("word").alias("__word"))
    got = words.groupBy(F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("n")).join(known, F.col("word") == F.col("__word"), "left")
    sums = got.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("words"), F.coalesce(F.sum(F.when(F.col("__word").isNull(), F.col("n"))), F.lit(0)).alias("misses"))
    return sums.select(F.col("words").cast("long").alias("words"), F.col("misses").cast("long").alias("misses"), F.round(100 * ratio(F.col("words") - F.col("misses"), F.col("words")), 6).alias("hit_rate"))


def embedding_matrix(vocabulary: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """word_id and vector of each word: its own, else small fixed pseudo-random numbers from a hash of the word."""
    v = vectors.select(F.col("word").alias("__word"), F.col("vector").alias("__vector"))
    noise = F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda k: (F.pmod(F.xxhash64("word", k), F.lit(2001)) - 1000) / F.lit(10000.0))
    return vocabulary.join(v, F.col("word") == F.col("__word"), "left").select("word_id", F.coalesce("__vector", noise).alias("vector"))


def top_weights(weights: DataFrame, k: int = 50) -> DataFrame:
    """The k features of each label with the largest absolute weight, ties by feature."""
    w = Window.partitionBy("label").orderBy(F.desc(F.abs("weight")), "feature")
    return weights.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def corpus_stats(rows: DataFrame) -> DataFrame:
    """Documents, tokens, spans and the least, most and mean tokens, by group; rows has grp, n_tokens and n_spans."""
    return rows.groupBy("grp").agg(
        F.count(F.lit(1)).alias("examples"),
        F.sum("n_tokens").cast("long").alias("tokens"),
        F.sum("n_spans").cast("long").alias("entities"),
        F.min("n_tokens").cast("long").alias("min_tokens"),
        F.max("n_tokens").cast("long").alias("max_tokens"),
        F.round(F.avg("n_tokens"), 6).alias("avg_tokens"),
    )


def levels(rows: DataFrame, dims: list[str], shares: tuple[float, ...] = (0.25, 0.5, 0.75), accuracy: int = 10_000) -> DataFrame:
    """corpus_stats() for every combination of dims in one pass, with quantiles of n_tokens.

    A dim that a row does not group by is null, and `level` has a bit set for it, the last dim's the lowest. Quantiles come from
    sketches that tasks merge: the rank of each is off by one part in `accuracy` of the group at most.
    """
    n = F.col("n_tokens")
    return rows.cube(*dims).agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("examples"),
        F.sum(n).cast("long").alias("tokens"),
        F.sum("n_spans").cast("long").alias("entities"),
        F.min(n).cast("long").alias("min_tokens"),
        F.max(n).cast("long").alias("max_tokens"),
        F.round(F.avg(n), 6).alias("avg_tokens"),
        F.percentile_approx(n, F.array(*map(F.lit, shares)), accuracy).alias("quantiles"),
    )


def best_epochs(history: DataFrame, patience: int = 3) -> DataFrame:
    """For each run of history (run, epoch, score): the first best epoch and the one that training stops at.

    Training stops when `patience` epochs in a row are no better than the best so far; null if it never does.
    """
    by = Window.partitionBy("run").orderBy("epoch")
    best = F.max("score").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = history.withColumn("better", best.isNull() | (F.col("score") > best))
    since = F.max(F.when(F.col("better"), F.col("epoch"))).over(by)
    waited = marked.withColumn("waited", F.col("epoch") - since)
    stop = waited.groupBy("run").agg(F.min(F.when(F.col("waited") >= patience, F.col("epoch"))).alias("stop_epoch"))
    seen = waited.join(stop.withColumnRenamed("run", "__run"), F.col("run") == F.col("__run")).filter(F.col("stop_epoch").isNull() | (F.col("epoch") <= F.col("stop_epoch")))
    return seen.groupBy("run").agg(F.max("score").alias("best_score"), F.max(F.when(F.col("better"), F.col("epoch"))).alias("best_epoch"), F.max("stop_epoch").alias("stop_epoch"))
