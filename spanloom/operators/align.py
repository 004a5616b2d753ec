"""Tokens and predicted words by their places in the text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from spanloom.functions.text import let
from spanloom.operators.windows import slices


def offsets(text: Column, tokens: Column) -> Column:
    """The 0-based start of each token in the text, in order and without regard to case; null where it is not found.

    A token is looked for after the end of the last one that was found. For segments: the work grows with the square of
    their length; locate() is the form for long texts.
    """
    return let(F.lower(text), lambda low: _offsets(low, tokens))


def _offsets(low: Column, tokens: Column) -> Column:
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(1).alias("at"))

    def step(acc: Column, token: Column) -> Column:
        return let(
            F.position(F.lower(token), low, acc["at"]),
            lambda found: F.struct(
                F.array_append(acc["out"], F.when(found > 0, found - 1)).alias("out"),
                F.when(found > 0, found + F.length(token)).otherwise(acc["at"]).alias("at"),
            ),
        )

    return F.aggregate(tokens, start, step, lambda acc: acc["out"])



def labels_by_offset(starts: Column, predictions: Column, reach: int = 2) -> Column:
    """Each token's label: that of the predicted word with the nearest start within `reach`, the first of equals, else O.

    predictions is an array of structs with label, start and end; those without start or end (null or -1) are left out.
    """
    placed = F.filter(predictions, lambda p: (F.coalesce(p["start"], F.lit(-1)) != -1) & (F.coalesce(p["end"], F.lit(-1)) != -1))
    listed = F.transform(placed, lambda p, k: F.struct(p["start"].alias("start"), k.alias("k"), p["label"].alias("label")))

    def label(s: Column, ranked: Column) -> Column:
        near = F.filter(ranked, lambda p: F.abs(p["start"] - s) <= reach)
        best = F.array_min(F.transform(near, lambda p: F.struct(F.abs(p["start"] - s).alias("d"), p["k"].alias("k"), p["label"].alias("label"))))
        return F.coalesce(best["label"], F.lit("O"))

    return let(listed, lambda ranked: F.transform(starts, lambda s: F.when(s.isNull(), "O").otherwise(label(s, ranked))))


def locate(rows: DataFrame, text: str = "text", tokens: str = "tokens", out: str = "starts") -> DataFrame:
    """rows with offsets() as column `out`, in time linear in the text. A null text or null tokens have null.

    Python's lower case is used, which agrees with the column form but for a few letters that grow by it.
    """
    names = [c for c in rows.columns if c != out]
    x, t = names.index(text), names.index(tokens)

    def starts(low: str, words: list[str | None]) -> list[int | None]:
        found, at = [], 0
        for w in words:
            k = low.find(w.lower(), at) if w is not None else -1
            found.append(k if k >= 0 else None)
            at = k + len(w) if k >= 0 else at
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, t)):
            both = zip(batch.column(x).to_pylist(), batch.column(t).to_pylist(), strict=True)
            got = [None if a is None or b is None else starts(a.lower(), b) for a, b in both]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.list_(pa.int32()))], names=[*names, out])

    kept = rows.select(*[F.col(f"`{c}`") for c in names])
    return kept.mapInArrow(run, kept.withColumn(out, F.lit(None).cast("array<int>")).schema)


#: Characters of a cell, in which tokens and predictions of a text meet.
CELL = 4096


def packed(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with all columns but `by` as lists, one row for each stretch of rows of a batch with equal values of `by`; no shuffle."""
    rest = [c for c in rows.columns if c not in by]
    kinds = rows.schema
    schema = StructType([*[kinds[c] for c in by], *[StructField(c, ArrayType(kinds[c].dataType)) for c in rest]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for k in range(len(by)):
                codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            first = np.flatnonzero(new)
            ends = pa.array(np.append(first, batch.num_rows).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, c) for c in batch.columns[len(by) :]]
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(first)) for c in batch.columns[: len(by)]], *lists], names=[*by, *rest])

    return rows.select(*[F.col(f"`{c}`") for c in (*by, *rest)]).mapInArrow(run, schema)


def _nearest(row: np.ndarray, start: np.ndarray, p_row: np.ndarray, place: np.ndarray, rank: np.ndarray, reach: int) -> np.ndarray:
    """For each token (row, start) the index of the prediction of its row with the nearest place within reach and then the least
    rank; -1 without one."""
    if not len(place):
        return np.full(len(start), -1)
    least = min(place.min(), start.min() if len(start) else 0)
    wide = max(place.max(), start.max() if len(start) else 0) - least + reach + 2
    own, spots = row * wide + (start - least), p_row * wide + (place - least)
    order = np.lexsort((rank, spots))
    order = order[np.append(True, np.diff(spots[order]) != 0)]  # of one place the first
    spots = spots[order]
    after = np.searchsorted(spots, own)
    right, left = np.minimum(after, len(spots) - 1), np.maximum(after - 1, 0)
    far = np.iinfo(np.int64).max
    dr = np.where((after < len(spots)) & (spots[right] - own <= reach), spots[right] - own, far)
    dl = np.where((after > 0) & (own - spots[left] <= reach), own - spots[left], far)
    use_left = (dl < dr) | ((dl == dr) & (rank[order[left]] < rank[order[right]]))
    best = np.where(use_left, order[left], order[right])
    # of a row's last place and the next row's first one there is more than reach between
    return np.where(np.minimum(dl, dr) == far, -1, best)


def nearest_rows(tokens: DataFrame, predictions: DataFrame, key: str = "id", reach: int = 2) -> DataFrame:
    """tokens (key, pos, start) with `label` as labels_by_offset() gives it, for long texts: one join on key and place.

    predictions has key, k (their order), label, start and end. Both sides are packed into lists by cells of the text before
    they are shuffled; a prediction goes to the cells that it reaches. Cells meet by equality, and a cell's tokens find
    their nearest places by bisection.
    """
    placed = predictions.filter((F.coalesce("start", F.lit(-1)) != -1) & (F.coalesce("end", F.lit(-1)) != -1))
    cell = lambda at: F.floor(at / CELL).cast("long")
    cells = F.explode(F.array_distinct(F.array(cell(F.col("start") - reach), cell(F.col("start") + reach))))
    spots = placed.select(F.col(key).alias("__key"), cells.alias("__at"), F.col("start").cast("long").alias("__s"), F.col("k").alias("__k"), F.col("label").alias("__l"))
    spots = packed(spots, ["__key", "__at"]).groupBy("__key", "__at").agg(F.collect_list(F.struct("__s", "__k", "__l")).alias("__x"))
    spots = spots.select("__key", "__at", *[F.flatten(F.col("__x")[c]).alias(c) for c in ("__s", "__k", "__l")])
    plain = tokens.drop("label")
    names = [key, *[c for c in plain.columns if c != key]]
    own = packed(plain.withColumn("__cell", cell(F.col("start"))), [key, "__cell"])
    met = own.join(spots, (F.col(key) == F.col("__key")) & (F.col("__cell") == F.col("__at")), "left").drop("__key", "__at", "__cell")
    at = names.index("start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, at)):
            lists, (s, k, x) = batch.columns[1:-3], batch.columns[-3:]
            number = lambda c: np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False))
            row = number(lists[0])
            start = lists[at - 1].flatten().cast(pa.int64())
            known = np.flatnonzero(start.is_valid().to_numpy(zero_copy_only=False))
            rank = pc.rank(k.flatten(), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
            best = np.full(len(start), -1)
            best[known] = _nearest(row[known], start.take(pa.array(known)).to_numpy(), number(s), s.flatten().to_numpy(), rank, reach)
            label = pc.fill_null(x.flatten().take(pa.array(best, mask=best < 0)), "O")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *[c.flatten() for c in lists], label], names=[*names, "label"])

    schema = plain.select(*names).withColumn("label", F.lit("O")).schema
    return met.mapInArrow(run, schema).select(*plain.columns, "label")
