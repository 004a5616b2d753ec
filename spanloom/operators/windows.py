"""Overlapping windows of long segments, their merge, and the alignment of tokens with subwords."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.functions.text import let

#: Most windows of a segment in greedy_windows, as in the published loop.
MOST = 101


def budget(max_length: int = 512) -> int:
    """Subwords of a window: nine tenths of what two special tokens leave."""
    return int((max_length - 2) * 0.9)


def uniform_windows(size: Column, max_length: int = 512, overlap: int = 50) -> Column:
    """Windows (window_idx, start, end) of `size` tokens of one subword each, end exclusive, as an array."""
    e = budget(max_length)
    step = e - overlap
    count = F.when(size <= e, 1).otherwise(F.ceil((size - e) / step).cast("int") + 1)
    window = lambda k: F.struct(k.cast("int").alias("window_idx"), (k * step).cast("int").alias("start"), F.least(size, k * step + e).cast("int").alias("end"))
    return F.when(size > 0, F.transform(F.sequence(F.lit(0), count - 1), window)).otherwise(F.array().cast("array<struct<window_idx:int,start:int,end:int>>"))


def owner(pos: Column, max_length: int = 512, overlap: int = 50) -> Column:
    """The first window that covers a position, by arithmetic."""
    e = budget(max_length)
    return F.when(pos < e, 0).otherwise(F.floor((pos - e) / (e - overlap)).cast("int") + 1)


def windowed(rows: DataFrame, tokens: str = "tokens", max_length: int = 512, overlap: int = 50) -> DataFrame:
    """One row for each window, with its tokens; rows whose tokens fit have one."""
    w = uniform_windows(F.size(tokens), max_length, overlap)
    slices = F.transform(w, lambda x: F.struct(x["window_idx"].alias("window_idx"), x["start"].alias("start"), x["end"].alias("end"), F.slice(tokens, x["start"] + 1, x["end"] - x["start"]).alias(tokens)))
    return rows.select(*[c for c in rows.columns if c != tokens], F.inline(slices))


def greedy_windows(cost: list[int], labels: list[str] | None, max_length: int = 512, overlap: int = 50, most: int | None = MOST) -> list[tuple[int, int]]:
    """Windows of tokens with given subword costs; at most `most` of a segment, or all with None.

    A window starts at half the budget, grows by ten tokens while the budget is not used up and ten more fit, and
    shrinks by a tenth, 50 times at most, while it does not fit. A window of more than `overlap` tokens that does not
    reach the end is cut after the last O of its final 19 tokens. A token that alone is too long is skipped.
    """
    limit, n = budget(max_length), len(cost)
    total = [0, *itertools.accumulate(cost)]
    if total[-1] <= limit:
        return [(0, n)] if n else []
    out, at = [], 0
    while at < n and (most is None or len(out) < most):
        used = lambda e, a=at: total[e] - total[a]
        end = min(at + limit // 2, n)
        while used(end) < limit and end < n and used(min(end + 10, n)) <= limit:
            end = min(end + 10, n)
        for _ in range(50):
            if used(end) <= limit or end - at == 1:
                break
            end = at + max(1, int((end - at) * 0.9))
        if used(end) > limit:
            end = at + 1
            if used(end) > limit:
                at += 1
                continue
        if end < n and end - at > overlap and labels is not None:
            last = (k + 1 for k in range(end - 1, max(at, end - 20), -1) if labels[k] == "O")
            end = next(last, end)
        out.append((at, end))
        if end >= n:
            break
        at += max(end - at - overlap, 1)
    return out


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """A batch in slices of rows whose lists have about `most` entries together, one row at least: what is made of a slice as
    Python objects is bounded, however large the batch."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def tokenizer_windows(rows: DataFrame, cost: Callable[[list[str]], list[int]], tokens: str = "tokens", labels: str | None = None, max_length: int = 512, overlap: int = 50, most: int | None = MOST) -> DataFrame:
    """windows of each row for any tokenizer: cost gives the subwords of each token. Adds `windows`; no shuffle."""
    names = rows.columns
    at, lab = names.index(tokens), names.index(labels) if labels else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in (part for whole in batches for part in slices(whole, at)):
            t = batch.column(at).to_pylist()
            own = batch.column(lab).to_pylist() if lab is not None else [None] * len(t)
            found = [[{"start": a, "end": b} for a, b in greedy_windows(cost(x or []), y, max_length, overlap, most)] for x, y in zip(t, own, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*names, "windows"])

    schema = rows.withColumn("windows", F.lit(None).cast("array<struct<start:int,end:int>>")).schema
    return rows.mapInArrow(run, schema)


def merge(pieces: DataFrame, key: str, size: Column, label: str = "label", filler: str = "O") -> DataFrame:
    """One label array for each key from window predictions (key, size, window_idx, start, labels).

    A position belongs to the first window that covers it; positions that none covers get the filler. Windows of
    a key are gathered by one shuffle on it; each then gives the slice of its labels that no earlier one covers, for which
    a window may not start before the one before it, as none does.
    """
    w = pieces.groupBy(key, size.alias("__size")).agg(F.array_sort(F.collect_list(F.struct("window_idx", "start", "labels"))).alias("__w"))
    ends = F.transform("__w", lambda x: x["start"] + F.size(x["labels"]))

    def slices(b: Column) -> Column:
        def own(x: Column, k: Column) -> Column:
            before = F.coalesce(F.array_max(F.slice(b["ends"], F.lit(1), k)), F.lit(0))
            first = F.greatest(before, x["start"])
            gap = F.array_repeat(F.lit(filler), F.greatest(F.lit(0), x["start"] - before))
            return F.concat(gap, F.slice(x["labels"], first - x["start"] + 1, F.greatest(F.lit(0), x["start"] + F.size(x["labels"]) - first)))

        return F.flatten(F.transform(b["w"], own))

    whole = T.pad(let(F.struct(F.col("__w").alias("w"), ends.alias("ends")), slices), F.col("__size"), F.lit(filler))
    return w.select(key, F.when(F.col("__size") > 0, whole).otherwise(F.array().cast("array<string>")).alias(label))


def named_windows(rows: DataFrame, key: str = "id", **how) -> DataFrame:
    """windowed() with the ids of segments of several windows followed by _w and the window's number."""
    cut = rows.withColumn("__many", F.size(uniform_windows(F.size(how.get("tokens", "tokens")), how.get("max_length", 512), how.get("overlap", 50))) > 1)
    out = windowed(cut, **how)
    name = F.when(F.col("__many"), F.concat(F.col(key).cast("string"), F.lit("_w"), F.col("window_idx").cast("string"))).otherwise(F.col(key).cast("string"))
    return out.withColumn("window_id", name).drop("__many")


def corpus(rows: DataFrame, key: str = "id", tokens: str = "tokens", enabled: bool = True, **how) -> tuple[DataFrame, DataFrame]:
    """named_windows() of a corpus, and one row of what it did: examples, windows, single, multiple and rate, the windows for
    each example. Without tokens an example has no window. Switched off, each example stays one row, whatever its length."""
    if enabled:
        out, n = named_windows(rows, key, tokens=tokens, **how), F.size(uniform_windows(F.size(tokens), how.get("max_length", 512), how.get("overlap", 50)))
    else:
        out = rows.withColumn("window_idx", F.lit(0)).withColumn("start", F.lit(0)).withColumn("end", F.size(tokens)).withColumn("window_id", F.col(key).cast("string"))
        n = F.lit(1)
    counts = rows.select(F.coalesce(n, F.lit(0)).alias("n")).agg(F.count(F.lit(1)).alias("examples"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("windows"), F.count_if(F.col("n") == 1).alias("single"), F.count_if(F.col("n") > 1).alias("multiple"))
    return out, counts.withColumn("rate", F.round(F.coalesce(F.try_divide(F.col("windows").cast("double"), F.col("examples").cast("double")), F.lit(0.0)), 6))


def worded(tokens: Column) -> Column:
    """The tokens that are not blank once cleaned, as (pos, token) with their place in the whole list."""
    placed = F.transform(tokens, lambda t, i: F.struct(i.alias("pos"), T.clean(t).alias("token")))
    return F.filter(placed, lambda x: F.coalesce(~x["token"].rlike(T.BLANK), F.lit(False)))


def scatter(size: Column, places: Column, labels: Column, filler: str = "O") -> Column:
    """labels at their places (ascending) of a list of `size`, the filler at all others. Surplus labels are dropped."""

    def filled(b: Column) -> Column:
        def piece(p: Column, k: Column) -> Column:
            before = F.when(k == 0, -1).otherwise(F.get(b["p"], k - 1))
            return F.concat(F.array_repeat(F.lit(filler), p - before - 1), F.array(F.coalesce(F.get(b["l"], k), F.lit(filler))))

        return F.flatten(F.transform(b["p"], piece))

    return T.pad(let(F.struct(places.alias("p"), labels.alias("l")), filled), size, F.lit(filler))


def predict(rows: DataFrame, score: Callable[[DataFrame], DataFrame], key: str, tokens: str = "tokens", label: str = "labels", max_length: int = 512, overlap: int = 50) -> DataFrame:
    """key and label: the labels that a scorer gives the tokens of each row, window by window.

    score takes rows with `tokens` and returns them with `pred_labels`. It sees the tokens of a window that are not blank;
    its labels go back to the tokens' own places, blank tokens get O, as do tokens it gives none. Windows are
    merged by the first that covers a place. Rows without tokens have no labels.
    """
    n = F.coalesce(F.size(tokens), F.lit(0))
    base = rows.select(F.col(key).alias("__key"), n.alias("__n"), F.col(tokens).alias("__tokens"))
    cut = windowed(base.filter("__n > 0"), "__tokens", max_length, overlap)
    cut = cut.withColumn("__own", worded(F.col("__tokens"))).withColumn("__at", F.transform("__own", lambda x: x["pos"]))
    seen = cut.select("__key", "__n", "window_idx", "start", F.size("__tokens").alias("__size"), "__at", F.transform("__own", lambda x: x["token"]).alias("tokens"))
    scored = score(seen)
    pieces = scored.select("__key", "__n", "window_idx", "start", scatter(F.col("__size"), F.col("__at"), F.col("pred_labels")).alias("labels"))
    merged = merge(pieces, "__key", F.col("__n"), label).select(F.col("__key").alias(key), label)
    return merged.union(base.filter("__n <= 0").select("__key", F.array().cast("array<string>")))


def align(subwords: Column, labels: Column, ids: Column, max_length: int, cls_id: int, sep_id: int, unknown: int = 100) -> Column:
    """Subwords of tokens with special tokens at both ends: (input_id, label, token index, first of its token).

    subwords is an array of arrays of ids (an empty one counts as one unknown id), ids maps labels to numbers. The
    first subword has its token's label, others -100. Tokens from the first on that does not fit are cut off.
    """
    entry = lambda i, l, t, f: F.struct(i.cast("int").alias("input_id"), l.cast("int").alias("label"), t.cast("int").alias("token"), f.alias("first"))
    special = lambda i: F.array(entry(F.lit(i), F.lit(-100), F.lit(-1), F.lit(False)))

    def number(k: Column) -> Column:
        return F.coalesce(F.try_element_at(ids, F.get(labels, k)), F.try_element_at(ids, F.lit("O")))

    def kept(full: Column) -> Column:
        start = F.struct(F.lit(1).alias("n"), F.lit(0).alias("kept"), F.lit(True).alias("go"))

        def step(a: Column, s: Column) -> Column:
            fits = a["go"] & (a["n"] + F.size(s) <= max_length - 1)
            return F.when(fits, F.struct((a["n"] + F.size(s)).alias("n"), (a["kept"] + 1).alias("kept"), F.lit(True).alias("go"))).otherwise(F.struct(a["n"].alias("n"), a["kept"].alias("kept"), F.lit(False).alias("go")))

        return F.slice(full, F.lit(1), F.aggregate(full, start, step, lambda a: a["kept"]))

    def body(full: Column) -> Column:
        one = lambda s, k: let(number(k), lambda n: F.transform(s, lambda x, j: entry(x, F.when(j == 0, n).otherwise(-100), k, j == 0)))
        return F.flatten(F.transform(kept(full), one))

    full = F.transform(subwords, lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(F.lit(unknown))))
    return F.concat(special(cls_id), let(full, body), special(sep_id))


def first_subwords(values: Column, words: Column) -> Column:
    """Values at the first position of each word; positions without a word (null or -1) are left out."""

    def pick(b: Column) -> Column:
        first = lambda w, i: F.when(w.isNotNull() & (w >= 0) & ~F.coalesce(F.get(b["w"], i - 1) == w, F.lit(False)), i)
        return F.transform(F.filter(F.transform(b["w"], first), lambda i: i.isNotNull()), lambda i: F.get(b["v"], i))

    return let(F.struct(values.alias("v"), words.alias("w")), pick)


def masked(values: Column, *masks: Column) -> Column:
    """Values where every mask is true or 1."""
    return F.transform(F.filter(F.arrays_zip(values.alias("v"), *[m.alias(f"m{k}") for k, m in enumerate(masks)]), lambda x: sum((F.when(x[f"m{k}"].cast("boolean"), 0).otherwise(1) for k in range(len(masks))), F.lit(0)) == 0), lambda x: x["v"])


def _filled(column: pa.Array, longest: np.ndarray, filler: object) -> pa.Array:
    """A list column whose rows are filled up to their `longest`; null rows stay null."""
    kind = column.type
    values, size = column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    null = column.is_null().to_numpy(zero_copy_only=False)
    want = np.where(null, 0, longest)
    start = np.cumsum(size) - size
    ends = np.concatenate(([0], np.cumsum(want)))
    place = np.arange(ends[-1]) - np.repeat(ends[:-1], want)
    at = np.where(place < np.repeat(size, want), np.repeat(start, want) + place, len(values))
    both = pa.concat_arrays([values, pa.array([filler], kind.value_type)])
    offsets = pa.array(ends.astype(np.int32), mask=np.append(null, False)) if null.any() else pa.array(ends.astype(np.int32))
    return pa.ListArray.from_arrays(offsets, both.take(pa.array(at)), type=pa.list_(kind.value_field))


def collate(rows: DataFrame, fillers: dict[str, object], size: int = 16) -> DataFrame:
    """rows with `batch` and `longest`, the array columns named in fillers filled up to the longest of their batch.

    Batches are `size` rows of one partition in the order they lie there, without a shuffle; `batch` is unique over all.
    Labels are filled with what the loss ignores, by their filler. Null arrays stay null.
    """
    schema = rows.select("*", F.lit(0).cast("long").alias("batch"), F.lit(0).alias("longest")).schema
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33

        def whole(table: pa.Table, first: int) -> pa.RecordBatch:
            part = table.combine_chunks().to_batches()[0]
            which = np.arange(part.num_rows) // size
            sizes = [pc.fill_null(pc.list_value_length(part.column(c)), 0).to_numpy(zero_copy_only=False) for c in fillers]
            longest = np.zeros(which[-1] + 1, np.int64)
            for x in sizes:
                np.maximum.at(longest, which, x)
            cols = [_filled(part.column(c), longest[which], fillers[c]) if c in fillers else part.column(c) for c in names]
            return pa.RecordBatch.from_arrays([*cols, pa.array(which + first), pa.array(longest[which].astype(np.int32))], names=[*names, "batch", "longest"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            full = table.num_rows // size * size
            if full:
                yield whole(table.slice(0, full), number)
                number += full // size
            held = table.slice(full).to_batches()
        if held and (table := pa.Table.from_batches(held)).num_rows:
            yield whole(table, number)

    return rows.mapInArrow(run, schema)
