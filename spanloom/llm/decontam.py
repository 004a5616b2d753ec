"""Benchmark decontamination by greedy string tiling of documents with benchmark items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import hashing
from spanloom.llm.hashing import U
from spanloom.llm.shared import ship, stored

#: UTF-8 bytes of benchmark text up to which it is broadcast; the seeds of a larger one are joined by a shuffle.
PART_BYTES = 16_000_000
#: Log2 of the bits that tell which seeds of documents are worth a shuffle: 16 MB, whatever the benchmark's size.
SIEVE = 27
#: Tokens: runs of letters and digits in lower case; all else separates.
LETTERS = np.where(hashing.TOKENS == 1, 1, 0).astype(np.uint8)
BASE = U(0xB492B66FBE98F273)


def _tokens(column: pa.Array) -> Iterator[np.ndarray]:
    for _, h, bounds in hashing.words(pc.utf8_lower(column), LETTERS, hashing.SAME):
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield h[a:b]


class Items:
    """Benchmark items as token hashes, with the seeds (runs of `least` tokens) of all in one sorted list.

    Items of fewer tokens are in `short`: by their number of tokens, the hash of all of them and who has it.
    """

    def __init__(self, rows: list[tuple[int | None, str]], least: int):
        self.least = least
        rows = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        tokens = list(_tokens(pa.array([t for _, t in rows], pa.string()))) if rows else []
        self.items = [(i, h) for (i, _), h in zip(rows, tokens, strict=True) if len(h) >= least]
        self.short: dict[int, dict[int, list[int | None]]] = {}
        for (i, _), h in zip(rows, tokens, strict=True):
            if 0 < len(h) < least:
                self.short.setdefault(len(h), {}).setdefault(int(hashing.shingles(h, len(h))[0]), []).append(i)
        self.keys = {n: np.array(sorted(own), U) for n, own in self.short.items()}
        seeds = [hashing.shingles(h, least) for _, h in self.items]
        size = [len(s) for s in seeds]
        every = np.concatenate([np.zeros(0, U), *seeds])
        order = np.argsort(every, kind="stable")
        self.seeds = every[order]
        self.owner = np.repeat(np.arange(len(seeds)), size)[order]
        self.distinct = np.unique(self.seeds)

    def owners(self, seeds: np.ndarray) -> np.ndarray:
        """The items that have one of some distinct seeds."""
        a, b = np.searchsorted(self.seeds, seeds), np.searchsorted(self.seeds, seeds, "right")
        return np.unique(np.concatenate([self.owner[i:j] for i, j in zip(a, b, strict=True)]))


def running(x: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of `length` tokens, from running sums."""
    up, down = hashing._power(len(x) + 1)
    sums = np.zeros(len(x) + 1, U)
    np.cumsum((x + U(1)) * up[: len(x)], out=sums[1:])
    n = max(len(x) - length + 1, 0)
    return hashing.mix((sums[length : length + n] - sums[:n]) * down[:n])


def _begins(x: np.ndarray, free: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the runs of `length` unmarked tokens, their hashes, and whether an unmarked token is before them."""
    marked = np.concatenate(([0], np.cumsum(~free)))
    h = running(x, length)
    at = np.flatnonzero(marked[length : length + len(h)] == marked[: len(h)])
    return at, h[at], np.where(at > 0, free[at - 1], False)


def _matches(text: np.ndarray, item: np.ndarray, free_t: np.ndarray, free_i: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The longest matches of at least `length` unmarked tokens: size, place in item and in text.

    A pair of places begins one if the tokens before them differ or are marked. So places of a run that repeats itself
    are not paired with each other, but only those at its edge.
    """
    i, hi, before_i = _begins(text, free_t, length)
    j, hj, before_j = _begins(item, free_i, length)
    keep = np.isin(hi, hj)
    i, hi, before_i = i[keep], hi[keep], before_i[keep]
    order = np.argsort(hi, kind="stable")
    i, hi, before_i = i[order], hi[order], before_i[order]
    prior = np.where(before_i, text[i - 1], U(0))
    pairs = []
    for k in range(len(j)):
        a, b = np.searchsorted(hi, hj[k]), np.searchsorted(hi, hj[k], "right")
        own = i[a:b]
        if before_j[k]:
            own = own[~(before_i[a:b] & (prior[a:b] == item[j[k] - 1]))]
        if len(own):
            pairs.append((np.full(len(own), j[k]), own))
    if not pairs:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    j, i = (np.concatenate(x) for x in zip(*pairs, strict=True))
    size, live = np.full(len(i), length), np.arange(len(i))
    while len(live):
        p, q = i[live] + size[live], j[live] + size[live]
        inside = (p < len(text)) & (q < len(item))
        live, p, q = live[inside], p[inside], q[inside]
        on = free_t[p] & free_i[q] & (text[p] == item[q])
        live = live[on]
        size[live] += 1
    return size, j, i


def tile(text: np.ndarray, item: np.ndarray, least: int) -> int:
    """Tokens of item in greedy tiles with text: the longest match of unmarked tokens is marked again and again, of equal ones
    the first in item and then in text.

    Matches of a given length are found by running hashes over both sides; the search length halves from the
    item's length to `least`, matches longer than it are extended in full and marked longest first. What a tile leaves of
    other matches waits for its turn.
    """
    free_t, free_i = np.ones(len(text), bool), np.ones(len(item), bool)
    length, marked = len(item), 0
    while length >= least and free_i.any():
        size, j, i = _matches(text, item, free_t, free_i, length)
        while len(size):
            best = np.flatnonzero(size == size.max())
            best = best[j[best] == j[best].min()]
            k, at, to = int(size[best[0]]), int(j[best[0]]), int(i[best].min())
            free_t[to : to + k] = False
            free_i[at : at + k] = False
            marked += k
            # each match loses what of it lies in the tile, on either side
            cuts = np.stack([np.clip([to - i, to + k - i], 0, size), np.clip([at - j, at + k - j], 0, size)])
            first = np.where(cuts[0, 0] <= cuts[1, 0], 0, 1)
            rows = np.arange(len(size))
            (s1, e1), (s2, e2) = cuts[first, :, rows].T, cuts[1 - first, :, rows].T
            pieces = [(np.zeros_like(s1), s1), (e1, s2), (np.maximum(e1, e2), size)]
            size, j, i = (np.concatenate(x) for x in zip(*[((b - a)[w], (j + a)[w], (i + a)[w]) for a, b in pieces for w in [b - a >= length]], strict=True))
        if length == least:
            break
        length = max(length // 2, least)
    return marked



def leaks_of(column: pa.Array, items: Items, threshold: float) -> Iterator[list[tuple[int, int, float]]]:
    """For each row the items of which it has `threshold` of the tokens in tiles, or all of a short item in a run."""
    for h in _tokens(column):
        out = []
        for n, keys in items.keys.items():
            if len(h) >= n:
                runs = np.unique(hashing.shingles(h, n))
                out += [(i, n, 1.0) for k in runs[np.isin(runs, keys)].tolist() for i in items.short[n][k]]
        if len(h) >= items.least and len(items.distinct):
            runs = hashing.shingles(h, items.least)
            at = np.minimum(np.searchsorted(items.distinct, runs), len(items.distinct) - 1)
            hit = items.distinct[at] == runs
            if hit.any():
                seeds = np.unique(runs[hit])
                near = np.zeros(len(h) + 1, int)  # only tokens of a seed can be in a tile
                np.add.at(near, np.flatnonzero(hit), 1)
                np.add.at(near, np.flatnonzero(hit) + items.least, -1)
                inside = np.cumsum(near)[:-1] > 0
                # one foreign token between stretches keeps tiles from running over a gap
                keep = inside | np.concatenate(([False], inside[:-1]))
                short = np.where(inside, h, U(0))[keep]
                for o in items.owners(seeds).tolist():
                    item_id, tokens = items.items[o]
                    n = tile(short, tokens, items.least)
                    if n >= threshold * len(tokens):
                        out.append((item_id, n, n / len(tokens)))
        yield out


def _items(benchmark: DataFrame, unnamed: bool) -> tuple[DataFrame, bool]:
    """item_id and text of the benchmark, items without item_id only if `unnamed`, and whether it is small."""
    ship(benchmark.sparkSession)
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows if unnamed else rows.filter("item_id IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return rows, size <= PART_BYTES


def _held(rows: DataFrame, least: int):
    return rows.sparkSession.sparkContext.broadcast(Items([tuple(r) for r in rows.collect()], least))


def _seeds(least: int, items: bool, sieve=None):
    """key and seed: the distinct runs of `least` tokens of each text, or of fewer for short items.

    A run's hash has its length in it. Documents give runs of all lengths up to `least`, but only those that the sieve holds.
    """
    schema = pa.schema([("key", pa.int64()), ("seed", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if sieve is None else np.frombuffer(sieve.value, np.uint8)
        for batch in batches:
            keys, seeds = [], []
            for key, h in zip(batch.column(0).to_pylist(), _tokens(batch.column(1)), strict=True):
                lengths = ([min(len(h), least)] if len(h) else []) if items else range(1, min(len(h), least) + 1)
                own = [np.unique(hashing.mix(hashing.shingles(h, n) + U(n))) for n in lengths]
                own = np.concatenate([np.zeros(0, U), *own])
                if bits is not None:
                    at = own >> U(64 - SIEVE)
                    own = own[(bits[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 == 1]
                keys.append(np.full(len(own), key, np.int64))
                seeds.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (keys, seeds)], schema=schema)

    return run


def _sieve(seeds: DataFrame):
    """A bit for the leading SIEVE bits of each seed, as bytes; its size does not depend on the seeds."""
    at = seeds.select(F.shiftrightunsigned("seed", 64 - SIEVE).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 AS int)))").alias("b")).toPandas()
    bits = np.zeros(1 << (SIEVE - 6), np.int64)
    bits[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return seeds.sparkSession.sparkContext.broadcast(bits.astype("<i8").tobytes())


def _by_seeds(docs: DataFrame, items: DataFrame, threshold: float, least: int) -> DataFrame:
    """key, item_id, matched and coverage of the leaks of docs (key, text): both sides' seeds are joined by a shuffle,
    then the texts of the pairs that share one are tiled."""
    ikey = F.xxhash64("item_id", "text")
    items = stored(items.filter("text IS NOT NULL").distinct().select(ikey.alias("ikey"), "item_id", "text"), "leak-items")
    iseeds = stored(items.select("ikey", "text").mapInArrow(_seeds(least, True), "key long, seed long").withColumnRenamed("key", "ikey"), "leak-seeds")
    dseeds = docs.mapInArrow(_seeds(least, False, _sieve(iseeds)), "key long, seed long")
    pairs = stored(dseeds.join(iseeds, "seed").select("key", "ikey").distinct(), "leak-pairs")
    text = docs.join(pairs.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    both = pairs.join(text.withColumnRenamed("text", "t"), "key").join(items, "ikey").select("key", "t", "item_id", "text")
    schema = pa.schema([("key", pa.int64()), ("item_id", pa.int64()), ("matched", pa.int64()), ("coverage", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                own = Items([(batch.column(2)[k].as_py(), batch.column(3)[k].as_py())], least)
                found += [(batch.column(0)[k].as_py(), *x) for x in next(leaks_of(batch.column(1).slice(k, 1), own, threshold))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], f.type) for k, f in enumerate(schema)], schema=schema)

    return stored(both.mapInArrow(run, "key long, item_id long, matched long, coverage double"), "leak-found")


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, least: int = 5) -> DataFrame:
    """doc_id, item_id, matched (item tokens in tiles of `least` or more) and coverage, for coverage >= threshold.

    A row for each pair of a row of docs and a distinct item. Order of the tiles does not count, so reordered
    passages are found. Items of fewer than `least` tokens are found where all their tokens follow each other. Items
    with null id or text or no tokens are never found, null and empty texts have no leaks, long texts are read whole, and
    empty tables give none. Extra columns are not read. A benchmark of up to PART_BYTES is broadcast as a table of seeds; the
    seeds of a larger one are joined with those of the documents by a shuffle, after a sieve of fixed size.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("matched", pa.int64()), ("coverage", pa.float64())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items, small = _items(benchmark, False)
    if not small:
        keyed = rows.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
        found = _by_seeds(keyed.select("key", "text"), items, threshold, least)
        return keyed.select("key", "doc_id").join(found, "key").select("doc_id", "item_id", "matched", "coverage")
    held = _held(items, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *x) for i, own in zip(batch.column(0).to_pylist(), leaks_of(batch.column(1), held.value, threshold), strict=True) for x in own]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], f.type) for k, f in enumerate(schema)], schema=schema)

    return rows.mapInArrow(run, "doc_id long, item_id long, matched long, coverage double")


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, least: int = 5) -> DataFrame:
    """The rows of docs that leak no item, with their columns; what counts as a leak is said at leaks(). Null ids count as others."""
    at, schema = docs.columns.index("text"), docs.schema
    items, small = _items(benchmark, True)
    if not small:
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        found = _by_seeds(docs.select(F.xxhash64(text).alias("key"), text.alias("text")), items, threshold, least)
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
        return docs.select(row, F.xxhash64(text).alias("key")).join(found.select("key").distinct(), "key", "left_anti").select("__row.*")
    held = _held(items, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not x for x in leaks_of(batch.column(at), held.value, threshold)], pa.bool_()))

    return docs.mapInArrow(run, schema)
