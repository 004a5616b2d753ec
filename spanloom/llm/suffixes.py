"""Removal of long byte strings that occur earlier in the corpus, by a logarithmic family of suffix arrays.

Documents come in batches of ascending ids. A batch gets a suffix array; it is scanned together with the arrays of the
levels, which hold all earlier batches, and then becomes a level itself. Levels of equal size merge, so that n batches leave at
most log2(n) + 1 levels and each suffix is rewritten as often at most.

Suffixes are compared over their first WIDTH bytes. To bring equal ones together, arrays are cut into buckets by seeds: the seed
of a window of WIDTH bytes is, of the strings of SEED bytes in it, the one with the least hash, so equal windows have
equal seeds. Windows that follow each other share a seed mostly; such a run is one entry of an array: its seed, the hash of
its bytes, and the place where it begins first. A run with an entry of equal bytes before it needs no look at its text: all its suffixes
have an equal. Where a seed has several different runs, their texts are read, and the suffixes of level and batch are sorted into
one order, in which neighbours that share WIDTH bytes are the long matches.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from spanloom.llm import hashing
from spanloom.llm.hashing import U, mix
from spanloom.llm.jaccard import IDS
from spanloom.llm.shared import discard, place, ship, small_batches, stored

#: Bytes of a match and of a seed (a power of two).
WIDTH, SEED = 100, 32
#: Bytes of text whose windows are taken at once.
RUN = 1 << 17
#: Rows of a list that is broadcast; bytes of runs that are sorted at once; runs of a seed that are sorted together.
FEW, SORTED, HOT = 100_000, 1 << 18, 5_000
#: Runs among which equal ones are found at once, by documents as a whole.
GATHERED = 50_000
#: Documents that a task is handed at once.
ROWS = 300
#: Batches of a whole table.
BATCHES = 3


def seeds(b: np.ndarray) -> np.ndarray:
    """A hash of the SEED bytes from each place on, by doubling."""
    h, n = b.astype(U) + U(1), 1
    while n < SEED:
        h = mix(h[:-n] * U(0x9E3779B97F4A7C15) + h[n:]) if n >= 8 else h[:-n] * U(0xD6E8FEB86659FD93) + h[n:]
        n *= 2
    return h


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The least of the `width` values from each place on, by doubling."""
    n = 1
    while 2 * n <= width:
        x, n = np.minimum(x[:-n], x[n:]), 2 * n
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def runs_of(b: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """The runs of windows with one seed in texts that lie behind each other: first window, windows, place of the seed in
    the first, seed and hash of the bytes."""
    if len(b) < WIDTH:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + tuple(np.zeros(0, U) for _ in range(2))
    h = seeds(b)
    low = U((1 << 24) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=U)
    at = (least_of(key, WIDTH - SEED + 1) & low).astype(np.int64)
    turn = np.zeros(len(b) + 1, np.int32)  # windows may not go past the end of a text
    np.add.at(turn, np.maximum(bounds[1:] - WIDTH + 1, bounds[:-1]), 1)
    np.add.at(turn, bounds[1:], -1)
    fits = np.cumsum(turn[: len(at)]) == 0
    same = fits[1:] & fits[:-1] & (at[1:] == at[:-1])
    lo = np.flatnonzero(fits & ~np.concatenate(([False], same)))
    hi = np.flatnonzero(fits & ~np.concatenate((same, [False])))
    n, off = hi - lo + 1, at[lo] - lo
    up, down = hashing._power(len(b) + 1)
    sums = np.zeros(len(b) + 1, U)
    np.cumsum((b.astype(U) + U(1)) * up[: len(b)], out=sums[1:])
    c = (sums[hi + WIDTH] - sums[lo]) * down[lo]
    return lo, n, off, h[at[lo]], mix(c + (off * 256 + n).astype(U) * U(0xD6E8FEB86659FD93))


def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, bytes before, bytes and bounds of texts by runs of rows; a long text in parts that overlap by WIDTH - 1."""
    data, bounds = hashing.texts(column)
    row = 0
    while row < len(column):
        to = max(int(np.searchsorted(bounds, bounds[row] + RUN, "right")) - 1, row + 1)
        size = int(bounds[to] - bounds[row])
        if size <= RUN:
            yield row, 0, data[bounds[row] : bounds[to]], bounds[row : to + 1] - bounds[row]
        else:
            for a in range(0, size - WIDTH + 1, RUN):
                part = data[bounds[row] + a : bounds[row] + min(a + RUN + WIDTH - 1, size)]
                yield row, a, part, np.array([0, len(part)])
        row = to


ENTRIES = "d long, lo long, n long, off int, g long, c long, first boolean"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of a batch's documents (d, text): those that are the first of their bytes among some documents, as entries,
    and the others, joined to longer ones, as matches already found."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        ids, last = batch.column(0).to_numpy(), -1
        for row, before, b, bounds in pieces(batch.column(1)):
            if size > GATHERED and row != last:
                yield from _gathered(held)
                held, size = [], 0
                pa.default_memory_pool().release_unused()
            lo, n, off, g, c = runs_of(b, bounds)
            k = np.searchsorted(bounds, lo, "right") - 1
            held.append((ids[row + k], lo - bounds[k] + before, n, off, g, c))
            size, last = size + len(lo), row + len(bounds) - 2
    if held:
        yield from _gathered(held)


def _gathered(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in ENTRIES.split(", ")]
    d, lo, n, off, g, c = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((lo, d, c, g))
    first = np.ones(len(order), bool)
    first[order[1:]] = (g[order[1:]] != g[order[:-1]]) | (c[order[1:]] != c[order[:-1]])
    yield pa.RecordBatch.from_arrays([*(pa.array(x[first].astype(np.int64)) for x in (d, lo, n)), pa.array(off[first].astype(np.int32)), *(pa.array(x[first].view(np.int64)) for x in (g, c)), pa.array(np.ones(int(first.sum()), bool))], names=names)
    order = np.flatnonzero(~first)
    order = order[np.lexsort((lo[order], d[order]))]
    d, lo, n = d[order], lo[order], n[order]
    start = np.ones(len(d), bool)
    start[1:] = (d[1:] != d[:-1]) | (lo[1:] > lo[:-1] + n[:-1])
    k = np.flatnonzero(start)
    end = np.append(k[1:], len(d)) - 1
    none = np.zeros(len(k), np.int64)
    size = lo[end] + n[end] - lo[k] if len(k) else none
    yield pa.RecordBatch.from_arrays([pa.array(d[k]), pa.array(lo[k]), pa.array(size), pa.array(none.astype(np.int32)), pa.array(none), pa.array(none), pa.array(np.zeros(len(k), bool))], names=names)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted runs of texts."""
    names = ["g", "d", "at", "old", "hot", "b"]
    for batch in batches:
        data, bounds = hashing.texts(batch.column(1))
        lists = batch.column(2)
        size = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        g, at, old, hot = (flat.field(k) for k in range(4))
        where = at.to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.repeat(bounds[:-1], size) + (where >> 16)
        end = start + (where & 255) + WIDTH - 1
        raw = memoryview(data)
        for a in range(0, len(where), 20_000):
            cut = [raw[i:j] for i, j in zip(start[a : a + 20_000].tolist(), end[a : a + 20_000].tolist(), strict=True)]
            d = np.repeat(batch.column(0).to_numpy(), size)[a : a + 20_000]
            yield pa.RecordBatch.from_arrays([g.slice(a, len(cut)), pa.array(d), at.slice(a, len(cut)), old.slice(a, len(cut)), hot.slice(a, len(cut)), pa.array(cut, pa.binary())], names=names)


def suffix_order(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at `starts` by their first WIDTH bytes, equal ones by place, and which of them share
    all of these with the one before in the order."""
    wide = text.astype(U)
    for n in (1, 2, 4):
        wide = (wide[:-n] << U(8 * n)) | wide[n:]
    places = [*range(0, WIDTH - 7, 8), *([WIDTH - 8] if WIDTH % 8 else [])]
    order = np.arange(len(starts))
    for k in reversed(places):  # by the last eight bytes first, each sort keeping the order of the one before
        order = order[np.argsort(wide[starts[order] + k], kind="stable")]
    equal = np.zeros(len(order), bool)
    equal[1:] = True
    for k in places:
        w = wide[starts[order] + k]
        equal[1:] &= w[1:] == w[:-1]
    return order, equal


def matched(d: np.ndarray, at: np.ndarray, old: np.ndarray, text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of runs in order of place, old ones being a level's: the windows of new ones that begin earlier too, as
    document, first window and number of windows."""
    n = at & 255
    run = np.repeat(np.arange(len(d)), n)
    shift = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    order, equal = suffix_order(text, bounds[:-1][run] + shift)
    marks = np.zeros(len(run), bool)
    marks[order] = equal  # the earliest of equal suffixes is the first of them
    marks &= ~old[run]
    k = np.flatnonzero(marks)
    start = np.ones(len(k), bool)
    start[1:] = (k[1:] != k[:-1] + 1) | (run[k[1:]] != run[k[:-1]])
    a = np.flatnonzero(start)
    size = np.diff(np.append(a, len(k)))
    return d[run[k[a]]], (at[run[k[a]]] >> 16) + shift[k[a]], size


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of a partition of runs (g, d, at, old, b) in order, some seeds at a time."""
    held: list[pa.RecordBatch] = []
    size = 0

    def found(rows: pa.Table) -> pa.RecordBatch:
        data, bounds = hashing.texts(rows.column("b").combine_chunks() if rows.column("b").num_chunks != 1 else rows.column("b").chunk(0))
        text = data[bounds[0] : bounds[-1]]
        got = matched(rows["d"].to_numpy(), rows["at"].to_numpy(), rows["old"].to_numpy(), text, bounds - bounds[0])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["d", "lo", "n"])

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > SORTED:
            rows = pa.Table.from_batches(held)
            g = rows["g"].to_numpy()
            end = len(g) - int((g == g[-1]).sum())  # the last seed may go on in the next batch
            if end:
                yield found(rows.slice(0, end))
                pa.default_memory_pool().release_unused()
                held = rows.slice(end).combine_chunks().to_batches()
                size = sum(x.nbytes for x in held)
    if held and (rows := pa.Table.from_batches(held)).num_rows:
        yield found(rows)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of runs, one by one, with a hash of 128 bits of their bytes."""
    import hashlib

    for batch in batches:
        d, at, old = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        rows = [(int(x), int(y >> 16) + k, bool(z), hashlib.blake2b(b[k : k + WIDTH], digest_size=16).digest()) for x, y, z, b in zip(d, at, old, batch.column(3).to_pylist(), strict=True) for k in range(int(y & 255))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], names=["d", "lo", "old", "print"])


class Family:
    """The index of all batches so far; add() returns what of a new batch occurs earlier.

    Arrays are bucketed tables in the shared folder, so that scans and merges of levels need no shuffle of what they hold.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        ship(spark)
        small_batches(spark, ROWS)
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[int, DataFrame, str]] = []

    def _array(self, rows: DataFrame) -> tuple[DataFrame, str]:
        """Entries (g, c, d, at), each run of bytes with the place where it begins first, in buckets of seeds."""
        name = f"suffixes_{uuid.uuid4().hex}"
        least = rows.repartition(self.buckets, "g").groupBy("g", "c").agg(F.min("d").alias("d"), F.min_by("at", "d").alias("at"), F.sum("times").alias("times"))
        least.write.bucketBy(self.buckets, "g").sortBy("g", "c").option("path", place(self.spark, "suffixes")).saveAsTable(name)
        return self.spark.table(name), name

    def _drop(self, level: tuple[int, DataFrame, str]) -> None:
        discard(level[1])
        self.spark.sql(f"DROP TABLE {level[2]}")

    def _merge(self) -> None:
        """Merge levels of equal size, the newest first."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append((a[0] + b[0], *self._array(a[1].unionByName(b[1]))))
            self._drop(a)
            self._drop(b)

    def add(self, batch: DataFrame, texts: DataFrame) -> DataFrame:
        """d, lo and n: the windows lo to lo + n - 1 of documents of batch (d, text) begin earlier too.

        d is a number without repeats, greater than those of all batches before; texts holds the documents of those and of this one.
        """
        # Spark drops the shuffle files and broadcast tables of earlier batches once the driver has forgotten their plans
        gc.collect()
        self.spark._jvm.System.gc()
        self._merge()
        rows = stored(batch.mapInArrow(_entries, ENTRIES), "suffix-entries")
        leads = rows.filter("first").select("g", "c", "d", ((F.col("lo") * 256 + F.col("off")) * 256 + F.col("n")).alias("at"))
        array, name = self._array(leads.withColumn("times", F.lit(1).cast("long")))
        nothing = array.filter("false").select("g", "c", "d", "at")
        met = [level.join(array.select("g").hint("shuffle_hash"), "g", "left_semi").select("g", "c", "d", "at") for _, level, _ in self.levels]
        old = reduce(DataFrame.unionByName, met, nothing).groupBy("g", "c").agg(F.min("d").alias("d"), F.min_by("at", "d").alias("at"))
        old = stored(old, "suffix-met")
        several = array.groupBy("g").agg(F.min("c").alias("__a"), F.max("c").alias("__b")).filter("__a <> __b").select("g")
        shared = stored(old.select("g").union(several).distinct(), "suffix-seeds")
        same = old.select("g", "c", F.lit(True).alias("old"))
        marked = array.join(self._few(same), ["g", "c"], "left").join(self._few(shared.withColumn("shared", F.lit(True))), "g", "left")
        marked = stored(marked.filter("times > 1 OR old OR shared"), "suffix-marked")
        # runs of equal bytes: all but the first are matches
        known = marked.filter("times > 1 OR old").select("g", "c", F.col("d").alias("__d"), F.col("at").alias("__at"), "old")
        again = leads.join(self._few(known), ["g", "c"]).filter(F.coalesce("old", F.lit(False)) | (F.col("d") != F.col("__d")) | (F.col("at") != F.col("__at")))
        again = again.select("d", F.shiftright("at", 16).alias("lo"), F.col("at").bitwiseAND(255).alias("n"))
        # different runs of one seed: their suffixes are sorted
        new = marked.filter("shared AND old IS NULL").select("g", "d", "at", F.lit(False).alias("old"))
        met = old.join(new.select("g").hint("shuffle_hash"), "g", "left_semi").select("g", "d", "at", F.lit(True).alias("old"))
        wanted = new.unionByName(met)
        hot = stored(wanted.groupBy("g").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > HOT).select("g", F.lit(True).alias("hot")), "suffix-hot")
        any_hot = not hot.isEmpty()
        flagged = wanted.join(self._few(hot), "g", "left") if any_hot else wanted.withColumn("hot", F.lit(False))
        lists = stored(flagged.groupBy("d").agg(F.collect_list(F.struct("g", "at", "old", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("runs")), "suffix-lists")
        parts = stored(reading(texts, lists).select("d", "text", "runs").mapInArrow(_cut, "g long, d long, at long, old boolean, hot boolean, b binary"), "suffix-runs")
        by_seed = parts.filter("NOT hot").select("g", "d", "at", "old", "b").repartition("g").sortWithinPartitions("g", "d", "at")
        found = by_seed.mapInArrow(_scan, "d long, lo long, n long")
        out = rows.filter("NOT first").select("d", "lo", "n").unionByName(again).unionByName(found)
        if any_hot:
            out = out.unionByName(hot_matches(parts.filter("hot")))
        out = stored(out, "suffix-matches")
        for x in (rows, old, shared, marked, hot, lists, parts):
            discard(x)
        self.levels.append((1, array, name))
        return out

    def _few(self, rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if rows.count() <= FEW else rows

    def close(self) -> None:
        for level in self.levels:
            self._drop(level)
        self.levels = []


def hot_matches(parts: DataFrame) -> DataFrame:
    """Matches in runs of seeds that very many different runs have: windows meet by the hash of all their bytes."""
    rows = stored(parts.select("d", "at", "old", "b").mapInArrow(_windows, "d long, lo long, old boolean, print binary"), "suffix-windows")
    own = rows.groupBy("print", "d").agg(F.min("lo").alias("lo"))
    first = own.groupBy("print").agg(F.min("d").alias("__d"), F.min_by("lo", "d").alias("__lo"))
    got = rows.filter("NOT old").join(first, "print").filter((F.col("d") != F.col("__d")) | (F.col("lo") != F.col("__lo")))
    return got.select("d", "lo", F.lit(1).cast("long").alias("n"))


def reading(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """texts joined with rows by d; with a list of up to IDS documents no other text moves."""
    if rows.count() <= IDS:
        texts = texts.join(F.broadcast(rows.select("d")), "d", "left_semi")
    return texts.join(rows.hint("shuffle_hash"), "d")


def numbered(docs: DataFrame) -> DataFrame:
    """d, doc_id, copies and text, d in the order of documents.

    d is doc_id where that has no null and no repeats. Else different texts of one doc_id are ordered by their hash, null comes
    last, and equal rows are one row with their number as copies.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    odd = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL").limit(1).count()
    if not odd:
        return rows.select(F.col("doc_id").alias("d"), "doc_id", F.lit(1).cast("long").alias("copies"), "text")
    one = rows.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    keys = [F.col("doc_id").asc_nulls_last(), F.sha2("text", 256)]
    ordered = one.repartitionByRange(docs.sparkSession.sparkContext.defaultParallelism, *keys).sortWithinPartitions(*keys)
    return stored(ordered.select(F.monotonically_increasing_id().alias("d"), "doc_id", "copies", "text"), "suffix-documents")


def matches(texts: DataFrame, batches: int = BATCHES) -> DataFrame:
    """d, lo, n of all windows of texts (d, text) that begin earlier too, batch by batch."""
    spark = texts.sparkSession
    cuts = sorted(set(texts.approxQuantile("d", [k / batches for k in range(1, batches)], 0.01))) if batches > 1 else []
    cuts = [int(c) for c in cuts]
    family, out = Family(spark), []
    for a, b in zip([None, *cuts], [*cuts, None], strict=True):
        upto = texts if b is None else texts.filter(F.col("d") <= b)
        out.append(family.add(upto if a is None else upto.filter(F.col("d") > a), upto))
    family.close()
    return reduce(DataFrame.unionByName, out)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the removal of matched windows leaves of texts."""
    for whole in batches:
        for at in range(0, whole.num_rows, 250):
            batch = whole.slice(at, 250)
            data, bounds = hashing.texts(batch.column(2))
            out = []
            for k, found in enumerate(batch.column(3).to_pylist()):
                text = data[bounds[k] : bounds[k + 1]]
                if not found:
                    out.append((len(text), 0, 0, text))
                    continue
                turn = np.zeros(len(text) + 1, np.int32)
                for x in found:
                    turn[x["lo"]] += 1
                    turn[x["lo"] + x["n"] + WIDTH - 1] -= 1
                gone = np.cumsum(turn[:-1]) > 0
                out.append((len(text), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), text[~gone]))
            cols = [pa.array([x[k] for x in out], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *cols, pa.array([memoryview(np.ascontiguousarray(x[3])) for x in out], pa.binary())], names=[f.name for f in KEPT])


KEPT = StructType([StructField(c, LongType()) for c in ("doc_id", "copies", "n_bytes", "n_removed", "n_spans")] + [StructField("kept", BinaryType())])


def without_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that are left, in order) of each row of docs (doc_id, text).

    A byte goes if it lies in a string of WIDTH bytes that begins earlier too: in a smaller doc_id, or earlier in the same document. A null
    text is empty; a null doc_id comes after all others; of different texts with one doc_id the one with the smaller SHA-256 is
    earlier; of equal rows the first is. Texts under WIDTH bytes stay whole; long texts are read whole; extra columns are
    not read; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    texts = numbered(docs)
    found = matches(texts.select("d", "text"), batches)
    lists = stored(found.groupBy("d").agg(F.collect_list(F.struct("lo", "n")).alias("found")), "suffix-found")
    if lists.count() <= IDS:
        ids = F.broadcast(lists.select("d"))
        some, rest = texts.join(ids, "d", "left_semi").join(lists.hint("shuffle_hash"), "d"), texts.join(ids, "d", "left_anti")
        none = F.lit(0).cast("long")
        whole = rest.select("doc_id", "copies", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.col("text").cast("binary").alias("kept"))
        out = some.select("doc_id", "copies", "text", "found").mapInArrow(_kept, KEPT).unionByName(whole)
    else:
        out = texts.join(lists, "d", "left").select("doc_id", "copies", "text", "found").mapInArrow(_kept, KEPT)
    # of equal rows all but one occur earlier as they are
    gone = F.col("copy") & (F.col("n_bytes") >= WIDTH)
    out = out.withColumn("copy", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("copies")), lambda k: k > 1)))
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.when(F.col("copy"), 0).otherwise(F.col("n_removed"))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.when(F.col("copy"), 0).otherwise(F.col("n_spans"))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )
