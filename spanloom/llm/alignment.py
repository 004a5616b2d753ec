"""Alignment of two tokenizers' ids over the same texts, by whole Arrow batches.

The bytes of a run of documents lie behind each other. The ends of the tokens of either tokenizer are counted once over all
of them, and where both have an end the run is cut: what lies between two cuts is a group of A ids and B ids. Documents
end at cuts, so prefix sums over groups, taken at the documents' ends, give each document's figures.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from spanloom.llm import hashing
from spanloom.llm.shared import place, ship

#: Bytes of text that are aligned at once; pairs of a group from which they are taken by distinct ids.
RUN, WIDE = 1 << 22, 1 << 16
#: Id pairs whose counts each task holds (16 bytes each), those in most documents. Others are joined.
HELD = 2_000_000
#: Distinct pairs that a task gathers before it hands their counts on.
GATHERED = 4_000_000
#: How byte-level tokenizers split texts before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

BLANK = re.compile(r"\s{1000}")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Tokenizer A: byte-level BPE from a tokenizers file; special tokens' strings are ordinary text.

    Where ids follow the order of merges, as ranks do, the merges run in tiktoken, several times as fast.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        letters, vocab = byte_letters(), told["model"]["vocab"]
        added = {x["content"] for x in told["added_tokens"]}
        self.bytes = [b""] * (1 + max(*vocab.values(), *(x["id"] for x in told["added_tokens"]), 0))
        for piece, i in vocab.items():
            if piece not in added:
                self.bytes[i] = bytes(letters[c] for c in piece)
        merged = ["".join(m) if not isinstance(m, str) else m.replace(" ", "") for m in told["model"]["merges"]]
        ranks = [vocab[m] for m in merged]
        how = told.get("pre_tokenizer") or {}
        plain = how.get("type") == "ByteLevel" and how.get("use_regex", True) and not how.get("add_prefix_space") and not told.get("normalizer") and not told["model"].get("ignore_merges")
        self.quick = None
        if plain and all(a < b for a, b in zip(ranks, ranks[1:])) and all(vocab[c] < ranks[0] for c in letters):
            import tiktoken

            self.quick = tiktoken.Encoding("merges", pat_str=SPLIT, mergeable_ranks={b: i for i, b in enumerate(self.bytes) if b}, special_tokens={})
        self.path, self.slow = path, None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.quick is not None:  # its pattern can't go through very long blanks
            return [np.array(self.quick.encode_ordinary(x), np.int64) if not BLANK.search(x) else self.encode_slowly([x])[0] for x in texts]
        return self.encode_slowly(texts)

    def encode_slowly(self, texts: list[str]) -> list[np.ndarray]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = True
        return [np.array(e.ids, np.int64) for e in self.slow.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """Tokenizer B: a sentencepiece model, which adds the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes.append(bytes([int(piece[3:-1], 16)]))
            elif self.model.is_control(i) or self.model.is_unknown(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.model.encode(texts, num_threads=1)]


def printed(count: int, mark: str) -> np.ndarray:
    """The decimal numbers below count, each with a mark, as rows of bytes filled up with zeros."""
    width = len(str(count)) + 1
    return np.array([f"{i}{mark}" for i in range(count)], f"S{width}").view(np.uint8).reshape(count, width)


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.sizes = [np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b)]
        n, m = len(self.a.bytes), len(self.b.bytes)
        self.base = m
        width = max(len(str(n)), len(str(m))) + 1
        rows = [printed(n, ","), printed(n, "|"), printed(m, ","), printed(m, ";")]
        self.text = np.concatenate([np.pad(r, ((0, 0), (0, width - r.shape[1]))) for r in rows])

    def ids(self, texts: list[str]) -> tuple[list[int], list[np.ndarray], list[np.ndarray], list[int]]:
        """Of the texts whose tokens spell a space and the text: their places, A ids, B ids and bytes."""
        full = [k for k, t in enumerate(texts) if t]
        a, b = self.a.encode([" " + texts[k] for k in full]), self.b.encode([texts[k] for k in full])
        out: tuple = ([], [], [], [])
        for k, x, y in zip(full, a, b, strict=True):
            raw = (" " + texts[k]).encode()
            if b"".join(map(self.a.bytes.__getitem__, x.tolist())) == raw and b"".join(map(self.b.bytes.__getitem__, y.tolist())) == raw:
                for held, v in zip(out, (k, x, y, len(raw)), strict=True):
                    held.append(v)
        return out

    def align(self, texts: list[str]) -> Groups:
        return Groups(self, len(texts), *self.ids(texts))


class Groups:
    """The groups of a run of documents, and what follows from them."""

    def __init__(self, how: Aligner, rows: int, at: list[int], a: list[np.ndarray], b: list[np.ndarray], size: list[int]):
        self.how, self.rows, self.at = how, rows, np.array(at, np.int64)
        none = np.zeros(0, np.int64)
        self.a, self.b = np.concatenate([none, *a]), np.concatenate([none, *b])
        self.count_a, self.count_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        ends_a, ends_b = (np.cumsum(s[x]) - 1 for s, x in zip(how.sizes, (self.a, self.b), strict=True))
        total = sum(size)
        cut = (np.bincount(ends_a, minlength=total) > 0) & (np.bincount(ends_b, minlength=total) > 0)
        through = np.cumsum(cut)
        self.group_a, self.group_b = through[ends_a] - cut[ends_a], through[ends_b] - cut[ends_b]
        groups = int(through[-1]) if total else 0
        self.size_a, self.size_b = np.bincount(self.group_a, minlength=groups), np.bincount(self.group_b, minlength=groups)
        self.last = through[np.cumsum(size) - 1] if size else none  # groups up to each document's end
        self.byte_ends = np.flatnonzero(cut) + 1

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Sums over groups for each document, from prefix sums."""
        sums = np.concatenate(([0], np.cumsum(values)))[self.last]
        return np.diff(sums, prepend=0)

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Values of the aligned documents at their places among all, else 0."""
        out = np.zeros(self.rows, np.int64)
        out[self.at] = values
        return out

    def prints(self) -> list[str]:
        """The hash of each document's groups in decimal ids; '' without tokens."""
        how, n, m = self.how, len(self.how.a.bytes), len(self.how.b.bytes)
        until_a, until_b = np.cumsum(self.size_a), np.cumsum(self.size_b)
        last_a, last_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        last_a[until_a - 1], last_b[until_b - 1] = True, True
        items = np.zeros(len(self.a) + len(self.b), np.int64)
        items[np.arange(len(self.a)) + (until_b - self.size_b)[self.group_a]] = self.a + n * last_a
        items[np.arange(len(self.b)) + until_a[self.group_b]] = 2 * n + self.b + m * last_b
        text = how.text[items]
        used = text != 0
        flat, ends = text[used], np.cumsum(used.sum(axis=1))
        to = ends[np.cumsum(self.count_a + self.count_b) - 1].tolist() if len(self.at) else []
        out = [""] * self.rows
        for k, i, j in zip(self.at.tolist(), [0, *to[:-1]], to, strict=True):
            out[k] = hashlib.sha256(flat[i : j - 1]).hexdigest()
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Linked id pairs of each document: document, pair (A id * base + B id) and how often, in order."""
        base, doc = self.how.base, np.repeat(np.arange(len(self.last)), np.diff(self.last, prepend=0))
        wide = self.size_a * self.size_b > WIDE
        some = ~wide[self.group_a]
        a, g = self.a[some], self.group_a[some]
        times = self.size_b[g]
        first = np.repeat((np.cumsum(self.size_b) - self.size_b)[g] - (np.cumsum(times) - times), times)
        b = self.b[first + np.arange(len(first))]
        span = len(self.how.a.bytes) * base
        keys, n = np.unique(doc[np.repeat(g, times)] * span + np.repeat(a, times) * base + b, return_counts=True)
        if wide.any():  # groups of very many pairs, by distinct ids
            held = [(keys, n)]
            for k in np.flatnonzero(wide).tolist():
                x, i = np.unique(self.a[np.searchsorted(self.group_a, k) : np.searchsorted(self.group_a, k, "right")], return_counts=True)
                y, j = np.unique(self.b[np.searchsorted(self.group_b, k) : np.searchsorted(self.group_b, k, "right")], return_counts=True)
                held.append(((doc[k] * span + x[:, None] * base + y).ravel(), (i[:, None] * j).ravel()))
            keys, n = summed(held)
        return keys // span, keys % span, n


def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of some lists and the sums of their values."""
    keys, n = np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


@lru_cache(2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def runs(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts of a column in runs of about RUN bytes, with the first one's number; null is empty."""
    _, bounds = hashing.texts(column)
    row = 0
    while row < len(column):
        to = max(int(np.searchsorted(bounds, bounds[row] + RUN, "right")) - 1, row + 1)
        yield row, [t or "" for t in column.slice(row, to - row).to_pylist()]
        row = to


def planes(x: np.ndarray, width: int) -> bytes:
    """Numbers of `width` bytes, all first bytes before all second ones: sorted numbers pack better so."""
    return np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def unplaned(raw: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


ALIGNED = StructType([StructField(c, LongType()) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")] + [StructField("groups_sha256", StringType()), StructField("pairs", BinaryType()), StructField("times", BinaryType())])


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and packed pairs and times, for each row of docs (doc_id, text).

    The table is written once, with `row`, a number of its own for each row. Texts that are null, empty or not spelled by
    either tokenizer's tokens have zeros and ''. Long texts are read whole, each in a run of its own; equal rows are rows each; extra
    columns are not read; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = ALIGNED.names[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = aligner(path_a, path_b)
        width = 4 if len(how.a.bytes) * how.base < 1 << 32 else 8
        for batch in batches:
            for row, texts in runs(batch.column(1)):
                g = how.align(texts)
                doc, keys, n = g.pairs()
                cuts = np.searchsorted(doc, np.arange(len(g.at) + 1)).tolist()
                pairs, times = [b""] * len(texts), [b""] * len(texts)
                for k, i, j in zip(g.at.tolist(), cuts[:-1], cuts[1:], strict=True):
                    pairs[k], times[k] = planes(keys[i:j], width), planes(n[i:j], 4 if n[i:j].max(initial=0) < 1 << 32 else 8)
                numbers = [g.spread(x) for x in (g.count_a, g.count_b, g.per_doc(np.ones(len(g.size_a), np.int64)), g.per_doc(g.size_a * g.size_b))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), *map(pa.array, numbers), pa.array(g.prints(), pa.string()), pa.array(pairs, pa.binary()), pa.array(times, pa.binary())], names=names)

    path = place(spark, "aligned")
    found = rows.mapInArrow(run, StructType(ALIGNED.fields[1:]))
    found.select(F.monotonically_increasing_id().alias("row"), *names).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(ALIGNED).parquet(path)


def group_rows(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, start and end (bytes of a space and the text), a_ids and b_ids of every group, as rows."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = ["doc_id", "start", "end", "a_ids", "b_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in runs(batch.column(1)):
                g = aligner(path_a, path_b).align(texts)
                per = np.diff(g.last, prepend=0)
                first = np.concatenate(([0], g.byte_ends))[np.concatenate(([0], g.last))[:-1]] if len(g.at) else np.zeros(0, np.int64)
                first = np.repeat(first, per)
                starts = np.concatenate(([0], g.byte_ends))[:-1] - first
                owner = batch.column(0).take(pa.array(row + np.repeat(g.at, per)))
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(x)) for n, x in ((g.size_a, g.a), (g.size_b, g.b))]
                yield pa.RecordBatch.from_arrays([owner, pa.array(starts), pa.array(g.byte_ends - first), *lists], names=names)

    return rows.mapInArrow(run, "doc_id long, start long, end long, a_ids array<long>, b_ids array<long>")


def link_counts(aligned: DataFrame, width: int) -> DataFrame:
    """pair and n, the number of rows that hold it linked. Each task hands on sums of its distinct pairs."""
    names = ["pair", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            keys = [unplaned(p, width) for p in batch.column(0).to_pylist() if p]
            if keys:
                held.append(np.unique(np.concatenate(keys), return_counts=True))
                size += len(held[-1][0])
            if size > GATHERED:
                held = [summed(held)]
                size = len(held[0][0])
            if size > GATHERED:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], names=names)
                size = 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed(held)], names=names)

    return aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def vocabulary_sizes(spark: SparkSession, path_a: str, path_b: str) -> tuple[int, int]:
    how = aligner(path_a, path_b)
    return len(how.a.bytes), how.base


def links(docs: DataFrame, path_a: str, path_b: str, held: int = HELD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of docs.

    A link is a pair of A and B tokens of one group; the count of an id pair is the number of rows that hold it. n_best: links whose
    count is the highest of their A id, ties included; count_sum: the sum over links. The counts of the `held` most frequent pairs are
    broadcast, as are the highest counts of A ids, at most one for each id of the vocabulary. If there are more pairs than that in
    two documents or more, the links of the rest are joined with their counts. Odd rows: see align().
    """
    spark = docs.sparkSession
    size_a, base = vocabulary_sizes(spark, path_a, path_b)
    width = 4 if size_a * base < 1 << 32 else 8
    aligned = align(docs, path_a, path_b)
    path = place(spark, "link-counts")
    link_counts(aligned, width).write.parquet(path)
    counts = spark.read.schema("pair long, n long").parquet(path)
    top = np.zeros(size_a, np.int64)
    for a, n in counts.groupBy(F.floor(F.col("pair") / base).cast("long").alias("a")).agg(F.max("n")).collect():
        top[a] = n
    # the least power of two from which on at most `held` pairs are counted
    sizes = dict(counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect())
    power, known = max(sizes, default=0) + 1, 0
    while power > 1 and known + sizes.get(power - 1, 0) <= held:
        power -= 1
        known += sizes.get(power, 0)
    got = counts.filter(F.col("n") >= 1 << power).toPandas().sort_values("pair")
    told = spark.sparkContext.broadcast((got["pair"].to_numpy(np.int64), got["n"].to_numpy(np.int64), top))
    rest_is_one = power == 1  # pairs that are not held are in one document each
    plain = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def looked_up(p: bytes, t: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        keys, counted, _ = told.value
        own = unplaned(p, width)
        times = unplaned(t, len(t) // max(len(own), 1)) if p else own
        at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
        hit = keys[at] == own if len(keys) else np.zeros(len(own), bool)
        n = np.where(hit, counted[at], 1) if len(keys) else np.ones(len(own), np.int64)
        return own, times, n, hit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_of = told.value[2]
        for batch in batches:
            best, total = [], []
            for p, t in zip(batch.column(7).to_pylist(), batch.column(8).to_pylist(), strict=True):
                own, times, n, hit = looked_up(p, t)
                if not rest_is_one:
                    own, times, n = own[hit], times[hit], n[hit]
                best.append(int(times[n == best_of[own // base]].sum()))
                total.append(int((times * n).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(best, pa.int64()), pa.array(total, pa.int64())], names=[*plain, "n_best", "count_sum"])

    out = aligned.select(*plain, "pairs", "times").mapInArrow(run, StructType([ALIGNED[c] for c in plain] + [StructField("n_best", LongType()), StructField("count_sum", LongType())]))
    if not rest_is_one:

        def unknown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, p, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own, times, _, hit = looked_up(p, t)
                    own, times = own[~hit], times[~hit]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), row)), pa.array(own), pa.array(times), pa.array(told.value[2][own // base])], names=["__row", "__pair", "__times", "__top"])

        left = aligned.select("row", "pairs", "times").mapInArrow(unknown, "__row long, __pair long, __times long, __top long")
        left = left.join(counts.filter(F.col("n") < 1 << power), F.col("__pair") == F.col("pair"))
        left = left.groupBy("__row").agg(F.sum(F.when(F.col("n") == F.col("__top"), F.col("__times")).otherwise(0)).alias("__best"), F.sum(F.col("__times") * F.col("n")).alias("__sum"))
        out = out.join(left, F.col("row") == F.col("__row"), "left")
        out = out.withColumn("n_best", F.col("n_best") + F.coalesce("__best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("__sum", F.lit(0)))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
