"""JSON array files read by many tasks at once, and reads that keep what they reject.

Spark's text reader cuts a file into splits, here at closing braces. Whether a piece lies in a string, how deep it is nested
and which record it belongs to depend on all pieces before it, through sums alone: of quotes, of brackets and of ends of
records. A first pass sums up each split, for either state that it may begin in, and the few sums of a file are stitched; a
second one puts each split's records together in place. Only a record that lies in several splits is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanloom.operators import bio
from spanloom.sources import files

#: What a byte is: 1 and -1 for brackets, 2 for quotes, 3 for backslashes. Pieces hold no closing brace.
_KINDS = np.zeros(256, np.int8)
_KINDS[list(b'[{]"\\')] = 1, 1, -1, 2, 3


def _written(df: DataFrame, tag: str) -> DataFrame:
    path = files.scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sums(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each piece the quotes, and by how much its brackets nest deeper if it begins outside and inside of a string."""
    pieces = pieces.cast(pa.large_binary())
    bounds = np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1, 8 * pieces.offset)
    data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    kinds = _KINDS[data]
    at = np.flatnonzero(kinds)
    kinds = kinds[at]
    slashes = at[kinds == 3]
    if len(slashes):  # what follows an odd number of them in its piece is no mark
        of = np.searchsorted(bounds, slashes, "right")
        begins = np.flatnonzero(np.append(True, (np.diff(slashes) != 1) | (np.diff(of) != 0)))
        sizes = np.diff(np.append(begins, len(slashes)))
        follows = slashes[begins] + sizes
        meant = (sizes % 2 == 0) | (follows == bounds[of[begins]])
        stays = (kinds != 3) & ~np.isin(at, follows[~meant])
        at, kinds = at[stays], kinds[stays]
    spots = np.searchsorted(at, bounds)
    quotes = np.append(0, np.cumsum(kinds == 2))
    odd = (quotes[:-1] - np.repeat(quotes[spots[:-1]], np.diff(spots))) % 2 == 1
    deeper = np.where(kinds == 2, 0, kinds).astype(np.int64)
    out, ins = (np.diff(np.append(0, np.cumsum(deeper * x))[spots]) for x in (~odd, odd))
    return np.diff(quotes[spots]), out, ins


def _running(sums: tuple[np.ndarray, ...], began: int, odd: int, deep: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the text is in a string after each piece, and how deep it is nested, if the split began so (1: in a string).

    odd: quotes of the split before these pieces. A closing brace follows every piece but the last of its file, and counts outside of strings.
    """
    quotes, out, ins = sums
    after = (began + odd + np.cumsum(quotes)) % 2
    before = (after - quotes) % 2
    return after, deep + np.cumsum(np.where(before == 0, out, ins) - (after == 0))


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of each split in a batch, which lie together."""
    file, split = batch.column(0), batch.column(1)
    n = batch.num_rows
    new = pc.or_(pc.not_equal(file.slice(1), file.slice(0, n - 1)), pc.not_equal(split.slice(1), split.slice(0, n - 1))) if n else []
    starts = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), n] if n else []
    for a, b in zip(starts, starts[1:]):
        yield batch.slice(a, b - a)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split the parity of its quotes, and for either state that it may begin in (0, 1) its depth and, for each depth, how
    often a brace leads to it, first and last where."""
    found: dict = {}
    for batch in batches:
        for run in _runs(batch):
            own = found.setdefault((run.column(0)[0].as_py(), run.column(1)[0].as_py()), [0, [0, 0], {}])
            sums, odd, seq = _sums(run.column(2)), own[0], run.column(3).to_numpy()
            for began in (0, 1):
                after, depth = _running(sums, began, odd, own[1][began])
                own[1][began] = int(depth[-1])
                own[0] = (int(after[-1]) + began) % 2
                ends, at = depth[after == 0], seq[after == 0]
                kinds, firsts, counts = np.unique(ends, return_index=True, return_counts=True)
                lasts = len(ends) - 1 - np.unique(ends[::-1], return_index=True)[1]
                for k, n, x, y in zip(kinds.tolist(), counts.tolist(), at[firsts].tolist(), at[lasts].tolist(), strict=True):
                    old = own[2].get((began, k), (0, x))
                    own[2][began, k] = (old[0] + n, old[1], y)
    rows = [{"file": f, "split": s, "q": q, "d0": d[0], "d1": d[1], "ends": [{"began": b, "depth": k, "n": n, "head": x, "tail": y} for (b, k), (n, x, y) in c.items()]} for (f, s), (q, d, c) in found.items()]
    kind = pa.struct([("began", pa.int32()), *[(c, pa.int64()) for c in ("depth", "n", "head", "tail")]])
    yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("split", pa.int64()), ("q", pa.int32()), ("d0", pa.int64()), ("d1", pa.int64()), ("ends", pa.list_(kind))]))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, record, split, value and whether the record may lie in other splits too, of pieces with the state of their split.

    skip: records that are left out after the first, so that only those at a split's edges are there.
    """
    names = ["file", "record", "split", "part", "value"]
    now, odd, deep, parts, ended, number, out = None, 0, 0, [], False, 0, []

    def say(closed: bool, part: bool) -> None:
        out.append((now[0], number, now[1], part or (number == now[4] and not now[5]), b"}".join(parts) + (b"}" if closed else b"")))

    def flush() -> pa.RecordBatch:
        cols = [list(x) for x in zip(*out, strict=True)] or [[]] * 5
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=names)

    for batch in batches:
        for run in _runs(batch):
            state = tuple(run.column(k)[0].as_py() for k in (0, 1, 3, 4, 5, 6, 7, 8))  # file, split, began, deep, before, first, final, skip
            if state != now:
                if now:  # the last piece of a file has no brace behind it
                    say(not now[6], not ended and not now[6])
                now, odd, deep, parts, ended, number = state, 0, state[3], [], False, state[4]
            after, depth = _running(_sums(run.column(2)), now[2], odd, deep)
            odd, deep = (int(after[-1]) + now[2]) % 2, int(depth[-1])
            for value, end in zip(run.column(2).to_pylist(), ((depth == 1) & (after == 0)).tolist(), strict=True):
                if ended:
                    say(True, False)
                    parts, number = [], number + 1 + now[7]
                parts.append(value)
                ended = end
        yield flush()
    if now:
        say(not now[6], not ended and not now[6])
    yield flush()


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, record (from 0 on in each file) and value, the text of each record of files that are JSON arrays of objects.

    Splits follow spark.sql.files.maxPartitionBytes; a record may lie in several. The files are read to sum up their splits, and where
    the result is used again for the records and, of files of several splits, for those at the splits' edges; it fails then if
    Spark splits the files in another way. Text that is no record, such as a number between two objects, comes with the record after it, or as a last one.
    """
    meta = F.col("_metadata")
    read = spark.read.option("lineSep", "}").text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("split"), F.col("value").cast("binary").alias("value"), F.monotonically_increasing_id().alias("seq"))
    sums = read.mapInArrow(_summed, "file string, split long, q int, d0 long, d1 long, ends array<struct<began: int, depth: long, n: long, head: long, tail: long>>")
    order = Window.partitionBy("file").orderBy("split")
    back = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = _written(sums, "array-sums").withColumn("began", (F.coalesce(F.sum("q").over(back), F.lit(0)) % 2).cast("int"))
    sums = sums.withColumn("deep", F.coalesce(F.sum(F.when(F.col("began") == 0, F.col("d0")).otherwise(F.col("d1"))).over(back), F.lit(0)))
    own = F.get(F.filter("ends", lambda e: (e["began"] == F.col("began")) & (e["depth"] == 1 - F.col("deep"))), F.lit(0))
    sums = sums.withColumn("own", own).withColumn("n", F.coalesce(F.col("own.n"), F.lit(0)))
    near, prior = F.lag("split").over(order), F.coalesce(F.sum("n").over(back), F.lit(0))
    states = sums.select(F.col("file").alias("f"), F.col("split").alias("s"), "began", "deep", prior.alias("before"), near.isNull().alias("first"), F.lead("split").over(order).isNull().alias("final"), "n", "own.head", "own.tail")
    states = _written(states, "array-states")  # a row a split
    told = F.when(F.col("began").isNotNull(), F.col("began")).otherwise(F.raise_error(F.lit("files or splits have changed")).cast("int"))
    placed = read.join(F.broadcast(states), (F.col("file") == F.col("f")) & (F.col("split") == F.col("s")), "left").withColumn("began", told)

    def put(rows: DataFrame, skip) -> DataFrame:
        rows = rows.select("file", "split", "value", "began", "deep", "before", "first", "final", skip.alias("skip"))
        return rows.mapInArrow(_joined, "file string, record long, split long, part boolean, value binary")

    whole = put(placed, F.lit(0).cast("long")).filter("NOT part").select("file", "record", F.col("value").cast("string").alias("value"))
    # between the ends of the first and the last record of a split nothing is needed; in a file's last, the piece after the first tells that a brace was there
    edges = placed.filter("NOT (first AND final)").filter("n = 0 OR seq <= head + int(final) OR (seq > tail AND NOT final)")
    parts = put(edges, F.greatest(F.col("n") - 1, F.lit(0).cast("long"))).filter("part").groupBy("file", "record")
    parts = parts.agg(F.array_sort(F.collect_list(F.struct("split", F.col("value").cast("string").alias("value")))).alias("parts"))
    got = whole.unionByName(parts.select("file", "record", F.array_join(F.transform("parts", lambda x: x["value"]), "").alias("value")))
    return got.withColumn("value", F.regexp_replace("value", r"^\s*[\[,]?\s*", "")).filter(~F.col("value").rlike(r"^\s*\]?\s*$"))


def array_rows(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """The records of JSON array files. strict: one that is no JSON of the schema fails the query; else it is left out."""
    kind = StructType.fromDDL(schema)
    if not files.exists(spark, path):
        return spark.createDataFrame([], kind)
    text = records(spark, path).select("value")
    if strict:
        return text.select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return _parsed(text, kind).filter(F.col("r").isNotNull() & F.col(f"r.{files.BAD}").isNull()).select(*[F.col(f"r.`{c}`") for c in kind.names])


def _parsed(text: DataFrame, kind: StructType) -> DataFrame:
    return text.withColumn("r", F.from_json("value", StructType([*kind.fields]).add(files.BAD, "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": files.BAD}))


def with_rejects(spark: SparkSession, path: str, array: bool = False, schema: str = files.SEGMENTS) -> tuple[DataFrame, DataFrame]:
    """Valid segments, and rejects (file, reason, value), of one read: every record is in one of the two.

    Reasons: no JSON, missing id, and those of bio.validate(). The records are written once, with their reason, to the shared folder,
    and both results read from there, each only its own rows. Blank lines are no records.
    """
    kind = StructType.fromDDL(schema)
    if array:
        text = records(spark, path).select("file", "value")
    else:
        text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").filter(F.trim("value") != "")
    rows = _parsed(text, kind)
    rows = rows.select("file", "value", F.coalesce(F.col("r").isNull() | F.col(f"r.{files.BAD}").isNotNull(), F.lit(True)).alias("bad"), *[F.col(f"r.`{c}`") for c in kind.names])
    judged = bio.validate(rows)
    reason = F.when(F.col("bad"), "no JSON").when(F.col("id").isNull(), "missing id").otherwise(F.col("reason"))
    place = files.scratch(spark, "judged")
    judged.withColumn("reason", reason).withColumn("value", F.when(F.col("reason").isNotNull(), F.col("value"))).withColumn("ok", F.col("reason").isNull()).drop("bad").write.partitionBy("ok").parquet(place)
    full = StructType([judged.schema["file"], judged.schema["value"], *kind.fields, judged.schema["reason"]]).add("ok", "boolean")
    good = spark.read.schema(full).parquet(place).filter("ok").select(*kind.names)
    return good.withColumn("labels", bio.repair(F.col("labels"))), spark.read.schema(full).parquet(place).filter("NOT ok").select("file", "reason", "value")


def write_array(rows: DataFrame, path: str, order: str | None = None, parts: int = 1) -> None:
    """JSON arrays of the rows in order, one file for each of `parts` ranges; a task writes them as they come.

    Without order nothing is shuffled: each partition is an array of its own, its rows as they are.
    """
    spark = rows.sparkSession
    if order:
        rows = rows.repartitionByRange(parts, order).sortWithinPartitions(order)
    names = [order, *[c for c in rows.columns if c != order]] if order else rows.columns
    text = rows.select(F.to_json(F.struct(*names)).alias("value"))

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for batch in batches:
            if batch.num_rows:
                value = batch.column(0)
                marks = pa.array([mark, *[","] * (len(value) - 1)], value.type)
                mark = ","
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(marks, value, pa.scalar("", value.type))], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if mark == "," else "[]"])], names=["value"])

    # an array is one line
    text.mapInArrow(framed, "value string").write.mode("overwrite").option("lineSep", " ").text(path)
    if spark.read.option("lineSep", "}").text(path).isEmpty():  # without rows there is no range
        spark.createDataFrame([("[]",)], "value string").coalesce(1).write.mode("overwrite").text(path)
