"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with some whole WARC records, and a last, skippable
frame with the seek table. The index maps a record to its bundle, its frame and its place in the frame, so one
record is read by one seek and one frame.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.shared import place, ship, stored

#: Uncompressed bytes after which a frame is closed, and compressed bytes after which a bundle is.
FRAME, BUNDLE = 1 << 20, 1 << 28
#: Most digests or page_ids of a list that is broadcast: some 20 MB.
FEW = 200_000
#: Payloads below this size are always stored in full.
REVISIT_BYTES = 1000
#: Fixed values of the seekable format: magic numbers of the skippable frame and of its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Fixed value of the WARC format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = "page_id long, record_id string, bundle string, frame int, at long, length long"


#: WARC-Date of records whose pages have no time of their own.
EPOCH = "1970-01-01T00:00:00Z"


def record_name(page_id: int | None, twin: int = 0) -> str:
    """A record's URI; records of a repeated or null page_id have a number, `twin`."""
    return f"<urn:page:{'' if page_id is None else page_id}{f':{twin}' if twin else ''}>"


def page_of(name: str) -> int | None:
    digits = name.removeprefix("<urn:page:").removesuffix(">").partition(":")[0]
    return int(digits) if digits else None


def written(head: dict[str, str], block: bytes) -> bytes:
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in head.items()), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def bundle_info(name: str) -> bytes:
    """The record that a bundle begins with."""
    head = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:bundle:{name}>", "WARC-Date": EPOCH, "WARC-Filename": name, "Content-Type": "application/warc-fields"}
    return written(head, b"software: spanloom\r\nformat: WARC File Format 1.1\r\n")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, kind: str, refers_to: int | None, twin: int = 0, date: str = EPOCH) -> bytes:
    """One WARC record; a revisit has no payload but the size and digest of it."""
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_name(page_id, twin),
        "WARC-Date": date,
        "WARC-Target-URI": " ".join((url or "").split()),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Payload-Length": str(size),
        "Content-Type": "application/http;msgtype=response",
    }
    if kind == "revisit":
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_name(refers_to)}
    return written(head, HTTP + (payload if kind == "response" else b""))


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields and payload of the record at a place, and the place after it."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    start, size = end + 4, int(head["Content-Length"])
    block = data[start : start + size]
    if len(block) < size or data[start + size : start + size + 4] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    payload = block if head["WARC-Type"] == "warcinfo" else block[block.index(b"\r\n\r\n") + 4 :]
    return head, payload, start + size + 4


class Bundle:
    """A bundle being written. Its name is new for each attempt of a task; only those in the index count."""

    def __init__(self, folder: str):
        import zstandard

        name = f"{uuid.uuid4().hex}.warc.zst"
        self.uri = f"{folder}/{name}"
        system, path = fs.FileSystem.from_uri(self.uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out, self.pack = system.open_output_stream(path, compression=None), zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int, int]] = []
        self.held: list[bytes] = []
        self.size = self.written = 0
        self.add(bundle_info(name))

    def add(self, data: bytes) -> tuple[int, int]:
        """The frame and the place in it that a record got."""
        if self.size and self.size + len(data) > FRAME:
            self.flush()
        at = (len(self.frames), self.size)
        self.held.append(data)
        self.size += len(data)
        return at

    def flush(self) -> None:
        import xxhash

        if self.held:
            raw = b"".join(self.held)
            packed = self.pack.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.written += len(packed)
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<III", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class Reader:
    """A bundle being read."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError(f"{uri} has no seek table")
        table = self.file.read_at(12 * count, size - 9 - 12 * count)
        self.frames, at = [], 0
        for packed, raw, check in struct.iter_unpack("<III", table):
            self.frames.append((at, packed, raw, check))
            at += packed

    def frame(self, k: int) -> bytes:
        import xxhash
        import zstandard

        at, packed, raw, check = self.frames[k]
        data = zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=raw)
        if len(data) != raw or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return data

    def close(self) -> None:
        self.file.close()


def fetch(bundle: str, frame: int, at: int) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record, by its index entry."""
    reader = Reader(bundle)
    head, payload, _ = parse(reader.frame(frame), at)
    reader.close()
    return head, payload


def decide(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes, record_type and refers_to of each page.

    Of equal payloads of REVISIT_BYTES or more, the one with the largest page_id is the response and the others
    revisit it; all else are responses. Rows that share the largest page_id and the payload are all responses;
    null page_ids come before all others, and equal payloads that have null ids only are all responses. Null html
    is an empty payload. Digests are summed before the shuffle; only those of several rows are joined: by a broadcast of
    up to FEW of them, so that no payload moves, else by a shuffle in which what is no candidate is spread over all tasks.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    many = rows.filter(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("__last"))
    many = stored(many.filter("n > 1 AND __last IS NOT NULL").select(F.col("payload_digest").alias("__key"), "__last"), "warc-twins")
    key = F.when(F.col("payload_bytes") >= REVISIT_BYTES, F.col("payload_digest")).otherwise(F.concat(F.lit("#"), F.xxhash64("page_id", "url").cast("string")))
    rows = rows.withColumn("__own", key)
    few = F.broadcast(many) if many.count() <= FEW else many
    out = rows.join(few, F.col("__own") == F.col("__key"), "left").drop("__own", "__key")
    again = F.col("__last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__last"))
    out = out.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("__last")))
    return out.withColumn("payload", F.when(~again, F.col("payload")).otherwise(F.lit(b""))).drop("__last")


def numbered(decided: DataFrame, pages: DataFrame) -> DataFrame:
    """decided with `twin`: 0 for a page_id's only record, else a number that none of its other records has.

    Only page_ids that repeat are numbered, by a join of their narrow list: a record's number is a hash of its place
    in the read (task and row), so that no task has to see all records of a page_id.
    """
    again = pages.select(F.col("page_id").cast("long").alias("page_id")).filter("page_id IS NOT NULL").groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = stored(again.select(F.col("page_id").alias("__page")), "warc-repeats")
    count, place = again.count(), F.monotonically_increasing_id() + 1
    if not count:
        return decided.withColumn("twin", F.when(F.col("page_id").isNull(), place).otherwise(0).cast("long"))
    out = decided.join(F.broadcast(again) if count <= FEW else again, F.col("page_id") == F.col("__page"), "left")
    return out.withColumn("twin", F.when(F.col("__page").isNotNull() | F.col("page_id").isNull(), place).otherwise(0).cast("long")).drop("__page")


def archive(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record of each page into bundles in a shared folder; returns their index, written there too.

    Index: page_id, record_id, bundle (its URI), frame, at (bytes from the frame's start), length. A repeated
    page_id has several entries, and each of its records a number in its name; what a revisit refers to is the page_id,
    without number. A long page is one frame; null html is an empty payload, null
    url an empty address. Extra columns of pages are not read; an empty table gives no bundle.
    """
    spark = pages.sparkSession
    ship(spark)
    schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("at", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            rows = []
            page, url, payload, digest, size, kind, refers, twin = batch.columns
            for i in range(batch.num_rows):
                if bundle is None:
                    bundle = Bundle(folder)
                page_id = page[i].as_py()
                n = twin[i].as_py()
                data = record(page_id, url[i].as_py(), payload[i].as_py(), digest[i].as_py(), size[i].as_py(), kind[i].as_py(), refers[i].as_py(), n)
                rows.append((page_id, record_name(page_id, n), bundle.uri, *bundle.add(data), len(data)))
                if bundle.written >= BUNDLE:
                    bundle.close()
                    bundle = None
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], f.type) for k, f in enumerate(schema)], schema=schema)
        if bundle is not None:
            bundle.close()

    decided = numbered(decide(pages), pages).select("page_id", "url", "payload", "payload_digest", "payload_bytes", "record_type", "refers_to", "twin")
    return stored(decided.mapInArrow(run, INDEX), "warc-index")


def read_back(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record of the index's bundles.

    Size and digest of a response are taken from its payload, which must agree with its header, or the query fails. A row for
    each record, repeated and null page_ids included; empty payloads have size 0; an empty index gives no rows.
    """
    spark = index.sparkSession
    ship(spark)
    bundles = index.select("bundle").distinct()
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                reader = Reader(uri)
                for k in range(len(reader.frames)):
                    data, at, rows = reader.frame(k), 0, []
                    while at < len(data):
                        head, payload, at = parse(data, at)
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        digest, size, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"]), head["WARC-Type"]
                        if kind == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                            raise ValueError(f"{uri}: {head['WARC-Record-ID']} does not fit its digest")
                        rows.append((page_of(head["WARC-Record-ID"]), size, digest, kind, page_of(head["WARC-Refers-To"]) if kind == "revisit" else None))
                    yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in rows], f.type) for j, f in enumerate(schema)], schema=schema)
                reader.close()

    count = max(bundles.count(), 1)
    dealt = bundles.repartition(min(count, 10_000))
    return dealt.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_folder(spark) -> str:
    return place(spark, "warc")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS last FROM p WHERE strlen(h) >= 1000 GROUP BY h HAVING count(*) > 1)
SELECT p.page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN g.last IS NOT NULL AND p.page_id IS DISTINCT FROM g.last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.last IS NOT NULL AND p.page_id IS DISTINCT FROM g.last THEN g.last END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h
"""
