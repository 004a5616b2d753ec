"""Token ids in compressed binary files: an adaptive context-mixing range coder over blocks of ids.

Model. Order 0 is a distribution over all ids, from their counts so far, renewed at fixed steps. Orders 1 and 2
predict the id that followed the last id, and the last two, with a confidence. What is coded is one mixture of the
three as a distribution over ids: an id's share is weight 0 times its order-0 frequency, plus weight 1 if order 1
predicts it, plus weight 2 if order 2 does. The weights belong to the two confidences and to whether both agree,
and are learned on the way by the part that each order had in the ids coded so far. The mixture's sums over all lower
ids need two comparisons, so coding an id takes one step of the range coder and no search. What is coded is exact
in integers; weights are learned in plain double-precision steps, so that every machine decodes alike.

Blocks. Each block of up to BLOCK ids starts from an empty model and has a checksum; it can be decoded alone. Its ids
are cut into up to LANES equal lanes with a range coder each; all lanes share the model, which learns from one step of
all lanes at a time, as a few numpy operations.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm import hashing
from spanloom.llm.shared import place, ship, stored

#: Lanes of a block, ids of a lane, ids of a block, and id bound.
LANES, STEPS, IDS = 4096, 512, 1 << 16
BLOCK = LANES * STEPS
#: UTF-8 bytes of a file's texts; where cores would idle, less, to a sixteenth.
PART = 64_000_000
#: Words whose ids a task remembers (of pieces half as many), and log2 of the slots of their table.
MEMORY, SLOTS = 2_000_000, 22
MAGIC, FOOT, HEAD = b"SLTF0002", struct.Struct("<QQ8s"), struct.Struct("<II")
#: Bits of the order-0 total and of the mixture's; bits of the order-2 table.
ZERO, ALL, TWO = 20, 26, 18
#: Steps of a lane after which order 0 is renewed, and those from which weights are learned.
RENEW = {1, 2, 4, 8, 16, 32, 64, *range(128, STEPS, 128)}
LEARN = {*range(32), *range(32, STEPS, 16)}

U32, U64 = np.uint32, np.uint64
_sure = np.arange(8)
#: What a prediction's confidence gains by a hit (from place 8 on) or loses by a miss; below place 2 it gives way.
DELTA = np.concatenate([(_sure >> 1) - _sure, (_sure < 7).astype(int)]).astype(np.int64).astype(U32)


class Model:
    """What all lanes of a block know: counts, predictions (id * 8 + confidence) and weights."""

    def __init__(self, ids: int):
        self.one, self.two = np.zeros(IDS, U32), np.zeros(1 << TWO, U32)
        self.counts = np.zeros(ids, np.int64)
        sure2, sure1 = np.divmod(np.arange(128) >> 1, 8)
        self.seen = np.full(128, 8.0)
        self.part1, self.part2 = 0.8 * np.minimum(sure1, 4), 0.8 * np.minimum(sure2, 4)
        self.held: list[np.ndarray] = []
        self.renew()
        self.weigh()

    def renew(self) -> None:
        """Order 0 from the counts; every id keeps a share of one."""
        n, total = len(self.counts), int(self.counts.sum())
        spare = (1 << ZERO) - n
        size = 1 + self.counts * spare // total if total else np.full(n, (1 << ZERO) // n)
        self.size = size.astype(U32)
        self.start = (np.cumsum(size) - size).astype(U32)
        self.owner = np.repeat(np.arange(n, dtype=np.uint16), size)

    def weigh(self) -> None:
        """Shares of the orders by confidences, as whole parts of 2**ALL; that of order 0 is a multiple of 2**ZERO."""
        w1, w2 = self.part1 / self.seen, self.part2 / self.seen
        most = 1 << (ALL - ZERO)
        zero = np.where(w1 + w2 > 0, np.clip(np.rint((1 - w1 - w2) * most), 1, most), most)
        left = (most - zero) * (1 << ZERO)
        first = np.floor(left * np.divide(w1, w1 + w2, out=np.zeros(128), where=w1 + w2 > 0))
        self.m0, self.m1, self.m2 = zero.astype(U32), first.astype(U32), (left - first).astype(U32)

    def predict(self, p1: np.ndarray, p2: np.ndarray) -> None:
        """Predictions of orders 1 and 2 after the last id and the one before it, and the shares of all orders."""
        self.k1 = p1.astype(np.int64)
        self.k2 = ((p1 * U32(0x9E3779B1) + p2 * U32(0x85EBCA6B)) >> U32(32 - TWO)).astype(np.int64)
        self.e1, self.e2 = self.one.take(self.k1, mode="clip"), self.two.take(self.k2, mode="clip")
        self.g1, self.g2 = self.e1 >> U32(3), self.e2 >> U32(3)
        self.c1, self.c2 = self.e1 & U32(7), self.e2 & U32(7)
        self.q = ((((self.c2 << U32(3)) | self.c1) << U32(1)) | (self.g1 == self.g2)).astype(np.int64)
        self.w0, self.w1, self.w2 = (m.take(self.q, mode="clip") for m in (self.m0, self.m1, self.m2))

    def interval(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of ids in the mixture."""
        at = x.astype(np.int64)
        self.hit1, self.hit2 = self.g1 == x, self.g2 == x
        self.own1, self.own2, self.own0 = self.w1 * self.hit1, self.w2 * self.hit2, self.w0 * self.size.take(at)
        start = self.w0 * self.start.take(at) + self.w1 * (self.g1 < x) + self.w2 * (self.g2 < x)
        return start, self.own0 + self.own1 + self.own2

    def find(self, v: np.ndarray) -> np.ndarray:
        """The ids whose intervals hold given places: an id's predicted shares come first, then its order-0 one."""
        swap = self.g1 > self.g2
        a, b = np.minimum(self.g1, self.g2), np.maximum(self.g1, self.g2)
        wa, wb = self.w1.copy(), self.w2.copy()
        np.copyto(wa, self.w2, where=swap)
        np.copyto(wb, self.w1, where=swap)
        at_a = self.w0 * self.start.take(a, mode="clip")
        at_b = self.w0 * self.start.take(b, mode="clip") + wa
        past_a, past_b = v >= at_a + wa, v >= at_b + wb
        x = self.owner.take(((v - wa * past_a - wb * past_b) // self.w0).astype(np.int64), mode="clip").astype(U32)
        np.copyto(x, b, where=(v >= at_b) & ~past_b)
        np.copyto(x, a, where=(v >= at_a) & ~past_a)
        return x

    def learn(self, x: np.ndarray, t: int) -> None:
        """After step t with ids x."""
        fresh = (x << U32(3)) | U32(1)
        for table, key, e, c, hit in ((self.one, self.k1, self.e1, self.c1, self.hit1), (self.two, self.k2, self.e2, self.c2, self.hit2)):
            k = c + (hit.view(np.uint8) << np.uint8(3))
            new = e + DELTA.take(k)
            np.copyto(new, fresh, where=k < U32(2))
            table[key] = new
        if t in LEARN:
            whole = 1.0 / (self.own0 + self.own1 + self.own2)
            self.part1 += np.bincount(self.q, self.own1 * whole, 128)
            self.part2 += np.bincount(self.q, self.own2 * whole, 128)
            self.seen += np.bincount(self.q, minlength=128)
            self.weigh()
        self.held.append(x)
        if t + 1 in RENEW:
            self.counts += np.bincount(np.concatenate(self.held), minlength=len(self.counts))
            self.held.clear()
            self.renew()


def _lanes(n: int) -> tuple[int, int]:
    """Lanes and steps of a block of n ids."""
    lanes = -(-n // STEPS)
    return lanes, -(-n // lanes)


def encode(ids: np.ndarray) -> bytes:
    """The code of a block of 1 to BLOCK ids."""
    lanes, steps = _lanes(len(ids))
    x = np.zeros(lanes * steps, U32)
    x[: len(ids)] = ids
    rows = np.ascontiguousarray(x.reshape(lanes, steps).T)
    model = Model(int(x.max()) + 1)
    low, span = np.zeros(lanes, U64), np.full(lanes, (1 << 48) - 1, U64)
    width = steps * ALL // 16 + 8
    out, at = np.zeros(width * lanes, U32), np.arange(lanes)
    p1 = p2 = np.zeros(lanes, U32)
    for t in range(steps):
        now = rows[t]
        model.predict(p1, p2)
        start, size = model.interval(now)
        unit = span >> U64(ALL)
        low += start * unit
        span = size * unit
        over = np.flatnonzero(low >> U64(48))
        if len(over):  # a carry goes into the word before, which may pass 16 bits until the end
            out[at[over] - lanes] += U32(1)
            low[over] &= U64((1 << 48) - 1)
        short = np.flatnonzero(span < U64(1 << 32))
        while len(short):
            some = low[short]
            out[at[short]] = some >> U64(32)
            at[short] += lanes
            low[short] = (some & U64(0xFFFFFFFF)) << U64(16)
            span[short] <<= U64(16)
            short = short[span[short] < U64(1 << 32)]
        model.learn(now, t)
        p2, p1 = p1, now
    # one word tells a place in what is left, as a lane's words are followed by zeros
    end = low + U64((1 << 32) - 1)
    over = np.flatnonzero(end >> U64(48))
    out[at[over] - lanes] += U32(1)
    out[at] = (end >> U64(32)) & U64(0xFFFF)
    used = at // lanes + 1
    grid = out.reshape(width, lanes)
    for k in range(width - 1, 0, -1):
        grid[k - 1] += grid[k] >> U32(16)
    words = grid.T.astype("<u2")[np.arange(width)[None, :] < used[:, None]]
    return HEAD.pack(len(ids), len(model.counts)) + used.astype("<u2").tobytes() + words.tobytes()


def decode(code: bytes) -> np.ndarray:
    """The ids of a block."""
    n, bound = HEAD.unpack_from(code)
    if not 0 < n <= BLOCK or not 0 < bound <= IDS:
        raise ValueError("no block of ids")
    lanes, steps = _lanes(n)
    used = np.frombuffer(code, "<u2", lanes, HEAD.size).astype(np.int64)
    words = np.frombuffer(code, "<u2", offset=HEAD.size + 2 * lanes)
    if len(words) != used.sum():
        raise ValueError("a block is cut short")
    width = max(int(used.max()), 3) + 3
    grid = np.zeros((lanes, width), U64)
    grid[np.arange(width)[None, :] < used[:, None]] = words
    flat, at = grid.ravel(), np.arange(lanes) * width + 3
    value = (grid[:, 0] << U64(32)) | (grid[:, 1] << U64(16)) | grid[:, 2]
    span = np.full(lanes, (1 << 48) - 1, U64)
    model, rows = Model(bound), np.zeros((steps, lanes), U32)
    p1 = p2 = np.zeros(lanes, U32)
    for t in range(steps):
        model.predict(p1, p2)
        unit = span >> U64(ALL)
        now = model.find((value // unit).astype(U32))
        start, size = model.interval(now)
        value -= start * unit
        span = size * unit
        short = np.flatnonzero(span < U64(1 << 32))
        while len(short):
            value[short] = (value[short] << U64(16)) | flat.take(at[short], mode="clip")
            at[short] += 1
            span[short] <<= U64(16)
            short = short[span[short] < U64(1 << 32)]
        model.learn(now, t)
        rows[t] = now
        p2, p1 = p1, now
    return rows.T.reshape(-1)[:n].astype(np.uint16)


class Writer:
    """A file of documents' ids: blocks, then the documents and the blocks' lengths, then a footer."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.ids"
        system, path = fs.FileSystem.from_uri(self.uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = system.open_output_stream(path, compression=None)
        self.out.write(MAGIC)
        self.held, self.size, self.tokens = [], 0, 0
        self.blocks: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, bool, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.held.append(ids)
        self.size += len(ids)
        self.tokens += len(ids)
        if self.size >= BLOCK:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.concatenate([np.zeros(0, np.uint16), *self.held])
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for a in range(0, whole, BLOCK):
            own = ids[a : min(a + BLOCK, whole)]
            code = encode(own)
            self.out.write(code)
            self.blocks.append((len(code), len(own), zlib.crc32(own.astype("<u2").tobytes())))
        self.held, self.size = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self.flush(True)
        docs, blocks = np.array(self.docs, "<i8").reshape(-1, 3), np.array(self.blocks, "<i8").reshape(-1, 3)
        self.out.write(docs.tobytes() + blocks.tobytes() + FOOT.pack(len(docs), len(blocks), MAGIC))
        self.out.close()


def read_file(uri: str) -> Iterator[tuple[list[tuple[int | None, int]], np.ndarray]]:
    """Runs of whole documents, (doc_id, number of ids), with their ids."""
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as f:
        size = f.size()
        n, m, magic = FOOT.unpack(f.read_at(FOOT.size, size - FOOT.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no file of ids")
        table = np.frombuffer(f.read_at(24 * (n + m), size - FOOT.size - 24 * (n + m)), "<i8").reshape(-1, 3)
        docs, blocks = table[:n], table[n:]
        at, b, d, held = len(MAGIC), 0, 0, np.zeros(0, np.uint16)
        while b < m or d < n:
            got = []
            if b < m:
                length, size, check = blocks[b].tolist()
                try:
                    ids = decode(f.read_at(length, at))
                except (IndexError, struct.error) as e:
                    raise ValueError(f"{uri}: block {b} is damaged") from e
                if len(ids) != size or zlib.crc32(ids.astype("<u2").tobytes()) != check:
                    raise ValueError(f"{uri}: block {b} is damaged")
                got = [ids]
                at, b = at + length, b + 1
            held = np.concatenate([held, *got])
            ends = np.cumsum(docs[d:, 2])
            k = int(np.searchsorted(ends, len(held), "right"))
            if k:
                yield [(None if x[1] else int(x[0]), int(x[2])) for x in docs[d : d + k]], held[: ends[k - 1]]
                held, d = held[ends[k - 1] :], d + k
            elif not got:
                raise ValueError(f"{uri} is cut short")


#: ASCII letters and then signs: two pieces to the tokenizer, of which the first is read in lower case. Apostrophes may
#: begin a piece of their own with letters, so words with them are left whole.
PLAIN = re.compile(rb"([A-Za-z]+)([!-&(-/:-@\[-`{-~]*)")


class Words:
    """Ids of words between ASCII spaces, which the tokenizer never joins; each distinct word is encoded once.

    Words are known by their hashes, in a table of open addresses that a whole batch is looked up in at once. New words of
    letters and signs are encoded as these two pieces, which many words share. What is new goes to the
    tokenizer in lines of words with a mark between them, a word of one id; a line in which that id occurs otherwise is
    encoded word by word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > IDS:
            raise ValueError("ids need to be below 2**16")
        ids = {x: self.tokenizer.encode(x, add_special_tokens=False).ids for x in "§¶¤~#"}
        self.mark, self.mark_id = next(((x, i[0]) for x, i in ids.items() if len(i) == 1), (None, -1))
        self.forget()

    def forget(self) -> None:
        self.pieces: dict[bytes, bytes] = {b"": b""}
        self.keys, self.place = np.zeros(1 << SLOTS, U64), np.zeros(1 << SLOTS, np.int32)
        self.first, self.size, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0
        self.pool, self.used = np.zeros(4096, np.uint16), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The numbers of words by their hashes, -1 for new ones."""
        out, left = np.full(len(h), -1, np.int64), np.arange(len(h))
        slot = (h >> U64(64 - SLOTS)).astype(np.int64)
        while len(left):
            here = self.keys.take(slot)
            hit = here == h.take(left)
            out[left[hit]] = self.place.take(slot[hit])
            on = ~hit & (here != 0)
            left, slot = left[on], (slot[on] + 1) & ((1 << SLOTS) - 1)
        return out

    def learn(self, h: np.ndarray, ids: list[bytes]) -> None:
        """Enter new words, distinct hashes, with their ids."""
        size = np.array([len(x) for x in ids], np.int64) // 2
        count, used = self.count + len(h), self.used + int(size.sum())
        if count > len(self.first):
            self.first, self.size = (np.concatenate([x, np.zeros(count, np.int64)]) for x in (self.first, self.size))
        if used > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(used, np.uint16)])
        self.pool[self.used : used] = np.frombuffer(b"".join(ids), "<u2")
        self.size[self.count : count] = size
        self.first[self.count : count] = self.used + np.cumsum(size) - size
        left, slot = np.arange(len(h)), (h >> U64(64 - SLOTS)).astype(np.int64)
        while len(left):
            free = self.keys.take(slot) == 0
            self.keys[slot[free]] = h[left[free]]  # of several words for one slot the last is in
            done = free & (self.keys.take(slot) == h[left])
            self.place[slot[done]] = self.count + left[done]
            left, slot = left[~done], (slot[~done] + 1) & ((1 << SLOTS) - 1)
        self.count, self.used = count, used

    def look_up(self, words: list[bytes]) -> None:
        """Encode pieces that are not known; runs of lower-case ASCII letters are one piece to the tokenizer's model."""
        letters = [w for w in words if w.isalpha() and w.islower() and w.isascii()]
        model = self.tokenizer.model
        for w in letters:
            ids = [t.id for t in model.tokenize(w.decode())]
            self.pieces[w] = struct.pack(f"<{len(ids)}H", *ids)
        words = [w for w in words if w not in self.pieces]
        for a in range(0, len(words), 16384):
            lines = [words[k : k + 64] for k in range(a, min(a + 16384, len(words)), 64)]
            if self.mark is None:
                alone = [w for line in lines for w in line]
            else:
                alone, mark = [], f" {self.mark} ".encode()
                got = self.tokenizer.encode_batch_fast([mark.join(line).decode() for line in lines], add_special_tokens=False)
                for line, e in zip(lines, got, strict=True):
                    ids = np.array(e.ids, "<u2")
                    cut = np.flatnonzero(ids == self.mark_id)
                    if len(cut) != len(line) - 1:
                        alone += line
                        continue
                    raw, ends = ids.tobytes(), [*cut.tolist(), len(ids)]
                    self.pieces.update((w, raw[2 * i : 2 * j]) for w, i, j in zip(line, [0, *(k + 1 for k in ends[:-1])], ends, strict=True))
            if alone:
                got = self.tokenizer.encode_batch_fast([w.decode() for w in alone], add_special_tokens=False)
                self.pieces.update((w, np.array(e.ids, "<u2").tobytes()) for w, e in zip(alone, got, strict=True))

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column, in order."""
        held: list[np.ndarray] = []
        at = 0
        for row, data, h, starts, ends, bounds in hashing.spans(column, hashing.WORDS, hashing.SAME):
            while at < row:  # what was held was a whole row, or a long row's last part
                yield np.concatenate(held) if len(held) != 1 else held[0]
                held, at = [], at + 1
            h = np.maximum(h, U64(1))
            number = self.find(h)
            new = np.flatnonzero(number < 0)
            if len(new):
                own, first = np.unique(h[new], return_index=True)
                if len(self.pieces) > MEMORY // 2:
                    self.pieces = {b"": b""}
                if self.count + len(own) > MEMORY:
                    self.forget()
                    own, first = np.unique(h, return_index=True)
                    new = np.arange(len(h))
                raw, places = data.tobytes(), new[first]
                self.learn(own, self.spell([raw[i:j] for i, j in zip(starts[places].tolist(), ends[places].tolist(), strict=True)]))
                number[new] = self.find(h[new])
            size = self.size.take(number)
            total = np.concatenate(([0], np.cumsum(size)))
            ids = self.pool.take(np.repeat(self.first.take(number) - total[:-1], size) + np.arange(total[-1]))
            cut = total[bounds].tolist()
            held.append(ids[cut[0] : cut[1]])
            for i, j in zip(cut[1:-1], cut[2:], strict=True):
                yield np.concatenate(held) if len(held) != 1 else held[0]
                held, at = [ids[i:j]], at + 1
        if held:
            yield np.concatenate(held) if len(held) != 1 else held[0]

    def spell(self, words: list[bytes]) -> list[bytes]:
        """The ids of new words."""
        parts = [(m[1].lower(), m[2]) if (m := PLAIN.fullmatch(w)) else (w, b"") for w in words]
        pieces = self.pieces
        self.look_up(list({x for own in parts for x in own if x not in pieces}))
        return [pieces[a] + pieces[b] for a, b in parts]


_words: dict[str, Words] = {}


def write(docs: DataFrame, path: str, folder: str, end: int = 2) -> DataFrame:
    """Write the ids of all documents in ascending order of doc_id (null first); returns part, file, tokens.

    The table of files is written to the shared folder. A null text is empty; each document ends with `end`.
    Repeated doc_ids are in the order of their texts' hashes, equal rows follow each other. Long texts are encoded whole, in
    pieces between words. Extra columns of docs are not read; an empty table gives no file.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(-(-size // PART), min(spark.sparkContext.defaultParallelism, -(-size // (PART // 16))), 1)
    ordered = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    schema = pa.schema([("part", pa.int32()), ("file", pa.string()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = _words.setdefault(path, Words(path)) if path not in _words else _words[path]
        writer = None
        tail = np.array([end], np.uint16)
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1)), strict=True):
                writer = writer or Writer(folder)
                writer.add(doc_id, np.concatenate([ids, tail]))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([writer.uri]), pa.array([writer.tokens], pa.int64())], schema=schema)

    return stored(ordered.mapInArrow(run, "part int, file string, tokens long"), "ids-files")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from the files.

    A row for each written row, null and repeated doc_ids included; an empty text has its end id alone. A damaged or cut
    block fails the query. Without files there are no rows.
    """
    spark = files.sparkSession
    ship(spark)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long")).select("file", "start")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for docs, ids in read_file(uri):
                    wide, at, rows = ids.astype("<u4"), 0, []
                    for doc_id, n in docs:
                        rows.append((doc_id, start + at, n, zlib.crc32(wide[at : at + n])))
                        at += n
                    start += at
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.int64()) for k in range(4)], schema=schema)

    return placed.repartition(max(files.count(), 1)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def ids_folder(spark) -> str:
    return place(spark, "ids")
