"""N-gram Jaccard join by parity sketches.

A document is the set of its word shingles. Each shingle flips one bit of a sketch, so two sketches differ in at
most as many bits as the sets differ in shingles. Sets of similarity t differ in at most (1-t)/(1+t) of their
joint size: for each size band that gives a bound d, the sketch is split into more than d blocks, and two similar
sets agree in one block at least. Blocks are very wide, kept as the hash of their odd bits. Documents that agree
in a block are compared by sketches, then by the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm import hashing
from spanloom.llm.components import components
from spanloom.llm.hashing import U, mix
from spanloom.llm.shared import ship, small_batches, stored

#: Block keys that one bucket should hold; the number of buckets follows from the shingles of the corpus.
BUCKET = 1_000_000
#: Members of a cluster, and their shingles, that are compared with as many others in one task.
CHUNK, PART = 2048, 2_000_000
#: Most doc_ids of a list that is broadcast: 8 MB.
IDS = 1_000_000
#: Documents whose keys one task remembers, so as not to send those of copies again.
SEEN = 200_000


class Bands:
    """Size bands for similarity num/den. Pairs whose smaller set is in band i have the larger in i or i + 1."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.edges = [1]

    def _reach(self, n: int) -> int:
        return n * self.den // self.num

    def grow(self, n: int) -> None:
        while self.edges[-1] <= n:
            self.edges.append(self._reach(self.edges[-1]) + 1)

    def band(self, n: int) -> int:
        self.grow(n)
        return int(np.searchsorted(self.edges, n, "right")) - 1

    def differ(self, a: int, b: int) -> int:
        """The most shingles in which similar sets of sizes a and b differ."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def bound(self, band: int) -> int:
        self.grow(self.edges[band])
        a = self.edges[band + 1] - 1
        return self.differ(a, self._reach(a))

    def blocks(self, band: int) -> int:
        """Blocks of a band's sketch: enough over the bound that empty blocks can be left out."""
        return self.bound(band) * 11 // 10 + 3

    def schemes(self, n: int) -> list[int]:
        """The bands in which a set of n shingles can have partners."""
        own = self.band(n)
        return [own, own - 1] if own and n <= self._reach(self.edges[own] - 1) else [own]


@lru_cache(8)
def bands(num: int, den: int) -> Bands:
    return Bands(num, den)


def block_keys(x: np.ndarray, how: Bands) -> np.ndarray:
    """Keys of a sorted shingle set: similar sets that differ have one in common.

    Blocks in which a set has no odd bit are left out where more blocks must agree than are empty. Where not,
    the set also gives its least shingles as keys, of which two similar sets share one whatever the blocks.
    """
    flips = mix(x ^ U(0x5851F42D4C957F2D))
    out = []
    for band in how.schemes(len(x)):
        k, d = how.blocks(band), how.bound(band)
        block = ((x >> U(32)) * U(k)) >> U(32)
        first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        out.append(mix(np.bitwise_xor.reduceat(flips, first) ^ mix(block[first] + U(band << 32))))
        if k - len(first) >= k - d:
            need = -(-how.num * len(x) // how.den)
            out.append(mix(x[: len(x) - need + 1] ^ mix(np.full(1, (band << 32) + 0xFFFFFFFF, U))))
    return np.concatenate(out)


def parity_sketch(x: np.ndarray) -> bytes:
    """A sketch of about four bits a shingle; its width is a power of two, so wider ones can be folded."""
    width = 1 << max(6, (4 * len(x) - 1).bit_length())
    odd = np.bincount((mix(x ^ U(0x2545F4914F6CDD1D)) & U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch made narrower: bits that coincide are added."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, size), axis=0)


def prints(x: np.ndarray) -> tuple[int, int]:
    """Two hashes of a shingle set."""
    if not len(x):
        return 0, 0
    a = np.bitwise_xor.reduce(mix(x ^ U(0x9FB21C651E98DF25)))
    return int(mix(np.array([a + U(len(x))], U)).view(np.int64)[0]), int(np.add.reduce(mix(x + U(0xD1B54A32D192ED03))).view(np.int64))


def _describe(width: int, sketched: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, s = [], [], [], []
            for _, x in hashing.shingle_sets(batch.column(1), width):
                f = prints(x)
                n.append(len(x))
                a.append(f[0])
                b.append(f[1])
                s.append(parity_sketch(x) if sketched and len(x) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (n, a, b)), pa.array(s, pa.binary())], schema=schema)

    return run


def describe(docs: DataFrame, width: int = 5, sketched: bool = True) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (hashes of the shingle set), a parity sketch of each row of docs."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_describe(width, sketched), "doc_id long, n_shingles long, f1 long, f2 long, sketch binary")


def _deal(width: int, num: int, den: int, buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("sets", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how, seen = bands(num, den), set()
        held: list[np.ndarray] = []
        owners: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            keys, own = np.concatenate(held), np.concatenate(owners)
            held.clear()
            owners.clear()
            bucket = (((keys >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            # the upper bits of a key choose its bucket, the lower ones tell keys apart in it
            keys, own = keys[order].astype(np.uint32), own[order]
            at = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = np.flatnonzero(at[1:] > at[:-1])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(full, pa.int32()),
                    pa.array([keys[at[i] : at[i + 1]].tobytes() for i in full], pa.binary()),
                    pa.array([own[at[i] : at[i + 1]].tobytes() for i in full], pa.binary()),
                ],
                schema=schema,
            )

        size = 0
        for batch in batches:
            for _, x in hashing.shingle_sets(batch.column(0), width):
                if len(x):
                    f = prints(x)
                    if f in seen:
                        continue
                    if len(seen) < SEEN:
                        seen.add(f)
                    k = block_keys(x, how)
                    held.append(k)
                    owners.append(np.full(len(k), f[0], np.int64))
                    size += len(k)
                    if size >= 4_000_000:
                        yield packed()
                        size = 0
        if held:
            yield packed()

    return run


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of equal keys in each bucket: links of every member to the least one, and groups of three or more once."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("grp", pa.int64())])
    got: dict[int, list[tuple[bytes, bytes]]] = {}
    for batch in batches:
        for bucket, keys, sets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            got.setdefault(bucket, []).append((keys, sets))
    while got:
        _, parts = got.popitem()
        keys = np.concatenate([np.frombuffer(k, np.uint32) for k, _ in parts])
        sets = np.concatenate([np.frombuffer(s, np.int64) for _, s in parts])
        del parts
        order = np.argsort(keys)
        keys, sets = keys[order], sets[order]
        twin = keys[1:] == keys[:-1]
        member = np.zeros(len(keys), bool)
        member[1:] |= twin
        member[:-1] |= twin
        keys, sets = keys[member], sets[member]
        if not len(keys):
            continue
        order = np.lexsort((sets, keys))
        keys, sets = keys[order], sets[order]
        fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])))
        keys, sets = keys[fresh], sets[fresh]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.append(first, len(keys)))
        least = np.repeat(sets[first], size)
        grp = np.repeat(np.add.reduceat(mix(sets.view(U)), first).view(np.int64), size)
        wide = np.repeat(size, size) > 2
        other = sets != least
        pairs = np.unique(np.stack([least[other], sets[other]], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int64())], schema=schema)
        if wide.any():
            many = np.unique(np.stack([grp[wide], sets[wide]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(many), pa.int64()), pa.array(many[:, 1]), pa.array(many[:, 0])], schema=schema)


def _near(how: Bands, n: int, s: np.ndarray, m: int, t: np.ndarray) -> bool:
    if min(n, m) * how.den < max(n, m) * how.num:
        return False
    size = min(len(s), len(t))
    return int(np.bitwise_count(fold(s, size) ^ fold(t, size)).sum()) <= how.differ(n, m)


def _sift(num: int, den: int):
    """Pairs whose sizes and sketches allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = bands(num, den)
        for batch in batches:
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            s, t = batch.column("s"), batch.column("t")
            ok = [_near(how, int(n[i]), np.frombuffer(s[i].as_buffer(), np.uint8), int(m[i]), np.frombuffer(t[i].as_buffer(), np.uint8)) for i in range(len(n))]
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return run


class Forest:
    """Labels of a tile's rows that joins make equal."""

    def __init__(self, comp: np.ndarray):
        _, self.label = np.unique(comp, return_inverse=True)
        self.left = int(self.label.max()) if len(comp) else 0

    def join(self, i: int, j: int) -> None:
        self.label[self.label == self.label[j]] = self.label[i]
        self.left -= 1


def tile_pairs(how: Bands, n: np.ndarray, sketches: list[np.ndarray], comp: np.ndarray, side: np.ndarray, sets: list[np.ndarray] | None = None) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of a tile's rows whose sketches allow the similarity, and whose sets have it, if given.

    A forest over the components that the rows come with: no pair of what is one component already. Side 0 meets
    side 1, side 2 meets itself; empty sets meet nothing. Sketches are held by their width: similar sets are in one
    class of widths or in neighbouring ones, of which the wider is folded.
    """
    forest = Forest(comp)
    width = np.array([len(x) for x in sketches], np.int64)
    bits = {}
    for w in sorted({*width.tolist()} - {0}):
        rows = np.flatnonzero(width == w)
        bits[w] = rows, np.stack([sketches[i] for i in rows.tolist()])
    for w, (rows, own) in bits.items():
        near = [(rows, own)]
        if 2 * w in bits:
            more, wide = bits[2 * w]
            near.append((more, wide[:, :w] ^ wide[:, w:]))
        for at, (right, wide) in enumerate(near):
            left_words, right_words = own.view(np.uint64), np.ascontiguousarray(wide).view(np.uint64)
            for k, i in enumerate(rows.tolist()):
                if not forest.left:
                    return
                ok = forest.label[right] != forest.label[i]
                ok &= side[right] + side[i] == 1 if side[i] < 2 else True
                if not at:
                    ok[: k + 1] = False
                ok &= np.minimum(n[right], n[i]) * how.den >= np.maximum(n[right], n[i]) * how.num
                j = np.flatnonzero(ok)
                for a in range(0, len(j), 512):
                    some = j[a : a + 512]
                    gap = np.bitwise_count(right_words[some] ^ left_words[k]).sum(axis=1)
                    for m in right[some[gap <= (how.den - how.num) * (n[i] + n[right[some]]) // (how.den + how.num)]].tolist():
                        if forest.label[m] == forest.label[i]:
                            continue
                        if sets is not None:
                            common = len(np.intersect1d(sets[i], sets[m], assume_unique=True))
                            if how.den * common < how.num * (n[i] + n[m] - common):
                                continue
                        forest.join(i, m)
                        yield i, m


def tile_links(how: Bands, sets: list[np.ndarray], comp: np.ndarray, side: np.ndarray) -> Iterator[tuple[int, int]]:
    """tile_pairs() of sets, verified."""
    n = np.array([len(x) for x in sets], np.int64)
    sketches = [np.frombuffer(parity_sketch(x) if len(x) else b"", np.uint8) for x in sets]
    return tile_pairs(how, n, sketches, comp, side, sets)


#: What tells a tile.
TILE = ("cluster", "b1", "p1", "b2", "p2")


def _tiles(num: int, den: int, pairs):
    """What pairs(how, n, payload, comp, side) finds in each tile, as `name` of its rows (id or comp).

    The rows come sorted by tile, so one tile is held at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how, held, last = bands(num, den), [], None

        def done() -> pa.RecordBatch:
            name, n, comp, side, payload = zip(*held, strict=True)
            held.clear()
            found = [(name[i], name[j]) for i, j in pairs(how, np.array(n, np.int64), payload, np.array(comp, np.int64), np.array(side, np.int64))]
            return pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], names=["u", "v"])

        for batch in batches:
            tiles = zip(*(batch.column(c).to_pylist() for c in TILE), strict=True)
            rows = zip(*(batch.column(c).to_pylist() for c in ("name", "n", "comp", "side", "payload")), strict=True)
            for key, row in zip(tiles, rows, strict=True):
                if key != last and held:
                    yield done()
                last = key
                held.append(row)
        if held:
            yield done()

    return run


def _by_sketch(how, n, payload, comp, side):
    return tile_pairs(how, n, [np.frombuffer(x, np.uint8) for x in payload], comp, side)


def _by_text(width: int):
    def pairs(how, n, payload, comp, side):
        return tile_links(how, [x for _, x in hashing.shingle_sets(pa.array(payload, pa.large_string()), width)], comp, side)

    return pairs


def _parts(rows: str, size: str):
    """Parts of about CHUNK rows and PART shingles."""
    return F.ceil(F.greatest(F.col(rows) / CHUNK, F.col(size) / PART)).cast("int")


def _sizes(members: DataFrame) -> DataFrame:
    """Whether each cluster (__c) needs more than one part (__split)."""
    whole = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("__rows"), F.sum("n").alias("__size"))
    return whole.select(F.col("cluster").alias("__c"), (_parts("__rows", "__size") > 1).alias("__split"))


def _tiled(members: DataFrame, num: int, den: int) -> DataFrame:
    """members (cluster, id, n, comp) dealt into tiles: with cluster, b1, p1, b2, p2 and side, a row for each tile.

    A cluster of more than CHUNK rows or PART shingles is split by sizes, so that similar sets are in one band or in
    neighbouring ones, and by hash into parts of about that size; each part meets itself, the others of its
    band and those of the next.
    """
    base = float(np.log(den / num * 1.01))
    rows = members.join(_sizes(members), F.col("cluster") == F.col("__c"))
    rows = rows.withColumn("b", F.when(F.col("__split"), F.floor(F.log(F.col("n").cast("double")) / base)).otherwise(0).cast("int")).drop("__c", "__split")
    sizes = rows.groupBy("cluster", "b").agg(F.count(F.lit(1)).alias("__rows"), F.sum("n").alias("__size"))
    sizes = sizes.groupBy(F.col("cluster").alias("__c")).agg(F.map_from_entries(F.collect_list(F.struct("b", _parts("__rows", "__size")))).alias("__parts"))
    rows = rows.join(sizes, F.col("cluster") == F.col("__c"))
    parts = lambda k: F.coalesce(F.try_element_at("__parts", F.col("b") + k), F.lit(0))
    rows = rows.withColumn("p", F.pmod(F.xxhash64("id", F.lit(3)), parts(0)).cast("int"))
    b, p = F.col("b"), F.col("p")
    tile = lambda b1, p1, b2, p2, side: F.struct(b1.alias("b1"), p1.alias("p1"), b2.alias("b2"), p2.alias("p2"), side.alias("side"))
    every = lambda k, make: F.when(parts(k) > 0, F.transform(F.sequence(F.lit(0), parts(k) - 1), make)).otherwise(F.array().cast("array<struct<b1:int,p1:int,b2:int,p2:int,side:int>>"))
    tiles = F.concat(
        every(0, lambda q: tile(b, F.least(p, q), b, F.greatest(p, q), F.when(p == q, 2).when(p < q, 0).otherwise(1))),
        every(1, lambda q: tile(b, p, b + 1, q, F.lit(0))),
        every(-1, lambda q: tile(b - 1, q, b, p, F.lit(1))),
    )
    return rows.select("cluster", "id", "n", "comp", F.inline(tiles))


def _verify(width: int, num: int, den: int):
    """Pairs whose sets have the similarity; the larger text of a run of pairs is hashed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last: dict[str, np.ndarray] = {}

            def of(text: str, keep: dict = last) -> np.ndarray:
                if text not in keep:
                    if len(keep) >= 8:
                        keep.pop(next(iter(keep)))
                    keep[text] = next(hashing.shingle_sets(pa.array([text]), width))[1]
                return keep[text]

            ok = []
            for a, b in zip(batch.column("s"), batch.column("t"), strict=True):
                x, y = of(a.as_py()), of(b.as_py())
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * common >= num * (len(x) + len(y) - common))
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return run


def _texts(docs: DataFrame, ids: DataFrame, tag: str) -> DataFrame:
    """id and text of the documents in ids (__id), stored. A list of up to IDS is broadcast, so that no other text moves."""
    ids = stored(ids.distinct(), f"{tag}-ids")
    few = F.broadcast(ids) if ids.count() <= IDS else ids.hint("merge")
    text = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return stored(text.join(few, F.col("id") == F.col("__id"), "left_semi"), f"{tag}-texts")


def _links(pairs: DataFrame, docs: DataFrame, width: int, num: int, den: int, tag: str) -> DataFrame:
    """The pairs (u, v) of doc_ids whose texts' sets have the similarity."""
    text = _texts(docs, pairs.select(F.col("u").alias("__id")).union(pairs.select("v")), tag)
    both = pairs.join(text.select(F.col("id").alias("u"), F.col("text").alias("s")), "u")
    both = both.join(text.select(F.col("id").alias("v"), F.col("text").alias("t")), "v").select("u", "v", "s", "t")
    return stored(both.mapInArrow(_verify(width, num, den), "u long, v long").distinct(), f"{tag}-links")


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs.

    Two documents link when den * |intersection| >= num * |union| of their shingle sets; component_id is the
    smallest doc_id reachable by links, itself included. Documents with null or wordless text have no shingles,
    documents with null doc_id no component (null); both link with nothing. Rows with equal doc_id are one
    document to the links. Equal sets are found by their hashes, so copies cost no pairs. Extra columns of docs
    are not read; long texts are read whole, in pieces; an empty table gives an empty result.

    Rounds: (1) in each group of equal block keys all members are compared with the smallest; (2) groups that then
    still span several components are joined into clusters by common members, and the members of a cluster are
    compared with each other, each pair once however many groups it shares, in tiles of bounded size (clusters over
    that size: the groups of each least member instead, so that the rows compared are at most those of the groups): by sketches,
    which leaves the components that may be near, then those by texts. Pairs within a component need no comparison,
    so the components are exact. A tile returns a forest of what it found, fewer rows than it has members.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sets = stored(describe(docs, width), "near-sets")
    first = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "f1", "f2")
    reps = stored(first.agg(F.min("doc_id").alias("rep"), F.max("sketch").alias("sketch")), "near-reps")
    total = reps.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (2 * BUCKET)) + 1
    text = docs.filter("doc_id IS NOT NULL").select(F.col("text").cast("string"))
    dealt = text.mapInArrow(_deal(width, num, den, buckets), "bucket int, keys binary, sets binary")
    found = stored(dealt.repartition(buckets, "bucket").mapInArrow(_match, "a long, b long, grp long"), "near-found")

    def sifted(pairs: DataFrame, tag: str) -> DataFrame:
        fit = pairs.filter("u <> v").filter(F.least("n", "m") * den >= F.greatest("n", "m") * num)
        return stored(fit.select("u", "v", "n", "s", "m", "t").mapInArrow(_sift(num, den), "u long, v long"), tag)

    def described(name: str, id_: str, n: str, s: str) -> DataFrame:
        return reps.select(F.col("f1").alias(name), F.col("rep").alias(id_), F.col("n_shingles").alias(n), F.col("sketch").alias(s))

    star = found.filter("grp IS NULL").select("a", "b").distinct()
    star = star.join(described("a", "u", "n", "s"), "a").join(described("b", "v", "m", "t"), "b")
    star = sifted(star, "near-star")
    links = _links(star, docs, width, num, den, "near-one")
    comps = stored(components(links), "near-comps")

    groups = found.filter("grp IS NOT NULL").select("grp", F.col("b").alias("f1")).distinct()
    groups = groups.join(reps.select("f1", "rep", F.col("n_shingles").alias("n")), "f1")
    groups = groups.join(comps, groups["rep"] == comps["node"], "left").withColumn("comp", F.coalesce("component", "rep")).drop("node", "component", "f1")
    mixed = groups.groupBy("grp").agg(F.min("comp").alias("__lo"), F.max("comp").alias("__hi"), F.min("rep").alias("head")).filter("__lo < __hi")
    open_ = stored(groups.join(mixed.select("grp", "head"), "grp").select("head", "rep", "n", "comp").distinct(), "near-open")
    if not open_.isEmpty():
        def found_in(members: DataFrame, name: str, payload: DataFrame, pairs, tag: str) -> DataFrame:
            rows = _tiled(members, num, den).join(payload, F.col("id") == F.col("__id"))
            rows = rows.select(*TILE, F.col(name).alias("name"), "n", "comp", "side", "payload")
            return stored(rows.repartition(*TILE).sortWithinPartitions(*TILE).mapInArrow(_tiles(num, den, pairs), "u long, v long"), tag)

        clusters = components(open_.select(F.col("head").alias("u"), F.col("rep").alias("v")))
        members = open_.select("rep", "n", "comp").distinct().join(clusters, F.col("rep") == F.col("node"))
        members = stored(members.select(F.col("component").alias("cluster"), F.col("rep").alias("id"), "n", "comp"), "near-members")
        # common passages tie most open groups of a large corpus into one cluster: one that needs several parts is taken by the
        # heads of its groups instead, which any two texts of a group have in common
        sized = members.join(_sizes(members), F.col("cluster") == F.col("__c"))
        large = sized.filter("__split").select(F.col("id").alias("__id"))
        by_head = open_.join(large, F.col("rep") == F.col("__id")).select(F.col("head").alias("cluster"), F.col("rep").alias("id"), "n", "comp").distinct()
        members = stored(sized.filter(~F.col("__split")).select("cluster", "id", "n", "comp").union(by_head), "near-families")
        # which components may be near, by sketches; then the members of those, by texts
        near = found_in(members, "comp", reps.select(F.col("rep").alias("__id"), F.col("sketch").alias("payload")), _by_sketch, "near-maybe")
        near = components(near)
        close = stored(members.drop("cluster").distinct().join(near, F.col("comp") == F.col("node")).select(F.col("component").alias("cluster"), "id", "n", "comp"), "near-close")
        text = _texts(docs, close.select(F.col("id").alias("__id")), "near-two").select(F.col("id").alias("__id"), F.col("text").alias("payload"))
        links = links.union(found_in(close, "id", text, _by_text(width), "near-two"))
        comps = stored(components(links), "near-comps")

    labels = reps.join(comps, reps["rep"] == comps["node"], "left").select(F.col("n_shingles").alias("__n"), F.col("f1").alias("__f1"), F.col("f2").alias("__f2"), F.coalesce("component", "rep").alias("__comp"))
    same = (F.col("n_shingles") == F.col("__n")) & (F.col("f1") == F.col("__f1")) & (F.col("f2") == F.col("__f2"))
    out = sets.select("doc_id", "n_shingles", "f1", "f2").join(labels, same, "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("__comp")), F.col("doc_id")))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))


def first_of_groups(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The first row of docs of each group of near-duplicates, with docs' columns and their values.

    First is the least doc_id, null after all others, then the least hash of the text, then of the row; of rows
    that are equal in all columns one stays. Rows are told apart by doc_id and text, so different texts of one doc_id
    are documents of their own, and rows without doc_id are compared like others. Rows without text or words stay,
    all of them, as do long texts and texts of one word if nothing is like them. An empty table gives an empty
    one. Only hashes are grouped; whole rows are shuffled once, to be joined with the hashes that stay.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    id_, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    plain = [F.col(f"`{c}`") if not any(x in kind for x in ("map<", "variant")) else F.to_json(F.struct(f"`{c}`")) for c, kind in docs.dtypes]
    key, whole = F.xxhash64(id_, text), F.xxhash64(*plain)
    worded = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.filter(worded).select(key.alias("doc_id"), text.alias("text"))
    groups = stored(near_duplicates(keyed, width, num, den), "near-groups").select(F.col("doc_id").alias("__key"), "component_id").distinct()
    narrow = docs.filter(worded).select(key.alias("__k"), id_.alias("__id"), whole.alias("__h")).join(groups.hint("merge"), F.col("__k") == F.col("__key"))
    order = F.struct(F.col("__id").isNull().alias("a"), F.col("__id").alias("b"), F.col("__key").alias("c"), F.col("__h").alias("d"))
    first = narrow.groupBy("component_id").agg(F.min(order).alias("f"))
    first = stored(first.select(F.col("f.c").alias("__key"), F.col("f.d").alias("__h")), "near-first")
    # the list grows with the corpus, so it is joined by a shuffle at every size and never sent to all tasks
    rows = docs.filter(worded).select(row.alias("__row"), key.alias("__key"), whole.alias("__h")).join(first.hint("merge"), ["__key", "__h"], "left_semi")
    one = rows.withColumn("__at", F.row_number().over(Window.partitionBy("__key", "__h").orderBy("__key"))).filter("__at = 1")
    return one.select("__row.*").union(docs.filter(~worded))
