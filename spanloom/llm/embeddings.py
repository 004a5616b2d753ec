"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors of cosine c have squared distance 2 - 2c. After a fixed rotation the dimensions are split into low
blocks, each with a share of that distance in proportion to its dimensions: a pair within the whole distance is
within the share of one block at least. Each block is range-joined under its share; pairs found in any block are
verified in double precision.

The range join of a block has two levels. Vectors are dealt to cells by the nearest of some pivots of their label; a cell
knows the middle and the reach of its vectors in each block, so that two cells whose blocks are all further apart than their shares
have no pair and are not brought together. Within a task each block has leaves of its own: its coordinates are halved again and again
where they are widest, and only leaves whose boxes are within the block's share are measured against each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.components import components
from spanloom.llm.shared import ship, stored

#: Vectors of a part that meet as many others in one task, of a leaf of a block (a power of two), and dimensions of a block.
CHUNK, LEAF, BLOCK = 2048, 8, 8
#: Pairs of leaves that are measured at once, and the share of open pairs from which on a block is measured as a whole.
AT_ONCE, OPEN = 8192, 0.4
#: Balls of parts that meet as many others in one task.
BALLS = 512
#: Most pivots of all labels, which are broadcast: 4 MB at 128 dimensions.
PIVOTS = 4096
#: What single precision may add to a block's squared distance.
SLACK = 1e-4


@lru_cache(8)
def rotation(dims: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(20240607).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks(dims: int) -> list[tuple[int, int]]:
    return [(a, min(a + BLOCK, dims)) for a in range(0, dims, BLOCK)]


def candidates(x: np.ndarray, y: np.ndarray, reach: float) -> np.ndarray:
    """Which pairs of rotated unit vectors (single precision) are within the share of some block."""
    near = np.zeros((len(x), len(y)), bool)
    dims = x.shape[1]
    for a, b in blocks(dims):
        u, v = x[:, a:b], y[:, a:b]
        limit = reach * u.shape[1] / dims + SLACK
        near |= (u * u).sum(1)[:, None] + (v * v).sum(1) - 2 * (u @ v.T) <= limit
    return near


def balls(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The middle of some rotated vectors, and their reach from it in each block."""
    middle = x.mean(axis=0)
    gap = (x - middle) ** 2
    return middle, np.sqrt(np.array([gap[:, a:b].sum(1).max() for a, b in blocks(x.shape[1])]))


def apart(m: np.ndarray, r: np.ndarray, n: np.ndarray, s: np.ndarray, reach: float) -> np.ndarray:
    """Whether balls (m, r) and each of (n, s) can have no pair: no block within its share, or too far in all blocks together."""
    dims = len(m)
    cuts = blocks(dims)
    gap = np.stack([np.sqrt(((n[:, a:b] - m[a:b]) ** 2).sum(1)) for a, b in cuts], axis=1)
    gap = np.maximum(gap - r - s, 0) ** 2
    share = np.array([reach * (b - a) / dims for a, b in cuts]) + SLACK
    return (gap > share).all(axis=1) | (gap.sum(axis=1) > reach + SLACK)


def leaves(x: np.ndarray) -> np.ndarray:
    """Row numbers of points in leaves of up to LEAF, one row of the result each, filled up with -1.

    Points are cut again and again in the coordinate in which they are widest, at the widest gap of the middle half.
    """
    out, open_ = [], [np.arange(len(x))]
    while open_:
        own = open_.pop()
        if len(own) <= LEAF:
            out.append(own)
            continue
        some = x[own]
        one = some[:, (some.max(axis=0) - some.min(axis=0)).argmax()]
        order = np.argsort(one, kind="stable")
        first = len(own) // 4
        gaps = np.diff(one[order[first : len(own) - first]])
        cut = first + 1 + int(gaps.argmax())
        if not gaps.max() > 0:
            cut = len(own) // 2
        open_ += [own[order[cut:]], own[order[:cut]]]
    rows = np.full((len(out), LEAF), -1)
    for k, own in enumerate(out):
        rows[k, : len(own)] = own
    return rows


def near_in_block(u: np.ndarray, v: np.ndarray | None, limit: float) -> tuple[np.ndarray | None, np.ndarray | None, int]:
    """Rows of u and of v (or of u, each pair once) within the squared distance `limit`, and how many pairs were measured.

    None stands for all pairs, where so many leaves are open that a product of matrices is less work.
    """
    left = leaves(u)
    right, w = (left, u) if v is None else (leaves(v), v)

    def boxes(rows: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = x[rows]
        gone = (rows < 0)[:, :, None]
        return np.where(gone, np.inf, some).min(axis=1), np.where(gone, -np.inf, some).max(axis=1)

    (lo, hi), (low, high) = boxes(left, u), boxes(right, w)
    gap = np.zeros((len(left), len(right)), np.float32)
    for k in range(u.shape[1]):
        gap += np.maximum(np.maximum(lo[:, k, None] - high[None, :, k], low[None, :, k] - hi[:, k, None]), 0) ** 2
    open_ = gap <= limit
    if v is None:
        open_ &= np.tri(len(left), dtype=bool)
    if open_.sum() > OPEN * gap.size * (0.5 if v is None else 1):
        return None, None, len(u) * len(w) if v is not None else len(u) * (len(u) - 1) // 2
    a, b = np.nonzero(open_)
    found, measured = [], 0
    for k in range(0, len(a), AT_ONCE):
        i, j = left[a[k : k + AT_ONCE]], right[b[k : k + AT_ONCE]]
        x, y = u[i], w[j]
        far = (x * x).sum(2)[:, :, None] + (y * y).sum(2)[:, None, :] - 2 * np.matmul(x, y.transpose(0, 2, 1))
        real = (i >= 0)[:, :, None] & (j >= 0)[:, None, :]
        if v is None:
            real &= (a[k : k + AT_ONCE] != b[k : k + AT_ONCE])[:, None, None] | (i[:, :, None] > j[:, None, :])
        measured += int(real.sum())
        p, q, r = np.nonzero((far <= limit) & real)
        found.append(np.stack([i[p, q], j[p, r]]))
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return pairs[0], pairs[1], measured


def near_pairs(x: np.ndarray, y: np.ndarray | None, reach: float, tally: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of x and of y (or of x, each pair once) that are within the share of some block, in parts.

    tally gets the number of pairs measured in each block.
    """
    z, dims = x if y is None else y, x.shape[1]
    near = np.zeros((len(x), len(z)), bool)
    for a, b in blocks(dims):
        limit = reach * (b - a) / dims + SLACK
        u, v = np.ascontiguousarray(x[:, a:b]), None if y is None else np.ascontiguousarray(y[:, a:b])
        i, j, measured = near_in_block(u, v, limit)
        if i is None:
            w = u if v is None else v
            near |= (u * u).sum(1)[:, None] + (w * w).sum(1) - 2 * (u @ w.T) <= limit
        else:
            near[i, j] = True
            if y is None:
                near[j, i] = True
        if tally is not None:
            tally.append(measured)
    if y is None:
        near = np.triu(near, 1)
    for a in range(0, len(x), 256):
        i, j = np.nonzero(near[a : a + 256])
        yield i + a, j


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _tile(cosine: float):
    """Links between two parts of a group: for each vector the weight it links with, and a forest of the links."""

    def run(pdf):
        import pandas as pd

        raw = np.stack([np.asarray(e, float) for e in pdf["embedding"]])
        raw = np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1))[1][:, None])  # by powers of two, so that squares stay in range
        ids, w, side = pdf["rep"].to_numpy(), pdf["w"].to_numpy(), pdf["side"].to_numpy()
        norm = np.sqrt((raw * raw).sum(1))
        turned = ((raw / norm[:, None]) @ rotation(raw.shape[1])).astype(np.float32)
        within = bool((side == 2).all())
        left, right = (np.arange(len(ids)),) * 2 if within else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        links, parent, forest = np.zeros(len(ids), np.int64), list(range(len(ids))), []
        for i, j in near_pairs(turned[left], None if within else turned[right], 2 - 2 * cosine) if len(left) and len(right) else ():
            i, j = left[i], right[j]
            for k in range(0, len(i), 65536):
                p, q = i[k : k + 65536], j[k : k + 65536]
                ok = (raw[p] * raw[q]).sum(1) / (norm[p] * norm[q]) >= cosine
                p, q = p[ok], q[ok]
                np.add.at(links, p, w[q])
                np.add.at(links, q, w[p])
                for s, t in zip(p.tolist(), q.tolist(), strict=True):
                    s, t = _find(parent, s), _find(parent, t)
                    if s != t:
                        parent[max(s, t)] = min(s, t)
                        forest.append((ids[s], ids[t]))
        some = links > 0
        n = len(forest)
        return pd.DataFrame(
            {
                "u": np.concatenate([ids[some], np.array([x for x, _ in forest], np.int64)]),
                "v": pd.array([None] * int(some.sum()) + [int(x) for _, x in forest], dtype="Int64"),
                "n": pd.array([*links[some].tolist(), *[None] * n], dtype="Int64"),
            }
        )

    return run


def _cells(reps: DataFrame, sizes: DataFrame) -> DataFrame:
    """reps with `cell`, the nearest of their label's pivots, -1 for labels of few vectors, and turned unit vectors.

    A label has a pivot for each CHUNK of its vectors, those with the least hash, at most PIVOTS of all labels together.
    """
    total = sizes.filter(F.col("__n") > CHUNK).agg(F.sum("__n")).first()[0] or 0
    each = max(CHUNK, -(-total // PIVOTS))
    rank = F.row_number().over(Window.partitionBy("label", "dims").orderBy(F.xxhash64("rep", F.lit(5)), "rep"))
    # a pivot is drawn with twice the chance, then counted, so that only about as many rows are ranked as are kept
    drawn = reps.join(sizes.filter(F.col("__n") > CHUNK), ["label", "dims"]).filter(F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(each)) < 2)
    chosen = drawn.withColumn("__rank", rank).filter(F.col("__rank") <= F.ceil(F.col("__n") / each)).select("label", "dims", "embedding").limit(2 * PIVOTS).collect()
    pivots: dict = {}
    for label, dims, e in chosen:
        pivots.setdefault((label, dims), []).append(e)
    held = reps.sparkSession.sparkContext.broadcast({k: unit(np.array(v, float)) for k, v in pivots.items()})
    names = reps.columns
    schema = reps.withColumn("cell", F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.full(batch.num_rows, -1, np.int32)
            keys = list(zip(batch.column(names.index("label")).to_pylist(), batch.column(names.index("dims")).to_pylist(), strict=True))
            for key in {*keys} & held.value.keys():
                rows = [k for k, x in enumerate(keys) if x == key]
                x = unit(batch.column(names.index("embedding")).take(pa.array(rows)).flatten().to_numpy().astype(float).reshape(len(rows), -1))
                cell[rows] = (x @ held.value[key].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*names, "cell"])

    return reps.mapInArrow(run, schema)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _open_parts(cosine: float):
    """The pairs of two groups of a label's parts, or of one, whose balls can hold a pair; a part's ball is one row."""

    def run(pdf):
        import pandas as pd

        reach = 2 - 2 * cosine
        part, group = pdf["part"].to_numpy(), pdf["own"].to_numpy()
        middle, radius = np.stack(pdf["middle"]), np.stack(pdf["radius"])
        a, b = pdf["a"].iloc[0], pdf["b"].iloc[0]
        left, right = np.flatnonzero(group == a), np.flatnonzero(group == b)
        out = []
        for k in left.tolist():
            near = right[~apart(middle[k], radius[k], middle[right], radius[right], reach)]
            if a == b:
                near = near[part[near] >= part[k]]
            out += [(min(part[k], p), max(part[k], p)) for p in part[near].tolist()]
        return pd.DataFrame({"label": pdf["label"].iloc[0], "dims": pdf["dims"].iloc[0], "i": [i for i, _ in out], "j": [j for _, j in out]}).astype({"i": "int64", "j": "int64"})

    return run


def _ball(pdf):
    """The ball of one part."""
    import pandas as pd

    x = unit(np.stack([np.asarray(e, float) for e in pdf["embedding"]]))
    middle, radius = balls(x @ rotation(x.shape[1]))
    return pd.DataFrame({"label": [pdf["label"].iloc[0]], "dims": [pdf["dims"].iloc[0]], "part": [pdf["part"].iloc[0]], "middle": [middle.tolist()], "radius": [radius.tolist()]})


def tiles(parted: DataFrame, cosine: float) -> DataFrame:
    """label, dims, i and j: the pairs of parts to be compared, of parted (label, dims, part, embedding).

    The balls of a label are dealt to groups of about BALLS, and each pair of groups is a task's work.
    """
    label = parted.schema["label"].dataType.simpleString()
    ball = parted.groupBy("label", "dims", "part").applyInPandas(_ball, f"label {label}, dims int, part long, middle array<double>, radius array<double>")
    ball = stored(ball, "vec-balls")
    many = ball.groupBy("label", "dims").agg(F.ceil(F.count(F.lit(1)) / BALLS).cast("long").alias("__groups"))
    dealt = ball.join(many, ["label", "dims"]).withColumn("own", F.pmod(F.xxhash64("part", F.lit(9)), F.col("__groups")))
    dealt = dealt.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__groups") - 1)))
    dealt = dealt.select("label", "dims", "part", "middle", "radius", "own", F.least("own", "__k").alias("a"), F.greatest("own", "__k").alias("b"))
    return dealt.groupBy("label", "dims", "a", "b").applyInPandas(_open_parts(cosine), f"label {label}, dims int, i long, j long")


def parted(reps: DataFrame) -> DataFrame:
    """reps with `part`: cells of labels, cut by hash where they hold more than CHUNK."""
    sizes = stored(reps.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("__n")), "vec-sizes")
    rows = stored(_cells(reps, sizes), "vec-celled")
    cells = rows.groupBy("label", "dims", "cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("long").alias("__parts"))
    rows = rows.join(cells, ["label", "dims", "cell"])
    part = (F.col("cell").cast("long") + 1) * (1 << 32) + F.pmod(F.xxhash64("rep", F.lit(7)), F.col("__parts"))
    return rows.withColumn("part", part).drop("cell", "__parts")


def _dealt(reps: DataFrame, cosine: float) -> DataFrame:
    """label, dims, rep, w, embedding, i, j and side: a row of reps for each tile that it is in."""
    rows = stored(parted(reps), "vec-parts")
    open_ = stored(tiles(rows, cosine), "vec-tiles")
    left = open_.select(F.col("label").alias("__l"), F.col("dims").alias("__d"), F.col("i").alias("__p"), "i", "j", F.when(F.col("i") == F.col("j"), 2).otherwise(0).alias("side"))
    right = open_.filter("i <> j").select(F.col("label").alias("__l"), F.col("dims").alias("__d"), F.col("j").alias("__p"), "i", "j", F.lit(1).alias("side"))
    both = left.unionByName(right)
    out = rows.join(both, (F.col("label") == F.col("__l")) & (F.col("dims") == F.col("__d")) & (F.col("part") == F.col("__p")))
    return out.select("label", "dims", "rep", "w", "embedding", "i", "j", "side")


def near_vectors(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label).

    Rows link when their labels are equal and not null and the cosine of their embeddings is at least `cosine`.
    A row links with nothing if its vec_id, label or embedding is null, or the embedding is zero, empty or has a
    null or non-finite component; vectors of different lengths do not link. Such a row is its own component
    (null for a null vec_id). Repeated rows are vectors of their own that link with each other. Extra columns are
    not read; an empty table gives an empty result.

    Equal vectors of a label are compared once, with their number as weight; different vectors of one vec_id are compared each, and
    are in one component only if links lead from one to the other. A label's distinct vectors are dealt to cells
    by the nearest of its pivots, and large cells into parts of about CHUNK; each pair of parts whose balls can
    hold a pair is a task of bounded size, so a large label is many tasks. What they return is a count for each vector and at
    most a forest of the links. Vectors of no structure leave all pairs of parts open: the work then grows with the
    square of a label's distinct vectors.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), "label")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    named = rows.filter("ok").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("w"))
    named = stored(named.select("label", "embedding", "least", "w", F.size("embedding").alias("dims"), F.monotonically_increasing_id().alias("rep")), "vec-reps")
    reps = named.drop("least")
    cells = stored(_dealt(reps, cosine), "vec-cells")
    found = stored(cells.groupBy("label", "dims", "i", "j").applyInPandas(_tile(cosine), "u long, v long, n long"), "vec-found")
    comps = components(found.filter("v IS NOT NULL").select("u", "v"))
    counts = found.filter("v IS NULL").groupBy("u").agg(F.sum("n").alias("__links"))
    comps = stored(named.select("rep", "least").join(comps, F.col("rep") == F.col("node")).select("rep", "least", "component"), "vec-components")
    first = comps.groupBy("component").agg(F.min("least").alias("__comp"))
    comps = comps.join(first, "component").select(F.col("rep").alias("node"), "__comp")
    known = named.join(counts, named["rep"] == counts["u"], "left").join(comps, F.col("rep") == F.col("node"), "left")
    known = known.select(F.col("label").alias("__label"), F.col("embedding").alias("__embedding"), (F.coalesce("__links", F.lit(0)) + F.col("w") - 1).alias("__links"), F.coalesce("__comp", "least").alias("__comp"))
    out = rows.join(known, F.col("ok") & (F.col("label") == F.col("__label")) & (F.col("embedding") == F.col("__embedding")), "left")
    out = out.select("vec_id", F.coalesce("__links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("__comp", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
