"""Mixing sources to target weights: hash-random order in each source, prefix sums of sizes, a cut at the budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.shared import stored

#: A word, for sizes.
WORD = r"[^\x20\x09-\x0D]+"
#: Leading bits of a key that number the slices of a source's key range; a cut reads one slice row by row.
SLICE_BITS = 12
#: Most sources whose table is broadcast.
SMALL = 10_000
#: Weights of the sources by rank, repeating.
WEIGHTS = (5.0, 2.0, 1.0)


def targets(totals: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """totals (source, source_size) with `target`: shares of the sum of all sizes by weight, at most `most` sizes each.

    Sources are ranked by code point, null last. Filling in the order of most * size / weight is the same as
    sharing again by weight until none is above its limit: a source is at its limit when the level that the ones
    before it leave is at least its own. One row for each source goes through this window.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    ranked = totals.withColumn("__w", weight).withColumn("__cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    first = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("__cap").over(first), F.lit(0.0))
    heavy = F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(first), F.lit(0.0))
    level = ranked.withColumn("__level", left / heavy).withColumn("__full", F.col("__level") * F.col("__w") >= F.col("__cap"))
    rest = level.withColumn("__level", F.max(F.when(~F.col("__full"), F.col("__level"))).over(everything))
    # the level of the first source below its limit holds for all after it
    rest = rest.withColumn("__level", F.coalesce("__level", F.lit(0.0)))
    return rest.select("source", "source_size", F.when(F.col("__full"), F.col("__cap")).otherwise(F.col("__level") * F.col("__w")).alias("target"))


def cuts(sized: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = 3.0, bits: int = SLICE_BITS) -> DataFrame:
    """One row for each source: source_size, target, epochs, and the key where the last, partial epoch ends.

    sized has source, size and key (64 random bits). Sizes are summed by (source, slice of the key range); the
    slice that a budget (the target, rounded to whole words) ends in is then the only one read key by key. The last
    epoch takes all keys before `last`, and `over` words of the rows that have it; `last` is null for sources without words.
    """
    slice_of = F.shiftright("key", 64 - bits)
    sums = stored(sized.groupBy("source", slice_of.alias("__slice")).agg(F.sum("size").alias("__size")), "mix-sums")
    goal = targets(sums.groupBy("source").agg(F.sum("__size").alias("source_size")), weights, most)
    budget = F.least(F.rint("target"), F.col("source_size") * F.lit(float(most))).cast("long")
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    goal = stored(goal.withColumn("rest", budget - F.col("epochs") * F.col("source_size")), "mix-goal")
    small = F.broadcast if goal.count() <= SMALL else (lambda x: x)
    before = Window.partitionBy("source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("__start", F.coalesce(F.sum("__size").over(before), F.lit(0)))
    wanted = goal.select(F.col("source").alias("__source"), "rest")
    ends = (F.col("__start") <= F.col("rest")) & (F.col("rest") < F.col("__start") + F.col("__size"))
    inside = placed.join(small(wanted), F.col("source").eqNullSafe(F.col("__source"))).filter(ends).drop("source")
    inside = stored(inside.select("__source", "__slice", "__start", "rest"), "mix-inside")
    here = F.col("source").eqNullSafe(F.col("__source")) & (F.col("__at_slice") == F.col("__slice"))
    rows = sized.withColumn("__at_slice", slice_of).join(small(inside), here)
    keys = rows.groupBy("__source", "__start", "rest", "key").agg(F.sum("size").alias("__ties"))
    upto = Window.partitionBy("__source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    keys = keys.withColumn("__at", F.col("__start") + F.coalesce(F.sum("__ties").over(upto), F.lit(0)))
    last = keys.filter((F.col("__at") <= F.col("rest")) & (F.col("rest") < F.col("__at") + F.col("__ties")))
    last = last.select("__source", F.col("key").alias("last"), (F.col("rest") - F.col("__at")).alias("over"))
    cut = goal.join(small(last), F.col("source").eqNullSafe(F.col("__source")), "left")
    return cut.select("source", "source_size", "target", "epochs", "last", "over")


def _key(docs: DataFrame):
    return F.xxhash64("doc_id", "text"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _share(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """sized (source, size, key and others) with source_size, target, copies and taken.

    Rows that a budget ends in, one key for each source, are stored with the task that wrote them, and numbered in it after
    those of the tasks before: rows that are equal in all else are taken one after the other, in many tasks if many.
    """
    small = plan.count() <= SMALL
    plan = plan.withColumnRenamed("source", "__source")
    rows = sized.join(F.broadcast(plan) if small else plan, F.col("source").eqNullSafe(F.col("__source")))
    at_end = F.coalesce(F.col("key") == F.col("last"), F.lit(False))
    edge = stored(rows.filter(at_end).withColumn("__task", F.spark_partition_id()), "mix-edge")
    counts = edge.groupBy("__source", "__task").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__source").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("__source").alias("__s"), F.col("__task").alias("__t"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    edge = edge.withColumn("__i", F.row_number().over(Window.partitionBy("__source", "__task").orderBy("key")) - 1)
    edge = edge.join(counts, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__task") == F.col("__t")))
    left = F.col("over") - (F.col("__first") + F.col("__i")) * F.col("size")
    edge = edge.withColumn("__part", F.greatest(F.lit(0), F.least(left, F.col("size"))).cast("long")).drop("__task", "__i", "__s", "__t", "__first")
    early = F.coalesce(F.col("key") < F.col("last"), F.lit(False))
    rest = rows.filter(~at_end).withColumn("__part", F.when(early, F.col("size")).otherwise(0).cast("long"))
    both = rest.unionByName(edge)
    more = F.when(early | ((F.col("__part") > 0) & (2 * F.col("__part") >= F.col("size"))), 1).otherwise(0)
    both = both.withColumn("copies", F.col("epochs") + more).withColumn("taken", F.col("size") * F.col("epochs") + F.col("__part"))
    return both.drop("__source", "epochs", "last", "over", "__part", "key")


def taken(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of each row of docs; see mix(). Texts are read once."""
    key, size = _key(docs)
    sized = stored(docs.select("doc_id", "source", size.alias("size"), key.alias("key")), "mix-sizes")
    return _share(sized, stored(cuts(sized, weights, most), "mix-cuts"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """docs with size, source_size, target, taken (words) and copies (whole documents).

    The added columns replace columns of the same names. A document's key is a hash of doc_id and text, so reruns
    agree. Each epoch takes all documents of a source, the last one those before a cut; `taken` of the document that the
    budget ends in is the part before the cut, so a source's taken words are its target, rounded. `copies`
    counts that document if half of it is taken. Rows with equal doc_id and text share a key and are taken one after the
    other. Null texts have size 0, long texts count in full, null is a source. A source without words has
    target 0. An empty table gives an empty one. The table of sources is broadcast after its rows were counted, up to
    SMALL; beyond that the join is left to Spark.
    """
    clean = docs.drop("size", "source_size", "target", "copies", "taken")
    row = F.struct(*[F.col(f"`{c}`") for c in clean.columns]).alias("__row")
    key, size = _key(clean)
    sized = stored(clean.select("source", size.alias("size"), key.alias("key")), "mix-sizes")
    plan = stored(cuts(sized, weights, most), "mix-cuts")
    out = _share(clean.select(row, "source", size.alias("size"), key.alias("key")), plan)
    return out.select("__row.*", "size", "source_size", "target", "copies", "taken")


def mixed_rows(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """The mix itself: each document as many times as `copies` of mix() says, with the columns of docs."""
    out = mix(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "doc_id", "text", "source"), weights, most)
    out = out.filter(F.col("copies") > 0).select(F.explode(F.sequence(F.lit(1), F.col("copies"))), "__row")
    return out.select("__row.*")
