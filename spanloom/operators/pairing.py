"""Predictions and gold brought together by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair(pred: DataFrame, gold: DataFrame, key: str = "id", how: str = "inner") -> DataFrame:
    """key, and the rows of both sides as structs `pred` and `gold`.

    how: `inner` leaves out ids that one side lacks, `full` keeps them with a null struct, `strict` fails the query
    on them and on ids that a side has more than once. Otherwise repeated ids meet each other, all with all. Null ids match
    nothing. One shuffle by id; the counts of `strict` use the same partitioning.
    """
    if how not in ("inner", "full", "strict"):
        raise ValueError(f"how is inner, full or strict, not {how!r}")

    def side(rows: DataFrame, name: str) -> DataFrame:
        own = rows.select(F.col(key).alias(f"__{name}"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias(name))
        if how == "strict":
            own = own.withColumn(f"__n_{name}", F.count(F.lit(1)).over(Window.partitionBy(f"__{name}")))
        return own

    p, g = side(pred, "pred"), side(gold, "gold")
    both = p.join(g, F.col("__pred") == F.col("__gold"), "inner" if how == "inner" else "full")
    name = F.coalesce("__pred", "__gold")
    if how == "strict":
        wrong = F.col("pred").isNull() | F.col("gold").isNull() | (F.col("__n_pred") > 1) | (F.col("__n_gold") > 1)
        said = F.concat(F.lit("predictions and gold differ at id "), F.coalesce(name.cast("string"), F.lit("null")))
        name = F.when(~wrong, name).otherwise(F.raise_error(said).cast(pred.schema[key].dataType))
    return both.select(name.alias(key), "pred", "gold")


def differences(pred: DataFrame, gold: DataFrame, key: str = "id") -> DataFrame:
    """Ids that are not in both sides once: key, n_pred and n_gold. Null ids count as others."""
    each = lambda rows, a, b: rows.select(F.col(key).alias(key), F.lit(a).alias("p"), F.lit(b).alias("g"))
    counts = each(pred, 1, 0).unionByName(each(gold, 0, 1)).groupBy(key).agg(F.sum("p").alias("n_pred"), F.sum("g").alias("n_gold"))
    return counts.filter("n_pred <> 1 OR n_gold <> 1")


def union(*splits: DataFrame) -> DataFrame:
    """All rows of some splits, columns matched by name; a column that a split lacks is null there."""
    out = splits[0]
    for s in splits[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out
