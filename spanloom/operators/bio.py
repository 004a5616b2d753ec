"""Label sequences: repair, violations, and spans, as array expressions of one row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import let

SPAN = "array<struct<type:string,start:int,end:int>>"


def kind(label: Column) -> Column:
    """The part of a label after its first hyphen, '' if it has none."""
    return F.regexp_extract(label, r"(?s)^[^-]*-(.*)$", 1)


def repair(labels: Column, scheme: str = "BIO") -> Column:
    """Labels with orphan I- tags, tags without hyphen and unknown prefixes replaced by O, from left to right.

    An I- tag stays if the tag kept before it is a B- or I- tag of the same type; O-x stays. Other schemes than
    BIO leave the labels as they are.
    """
    if scheme != "BIO":
        return labels
    return let(labels, _repair)


def _runs(labels: Column) -> Column:
    """Where runs begin: every place but those that go on with I-x after B-x or I-x, or with O after O."""

    def begins(x: Column, i: Column) -> Column:
        before = F.get(labels, i - 1)
        goes_on = (before == x) | (before == F.concat(F.lit("B-"), F.substr(x, F.lit(3))))
        return F.when(x == "O", F.when(before == "O", F.lit(None)).otherwise(i)).when(~x.startswith("I-"), i).when(goes_on, F.lit(None)).otherwise(i)

    return F.array_compact(F.transform(labels, begins))


def _repair(labels: Column) -> Column:
    """Runs stay or go as a whole, by their first label: no array grows label by label."""

    def runs(starts: Column) -> Column:
        def run(s: Column, k: Column) -> Column:
            size = F.coalesce(F.get(starts, k + 1), F.size(labels)) - s
            keep = F.coalesce(F.get(labels, s).startswith("B-") | F.get(labels, s).startswith("O-"), F.lit(False))
            return F.when(keep, F.slice(labels, s + 1, size)).otherwise(F.array_repeat(F.lit("O"), size))

        return F.flatten(F.transform(starts, run))

    return let(_runs(labels), runs)


def violations(labels: Column) -> Column:
    """How many labels repair() changes."""
    return F.size(F.filter(F.zip_with(labels, repair(labels), lambda a, b: a != b), lambda x: x)).cast("long")


def spans(labels: Column, mode: str = "strict") -> Column:
    """Spans (type, start, end) by start; end is exclusive.

    strict: a span begins at a B- tag and goes on over the I- tags of its type; orphans belong to none. lenient:
    an I- tag after O or another type begins a span too.
    """
    return let(labels, lambda x: _spans(x, mode))


def _spans(labels: Column, mode: str) -> Column:
    """A span is a run that a B- tag begins, or, if lenient, an I- tag; it ends where the next run begins."""

    def found(starts: Column) -> Column:
        def span(s: Column, k: Column) -> Column:
            x = F.get(labels, s)
            opens = x.startswith("B-") if mode == "strict" else x.startswith("B-") | x.startswith("I-")
            end = F.coalesce(F.get(starts, k + 1), F.size(labels)).cast("int")
            return F.when(opens, F.struct(F.substr(x, F.lit(3)).alias("type"), s.alias("start"), end.alias("end")))

        return F.filter(F.transform(starts, span), lambda x: x.isNotNull())

    return let(_runs(labels), found)


def span_text(tokens: Column, span: Column) -> Column:
    return F.array_join(F.slice(tokens, span["start"] + 1, span["end"] - span["start"]), " ")


def repair_rows(rows: DataFrame, key: str, pos: str, label: str, out: str = "fixed") -> DataFrame:
    """repair() for long sequences held as one row a token, by windows over (key, pos), all of one order.

    A run is an I- tag's stretch of equal type; it stays if it is headed by a B- tag.
    """
    w = Window.partitionBy(key).orderBy(pos)
    x, before = F.col(label), F.lag(label).over(w)
    joins = x.startswith("I-") & ((before == x) | (before == F.concat(F.lit("B-"), F.substr(x, F.lit(3)))))
    begun = F.when(~F.coalesce(joins, F.lit(False)), F.coalesce(x.startswith("B-"), F.lit(False)))
    headed = rows.withColumn("__begun", begun)
    head = F.last("__begun", ignorenulls=True).over(w)
    keep = F.when(x.startswith("B-") | x.startswith("O-") | (x.startswith("I-") & head), x).otherwise("O")
    return headed.withColumn(out, keep).drop("__begun")


def validate(rows: DataFrame, tokens: str = "tokens", labels: str = "labels") -> DataFrame:
    """rows with `reason`: null for a valid record, else what is wrong with it."""
    t, l = F.col(tokens), F.col(labels)  # noqa: E741
    reason = F.when(t.isNull() | l.isNull(), "missing field").when(F.size(t) != F.size(l), "length mismatch").when(F.size(t) == 0, "empty")
    return rows.withColumn("reason", reason)
