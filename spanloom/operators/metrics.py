"""Precision, recall and F1: entities, events, and soft overlap of events. One pass each, with sums before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import bio


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [F.round(x, 6).alias(n) for n, x in (("precision", p), ("recall", r), ("f1", ratio(2 * p * r, p + r)))]


def confusion(rows: DataFrame, tp: Column, fp: Column, fn: Column) -> DataFrame:
    """tp, fp, fn and their scores, of three conditions on rows; an empty table gives zeros."""
    counts = rows.agg(F.count_if(tp).alias("tp"), F.count_if(fp).alias("fp"), F.count_if(fn).alias("fn"))
    return counts.select("tp", "fp", "fn", *scores(F.col("tp"), F.col("fp"), F.col("fn")))


# entities


def entity_rows(rows: DataFrame, gold: str = "gold", pred: str = "pred", mode: str = "lenient") -> DataFrame:
    """type, tp, fp and fn of each span, compared within its row by (type, start, end)."""
    g, p = bio.spans(F.col(gold), mode), bio.spans(F.col(pred), mode)

    def tagged(s: Column) -> Column:
        mark = lambda spans, hit: F.transform(spans, lambda x: F.struct(x["type"].alias("type"), F.lit(hit).alias("hit")))
        return F.concat(mark(F.array_intersect(s["g"], s["p"]), "tp"), mark(F.array_except(s["p"], s["g"]), "fp"), mark(F.array_except(s["g"], s["p"]), "fn"))

    return rows.select(F.inline(T.let(F.struct(g.alias("g"), p.alias("p")), tagged)))


def entity_micro(rows: DataFrame, **how) -> DataFrame:
    hit = F.col("hit")
    return confusion(entity_rows(rows, **how), hit == "tp", hit == "fp", hit == "fn")


def entity_per_type(rows: DataFrame, **how) -> DataFrame:
    hit = F.col("hit")
    by = entity_rows(rows, **how).groupBy("type").agg(F.count_if(hit == "tp").alias("tp"), F.count_if(hit == "fp").alias("fp"), F.count_if(hit == "fn").alias("fn"))
    return by.select("type", *scores(F.col("tp"), F.col("fp"), F.col("fn")), (F.col("tp") + F.col("fn")).alias("support"))


def entity_levels(rows: DataFrame, **how) -> DataFrame:
    """Scores of each type and, with a null type, of all together, from one pass."""
    hit = F.col("hit")
    by = entity_rows(rows, **how).rollup("type").agg(F.count_if(hit == "tp").alias("tp"), F.count_if(hit == "fp").alias("fp"), F.count_if(hit == "fn").alias("fn"))
    return by.select("type", "tp", "fp", "fn", *scores(F.col("tp"), F.col("fp"), F.col("fn")), (F.col("tp") + F.col("fn")).alias("support"))


def token_accuracy(rows: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    same = F.size(F.filter(F.zip_with(gold, pred, lambda a, b: a == b), lambda x: x))
    total = rows.agg(F.sum(same).alias("same"), F.sum(F.size(gold)).alias("tokens"))
    return total.select(F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), F.round(ratio(F.col("same"), F.col("tokens")), 6).alias("accuracy"))


# events: rows have structs `gold_event` and `pred_event`, null where there is none


def _has(side: str) -> Column:
    return F.col(f"{side}_event").isNotNull()


def _field(side: str, name: str) -> Column:
    return F.col(f"{side}_event")[name]


def detection(rows: DataFrame) -> DataFrame:
    g, p = _has("gold"), _has("pred")
    return confusion(rows, g & p, ~g & p, g & ~p)


def _verdict(gold: Column, pred: Column, has_gold: Column, has_pred: Column, mismatch: str) -> tuple[Column, Column, Column]:
    """TP, FP, FN of one component. mismatch: a wrong answer counts as FP alone ('fp', as in the published
    figures), or as FP and FN ('both')."""
    equal = gold == pred
    wrong = has_pred & ~equal
    lost = has_gold & ~has_pred & ~equal if mismatch == "fp" else has_gold & ~equal
    return has_gold & has_pred & equal, wrong, lost


def subject_f1(rows: DataFrame, mismatch: str = "fp") -> DataFrame:
    """Over segments with a gold event: the subjects' texts, stripped and in lower case."""
    g, p = T.strict(_field("gold", "subject")), T.strict(_field("pred", "subject"))
    return confusion(rows.filter(_has("gold")), *_verdict(g, p, g != "", p != "", mismatch))


def first_count(side: str) -> Column:
    """The first counting's text and type as one comparable string; null without."""
    c = F.try_element_at(_field(side, "counting"), F.lit(1))
    return F.when(c.isNotNull(), F.concat_ws("\x01", T.strict(c["text"]), F.upper(T.strip(c["type"]))))


def counting_f1(rows: DataFrame, mismatch: str = "fp") -> DataFrame:
    """Over segments with a gold event: text and type of the first counting; segments where neither has one are left out."""
    g, p = F.coalesce(first_count("gold"), F.lit("")), F.coalesce(first_count("pred"), F.lit(""))
    return confusion(rows.filter(_has("gold")), *_verdict(g, p, g != "", p != "", mismatch))


def pairs(side: str) -> Column:
    """Distinct (text, position) pairs of the participants."""
    every = F.coalesce(_field(side, "participants"), F.array().cast("array<struct<text:string,position:string>>"))
    keyed = F.transform(every, lambda p: F.struct(T.strict(p["text"]).alias("a"), F.upper(T.strip(p["position"])).alias("b")))
    return F.array_distinct(F.filter(keyed, lambda p: (p["a"] != "") & (p["b"] != "")))


def participant_f1(rows: DataFrame) -> DataFrame:
    """Mean precision, recall and F1 over segments with a gold event; both empty count as 1."""
    sets = rows.filter(_has("gold")).select(pairs("gold").alias("g"), pairs("pred").alias("p"))
    both = F.size(F.array_intersect("g", "p"))
    none = (F.size("g") == 0) & (F.size("p") == 0)
    p, r = F.when(none, 1.0).otherwise(ratio(both, F.size("p"))), F.when(none, 1.0).otherwise(ratio(both, F.size("g")))
    each = sets.select(p.alias("p"), r.alias("r"), ratio(2 * p * r, p + r).alias("f"))
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return each.agg(mean("p").alias("precision"), mean("r").alias("recall"), mean("f").alias("f1"), F.count(F.lit(1)).alias("segments"))


def complete(rows: DataFrame) -> DataFrame:
    """`verdict` of each row: true_negative, false_positive, missed, subject, participants, counting (the first
    component that differs) or true_positive."""
    g, p = _has("gold"), _has("pred")
    # a blank subject is not the same as none
    subj = lambda s: F.when(F.coalesce(_field(s, "subject"), F.lit("")) != "", T.strict(_field(s, "subject")))
    verdict = (
        F.when(~g, F.when(p, "false_positive").otherwise("true_negative"))
        .when(~p, "missed")
        .when(~subj("gold").eqNullSafe(subj("pred")), "subject")
        .when(F.array_sort(pairs("gold")) != F.array_sort(pairs("pred")), "participants")
        .when(~first_count("gold").eqNullSafe(first_count("pred")), "counting")
        .otherwise("true_positive")
    )
    return rows.withColumn("verdict", verdict)


def complete_f1(rows: DataFrame) -> DataFrame:
    """A predicted event that differs in some part counts as FN alone."""
    v = F.col("verdict")
    return confusion(complete(rows), v == "true_positive", v == "false_positive", v.isin("missed", "subject", "participants", "counting"))


def complete_failures(rows: DataFrame) -> DataFrame:
    return complete(rows).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def event_summary(rows: DataFrame, mismatch: str = "fp") -> DataFrame:
    """The five F1 values and the event counts in one row, from one pass over rows."""
    g, p = _has("gold"), _has("pred")
    sg, sp = T.strict(_field("gold", "subject")), T.strict(_field("pred", "subject"))
    cg, cp = F.coalesce(first_count("gold"), F.lit("")), F.coalesce(first_count("pred"), F.lit(""))
    v = F.col("verdict")
    parts = {
        "event_detection_f1": (g & p, ~g & p, g & ~p),
        "subject_f1": tuple(g & c for c in _verdict(sg, sp, sg != "", sp != "", mismatch)),
        "counting_f1": tuple(g & c for c in _verdict(cg, cp, cg != "", cp != "", mismatch)),
        "complete_event_f1": (v == "true_positive", v == "false_positive", v.isin("missed", "subject", "participants", "counting")),
    }
    sets = complete(rows).withColumn("__pg", pairs("gold")).withColumn("__pp", pairs("pred"))
    both, none = F.size(F.array_intersect("__pg", "__pp")), (F.size("__pg") == 0) & (F.size("__pp") == 0)
    pr, re = ratio(both, F.size("__pp")), ratio(both, F.size("__pg"))
    voters = F.when(none, 1.0).otherwise(ratio(2 * pr * re, pr + re))
    sums = [F.count_if(c).alias(f"__{n}{k}") for n, three in parts.items() for k, c in enumerate(three)]
    one = sets.agg(*sums, F.coalesce(F.avg(F.when(g, voters)), F.lit(0.0)).alias("__v"), F.count_if(g).alias("gold_events"), F.count_if(p).alias("pred_events"), F.count(F.lit(1)).alias("num_examples"))
    f1 = [scores(*(F.col(f"__{n}{k}") for k in range(3)))[2].alias(n) for n in parts]
    return one.select("num_examples", "gold_events", "pred_events", *f1, F.round("__v", 6).alias("participant_vote_f1"))


# soft overlap


def soft(rows: DataFrame) -> DataFrame:
    """rows with scores subject, voting_expression, counting, participants and overall of the predicted event.

    Different flags score 0, two absent events 1. Participants: the share of gold ones for which some predicted
    one of the same position overlaps by half; one prediction may serve several. overall is the mean of the
    components with a score or with gold content; the expression counts only with a score.
    """
    g, p = _has("gold"), _has("pred")
    both = g & p

    def overlap(a: Column, b: Column) -> Column:
        present = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
        return F.when(present, T.jaccard(a, b)).otherwise(0.0)

    first = lambda s, n: F.try_element_at(_field(s, n), F.lit(1))
    counted = first("gold", "counting").isNotNull() & first("pred", "counting").isNotNull() & (first("gold", "counting")["type"] == first("pred", "counting")["type"])
    count = F.when(counted, T.jaccard(first("pred", "counting")["text"], first("gold", "counting")["text"])).otherwise(0.0)
    found = F.filter(_field("gold", "participants"), lambda x: F.exists(_field("pred", "participants"), lambda y: (y["position"] == x["position"]) & (T.jaccard(y["text"], x["text"]) >= 0.5)))
    voters = ratio(F.size(found), F.size(_field("gold", "participants")))
    parts = {
        "subject": (overlap(_field("pred", "subject"), _field("gold", "subject")), F.coalesce(_field("gold", "subject"), F.lit("")) != ""),
        "participants": (voters, F.size(_field("gold", "participants")) > 0),
        "counting": (count, F.size(_field("gold", "counting")) > 0),
        "voting_expression": (overlap(first("pred", "voting_expressions"), first("gold", "voting_expressions")), F.lit(False)),
    }
    out = rows
    for n, (value, _) in parts.items():
        out = out.withColumn(n, F.when(both, value).when(~g & ~p, 1.0).otherwise(0.0))
    used = [(F.col(n) > 0) | has for n, (_, has) in parts.items()]
    total = sum((F.when(u, F.col(n)).otherwise(0.0) for n, u in zip(parts, used, strict=True)), F.lit(0.0))
    size = sum((F.when(u, 1).otherwise(0) for u in used), F.lit(0))
    return out.withColumn("overall", F.when(both, ratio(total, size)).when(~g & ~p, 1.0).otherwise(0.0))


def soft_metrics(rows: DataFrame) -> DataFrame:
    """Bands of the overall score: correct from 0.95 on, partial from 0.5 on, else missed or spurious by the flags.

    As in the published figures, correct holds segments without events too, so precision and recall can pass 1.
    """
    o = F.col("overall")
    g, p = _has("gold"), _has("pred")
    c = soft(rows).agg(
        F.count_if(o >= 0.95).alias("correct"),
        F.count_if((o < 0.95) & (o >= 0.5)).alias("partial"),
        F.count_if((o < 0.5) & g & ~p).alias("missed"),
        F.count_if((o < 0.5) & ~g & p).alias("spurious"),
        F.count_if(g).alias("__g"),
        F.count_if(p).alias("__p"),
        F.count(F.lit(1)).alias("__n"),
    )
    pr, re = ratio(F.col("correct"), F.col("__p")), ratio(F.col("correct"), F.col("__g"))
    return c.select("correct", "partial", "missed", "spurious", (F.col("__n") - F.col("correct") - F.col("partial")).alias("incorrect"), F.round(pr, 6).alias("precision"), F.round(re, 6).alias("recall"), F.round(ratio(2 * pr * re, pr + re), 6).alias("f1"))
