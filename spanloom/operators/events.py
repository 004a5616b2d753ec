"""Events: one nested record for each segment, assembled from its spans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.text import let
from spanloom.operators import bio

EVENT = (
    "struct<subject:string,participants:array<struct<text:string,position:string>>,"
    "counting:array<struct<text:string,type:string>>,voting_expressions:array<string>,outcome:string>"
)


@dataclass(frozen=True)
class OutcomeRules:
    """Patterns and stems of the outcome rules, in lower case.

    Fixed values: the stems and the bodies whose vote in favour decides have to be these for right results.
    """

    bodies: tuple[str, ...] = (r"(?U)\bcâmara\b", r"(?U)\bexecutivo\s+(\w+\s+)?municipal\b")
    approved: tuple[str, ...] = ("aprovad", "deliberad", "deferido", "autorizado", "ratificad", "homologad", "sancionad", "concordad")
    rejected: tuple[str, ...] = ("rejeitad", "indeferido", "recusad", "negad", "chumbad", "não aprovad", "não deferido")
    unanimous: tuple[str, ...] = ("unanimity", "unanimidade")


def has_event(labels: Column, prefix: str = "B-VOTING") -> Column:
    return F.exists(labels, lambda x: x.startswith(prefix))


def of_type(spans: Column, type_: str) -> Column:
    return F.filter(spans, lambda s: s["type"] == type_)


def family(tokens: Column, spans: Column, prefix: str, name: str) -> Column:
    """Texts of the spans whose type begins with a prefix, with the rest of the type in title case."""
    own = F.filter(spans, lambda s: s["type"].startswith(prefix))
    return F.transform(own, lambda s: F.struct(bio.span_text(tokens, s).alias("text"), F.initcap(F.substr(s["type"], F.lit(len(prefix) + 1))).alias(name)))


def subject(tokens: Column, spans: Column) -> Column:
    first = F.get(of_type(spans, "SUBJECT"), F.lit(0))
    return let(first, lambda s: F.when(s.isNotNull(), bio.span_text(tokens, s)))


def participants(tokens: Column, spans: Column) -> Column:
    return family(tokens, spans, "VOTER-", "position")


def counting(tokens: Column, spans: Column) -> Column:
    return family(tokens, spans, "COUNTING-", "type")


def expressions(tokens: Column, spans: Column) -> Column:
    return F.transform(of_type(spans, "VOTING"), lambda s: bio.span_text(tokens, s))


def outcome(said: Column, counts: Column, voters: Column, rules: OutcomeRules = OutcomeRules()) -> Column:
    """Approved, Rejected or null; the first rule that decides counts.

    A named body in favour; the first expression with a rejecting or else an approving stem; a unanimous count;
    more voters in favour than against, or fewer.
    """

    def has(text: Column, stems: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for stem in stems:
            out = out | F.contains(F.lower(text), F.lit(stem))
        return out

    def body(p: Column) -> Column:
        out = F.lit(False)
        for pattern in rules.bodies:
            out = out | F.lower(p["text"]).rlike(pattern)
        return (p["position"] == "Favor") & out

    first = F.try_element_at(F.filter(said, lambda e: has(e, rules.rejected) | has(e, rules.approved)), F.lit(1))
    votes = lambda position: F.size(F.filter(voters, lambda p: p["position"] == position))
    return (
        F.when((F.size(said) == 0) & (F.size(counts) == 0) & (F.size(voters) == 0), F.lit(None).cast("string"))
        .when(F.exists(voters, body), "Approved")
        .when(first.isNotNull(), F.when(has(first, rules.rejected), "Rejected").otherwise("Approved"))
        .when(F.exists(counts, lambda c: F.lower(c["type"]).isin(*rules.unanimous)), "Approved")
        .when(votes("Favor") > votes("Against"), "Approved")
        .when(votes("Favor") < votes("Against"), "Rejected")
    )


def construct(tokens: Column, labels: Column, rules: OutcomeRules = OutcomeRules()) -> Column:
    """The event of a segment; null where no label begins a voting expression."""

    def parts(spans: Column) -> Column:
        return F.struct(
            subject(tokens, spans).alias("subject"),
            participants(tokens, spans).alias("participants"),
            counting(tokens, spans).alias("counting"),
            expressions(tokens, spans).alias("voting_expressions"),
        )

    def whole(e: Column) -> Column:
        said = outcome(e["voting_expressions"], e["counting"], e["participants"], rules)
        return F.struct(*[e[n].alias(n) for n in ("subject", "participants", "counting", "voting_expressions")], said.alias("outcome"))

    return let(labels, lambda x: F.when(has_event(x), let(let(bio.spans(x), parts), whole)))
