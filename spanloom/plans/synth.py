"""Segments with gold and predicted labels made from documents, by whole-number arithmetic alone.

Each document is cut into segments of 32 tokens, each of four blocks of eight. A block may hold a span; the
predicted labels are the gold ones with some lost, some wrong, some malformed. Nothing is shuffled: a segment is
made, labelled and scored in the task that read its document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import bio

TYPES = ("VOTING", "SUBJECT", "VOTER-FAVOR", "COUNTING-UNANIMITY", "VOTER-ABSTENTION", "COUNTING-MAJORITY", "VOTER-AGAINST", "VOTER-ABSENT")
SIZE = 32
#: Segments that a document can have: texts of 33 million tokens.
MOST = 1 << 20
_LIST = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows in as many partitions as there are cores at least. Only an input of very few row groups is dealt anew."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _labels(seg: Column, size: Column) -> tuple[Column, Column]:
    """Gold and predicted labels of a segment of `size` tokens.

    A block's gold labels are one of 48 lists, taken as a whole; of the predicted labels only those that change are worked out.
    A quotient by d that is taken modulo m is read off the number modulo d * m.
    """
    none = [["O"] * 8] * 4
    spans = [[[f"B-{t}", *[f"I-{t}"] * w, *["O"] * (7 - w)] for w in range(4)] for t in TYPES]
    blocks = F.array(*[F.array(*map(F.lit, x)) for t in [*spans, *[none] * 4] for x in t])
    begun, inside = (F.array(*[F.lit(f"{c}-{t}") for t in TYPES]) for c in "BI")
    t = lambda b: F.floor(((seg % 2147483647 * 4 + b) * 48271 % 2147483647 % 84) / 7)
    block = lambda b: F.get(blocks, (t(b) * 4 + (seg + b) % 4).cast("int"))
    gold = F.slice(F.flatten(F.array(*[block(b) for b in range(SIZE // 8)])), F.lit(1), size)

    def predicted(g: Column) -> Column:
        def pred(x: Column, p: Column) -> Column:
            r = (g["r"] + p * F.lit(69621).cast("long")) % 2147483647 % 319
            b = F.floor(p / 8).cast("long")
            return (
                F.when(r >= 44, x)
                .when(r < 11, "O")
                .when(r < 22, F.get(inside, ((t(b) + 1) % 8).cast("int")))
                .when(r < 33, "BAD")
                .when(p % 8 >= 5, F.get(begun, ((seg + b) % 8).cast("int")))
                .otherwise(x)
            )

        return F.transform(g["gold"], pred)

    return gold, T.let(F.struct(gold.alias("gold"), (seg % 2147483647 * 32 * 69621).alias("r")), predicted)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seg, tokens, gold and pred. seg is a document's number times MOST, plus the segment's own."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def cut(ts: Column) -> Column:
        many = F.ceil(F.size(ts) / SIZE).cast("int")
        return F.transform(F.slice(F.sequence(F.lit(0), many), 1, many), lambda s: F.struct(s.alias("s"), F.slice(ts, s * SIZE + 1, SIZE).alias("tokens")))

    rows = docs.select("doc_id", F.explode(T.let(T.tokens(F.col("text")), cut)).alias("x"))
    rows = rows.select("doc_id", (F.col("doc_id") * MOST + F.col("x.s")).cast("long").alias("seg"), F.col("x.tokens").alias("tokens"))
    gold, pred = _labels(F.col("seg"), F.size("tokens"))
    return rows.select("doc_id", "seg", "tokens", gold.alias("gold"), pred.alias("pred"))


def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).withColumn("fixed", bio.repair(F.col("pred")))


#: The same as SQL, one row a token: seg, p, token, gold, pred; `fix` adds the repaired label.
SQL_TOKENS = f"""
tk AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda x: x <> '') AS ts FROM documents),
wd AS (SELECT doc_id, unnest(ts) AS token, generate_subscripts(ts, 1) - 1 AS pos FROM tk),
aa AS (SELECT doc_id * {MOST} + pos // 32 AS seg, CAST(pos % 32 AS BIGINT) AS p, token FROM wd),
bb AS (SELECT *, p // 8 AS b, p % 8 AS o, ((seg % 2147483647 * 4 + p // 8) * 48271 % 2147483647) // 7 % 12 AS t,
         ((seg % 2147483647 * 32 + p) * 69621 % 2147483647) // 11 % 29 AS r FROM aa),
gg AS (SELECT *, CASE WHEN t >= 8 OR o >= 1 + (seg + b) % 4 THEN 'O' WHEN o = 0 THEN 'B-' || ({_LIST})[t + 1] ELSE 'I-' || ({_LIST})[t + 1] END AS gold FROM bb),
lab AS (SELECT seg, p, token, gold, CASE WHEN r = 0 THEN 'O' WHEN r = 1 THEN 'I-' || ({_LIST})[(t + 1) % 8 + 1] WHEN r = 2 THEN 'BAD'
         WHEN r = 3 AND o >= 5 THEN 'B-' || ({_LIST})[(seg + b) % 8 + 1] ELSE gold END AS pred FROM gg)"""

SQL_FIXED = (
    SQL_TOKENS
    + """,
f1 AS (SELECT *, coalesce(pred LIKE 'I-%' AND lag(pred) OVER w SIMILAR TO '[BI]-.*' AND substr(lag(pred) OVER w, 3) = substr(pred, 3), false) AS cont
       FROM lab WINDOW w AS (PARTITION BY seg ORDER BY p)),
f2 AS (SELECT *, sum(CASE WHEN cont THEN 0 ELSE 1 END) OVER (PARTITION BY seg ORDER BY p) AS run FROM f1),
f3 AS (SELECT *, first_value(pred) OVER (PARTITION BY seg, run ORDER BY p) AS head FROM f2),
fix AS (SELECT seg, p, token, gold, pred, CASE WHEN pred LIKE 'B-%' OR pred LIKE 'O-%' OR (pred LIKE 'I-%' AND head LIKE 'B-%') THEN pred ELSE 'O' END AS fixed FROM f3)"""
)


def _sql_spans(name: str, label: str, source: str, lenient: bool) -> str:
    begins = f"{label} LIKE 'B-%'" + (f" OR ({label} LIKE 'I-%' AND NOT cont)" if lenient else "")
    keep = "head LIKE 'B-%' OR head LIKE 'I-%'" if lenient else "head LIKE 'B-%'"
    return f""",
{name}1 AS (SELECT seg, p, token, {label}, coalesce({label} LIKE 'I-%' AND lag({label}) OVER w SIMILAR TO '[BI]-.*' AND substr(lag({label}) OVER w, 3) = substr({label}, 3), false) AS cont
       FROM {source} WINDOW w AS (PARTITION BY seg ORDER BY p)),
{name}2 AS (SELECT *, sum(CASE WHEN cont THEN 0 ELSE 1 END) OVER (PARTITION BY seg ORDER BY p) AS run FROM {name}1),
{name}3 AS (SELECT seg, run, first({label} ORDER BY p) AS head, min(p) AS st, max(p) + 1 AS en, string_agg(token, ' ' ORDER BY p) AS txt FROM {name}2 GROUP BY seg, run),
{name} AS (SELECT seg, substr(head, 3) AS type, st, en, txt FROM {name}3 WHERE {keep})"""


def sql_spans(name: str, label: str, source: str = "lab", lenient: bool = False) -> str:
    """Spans (seg, type, st, en, txt) of a label column of a table that came before."""
    return _sql_spans(name, label, source, lenient)


#: One row a segment: flags, subjects, first countings, sorted participant pairs, expressions of both sides.
SQL_EVENTS = (
    SQL_FIXED
    + sql_spans("gs", "gold", "fix")
    + sql_spans("ps", "fixed", "fix")
    + """,
sg AS (SELECT DISTINCT seg FROM fix),"""
    + ",".join(
        f"""
{s}e AS (SELECT seg, bool_or(type = 'VOTING') AS has, min_by(txt, st) FILTER (type = 'SUBJECT') AS subject,
   list({{'text': txt, 'position': upper(substr(type, 7, 1)) || lower(substr(type, 8))}} ORDER BY st) FILTER (type LIKE 'VOTER-%') AS participants,
   list({{'text': txt, 'type': upper(substr(type, 10, 1)) || lower(substr(type, 11))}} ORDER BY st) FILTER (type LIKE 'COUNTING-%') AS counting,
   list(txt ORDER BY st) FILTER (type = 'VOTING') AS voting FROM {s}s GROUP BY seg)"""
        for s in ("g", "p")
    )
    + """,
ev AS (SELECT seg, coalesce(ge.has, false) AS g, coalesce(pe.has, false) AS p,
   CASE WHEN ge.has THEN ge.subject END AS gsub, CASE WHEN pe.has THEN pe.subject END AS psub,
   CASE WHEN ge.has THEN coalesce(ge.participants, []) ELSE [] END AS gpart, CASE WHEN pe.has THEN coalesce(pe.participants, []) ELSE [] END AS ppart,
   CASE WHEN ge.has THEN coalesce(ge.counting, []) ELSE [] END AS gcnt, CASE WHEN pe.has THEN coalesce(pe.counting, []) ELSE [] END AS pcnt,
   CASE WHEN ge.has THEN ge.voting END AS gvot, CASE WHEN pe.has THEN pe.voting END AS pvot
   FROM sg LEFT JOIN ge USING (seg) LEFT JOIN pe USING (seg))"""
)
