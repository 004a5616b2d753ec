"""From a file of predictions to a document of metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import events, metrics
from spanloom.sources import files


def with_events(rows: DataFrame, rules: events.OutcomeRules = events.OutcomeRules()) -> DataFrame:
    """Predictions with the events of both sides."""
    build = lambda labels: events.construct(F.col("tokens"), F.col(labels), rules)
    return rows.withColumn("gold_event", build("gold_labels")).withColumn("pred_event", build("pred_labels"))


def evaluate(spark: SparkSession, predictions: str, output: str | None = None, include_events: bool = True, timestamp: str = "") -> DataFrame:
    """One row of metadata, entity metrics and event metrics of a predictions file, written as JSON to `output` if given.

    Absent gold labels are all O. Without events the event metrics are null.
    """
    rows = files.predictions(spark, predictions)
    labels = rows.select(F.col("gold_labels").alias("gold"), F.col("pred_labels").alias("pred"))
    summary = metrics.event_summary(with_events(rows))
    if not include_events:
        keep = {"num_examples", "gold_events", "pred_events"}
        summary = summary.select(*[F.col(c) if c in keep else F.lit(None).cast("double").alias(c) for c in summary.columns])
    out = files.metrics_document(metrics.entity_micro(labels), metrics.entity_per_type(labels), summary, predictions, timestamp)
    if not include_events:
        out = out.withColumn("metadata", F.col("metadata").withField("include_events", F.lit(False)))
    if output:
        out.coalesce(1).write.mode("overwrite").json(output)
    return out
