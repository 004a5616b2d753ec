"""The operators of single segments over streams. They hold no state, so they are the same expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import bio, events
from spanloom.sources.files import SEGMENTS


def read(spark: SparkSession, path: str) -> DataFrame:
    """A stream of segments from JSON lines files that appear in a folder."""
    return spark.readStream.schema(SEGMENTS).json(path)


def events_of(stream: DataFrame, rules: events.OutcomeRules = events.OutcomeRules()) -> DataFrame:
    """id, has_voting_event and event of each valid segment."""
    valid = bio.validate(stream).filter("reason IS NULL")
    labels = bio.repair(F.col("labels"))
    return valid.select("id", events.has_event(labels).alias("has_voting_event"), events.construct(F.col("tokens"), labels, rules).alias("event"))
