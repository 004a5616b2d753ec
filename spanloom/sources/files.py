"""Readers and writers of segments, predictions, events and metrics. Schemas are given, never inferred."""

from __future__ import annotations

import json
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanloom.operators import bio

SEGMENTS = "id string, text string, tokens array<string>, labels array<string>, municipality string"
PREDICTIONS = "id string, tokens array<string>, pred_labels array<string>, gold_labels array<string>"
EVENTS = (
    "id string, has_voting_event boolean, event struct<subject:string,participants:array<struct<text:string,position:string>>,"
    "counting:array<struct<text:string,type:string>>,voting_expressions:array<string>,outcome:string>"
)
BAD = "_bad"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir), deleted with the session.

    A session on one machine that names none gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = Path(tempfile.mkdtemp(prefix="spanloom-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", base)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, on any file system that Spark writes to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def json_rows(spark: SparkSession, path: str, schema: str, strict: bool = False, array: bool = False) -> DataFrame:
    """Records of a JSON lines file, or of a file that is one document (array).

    strict: a record that is no JSON fails the query; else it is left out (arrays.with_rejects() keeps it). A path that does not
    exist gives no rows. Lines are read in parallel, as are arrays; another document is one task's work.
    """
    from spanloom.sources import arrays

    kind = StructType.fromDDL(schema)
    if array and exists(spark, path) and is_array(spark, path):
        return arrays.array_rows(spark, path, schema, strict)
    if not exists(spark, path):
        return spark.createDataFrame([], kind)
    reader = spark.read.option("multiLine", array)
    if strict:
        return reader.schema(kind).option("mode", "FAILFAST").json(path)
    rows = reader.schema(kind.add(BAD, "string")).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)
    return rows.filter(F.col(BAD).isNull()).drop(BAD)


def is_array(spark: SparkSession, path: str) -> bool:
    """Whether a file begins with [. Arrays can be one long line, so it is read in pieces."""
    bare = F.regexp_replace("value", r"^\s+", "")
    first = spark.read.option("lineSep", "}").text(path).select(F.substring(bare, 1, 1).alias("c")).filter("c <> ''").first()
    return first is not None and first[0] == "["


def segments(spark: SparkSession, path: str, repaired: bool = True) -> DataFrame:
    """Valid segments of a JSON lines file, their labels repaired."""
    rows = bio.validate(json_rows(spark, path, SEGMENTS)).filter("reason IS NULL AND id IS NOT NULL").drop("reason")
    return rows.withColumn("labels", bio.repair(F.col("labels"))) if repaired else rows


def labelled(spark: SparkSession, path: str) -> DataFrame:
    """Segments that have tokens and labels, as they are."""
    return json_rows(spark, path, SEGMENTS).filter("tokens IS NOT NULL AND labels IS NOT NULL")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of an array or JSON lines file; a missing field fails the query. Absent gold labels are all O."""
    rows = json_rows(spark, path, PREDICTIONS, strict=True, array=is_array(spark, path))
    for c in ("id", "tokens", "pred_labels"):
        rows = rows.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"missing field {c}")).cast(rows.schema[c].dataType)))
    return rows.withColumn("gold_labels", F.coalesce("gold_labels", F.array_repeat(F.lit("O"), F.size("pred_labels"))))


def events(spark: SparkSession, path: str) -> DataFrame:
    """Events of a .json array file, or of JSON lines under any other name."""
    return json_rows(spark, path, EVENTS, array=path.endswith(".json"))


def examples(spark: SparkSession, path: str) -> DataFrame:
    """The entries of `examples` of a JSON document."""
    rows = json_rows(spark, path, f"examples array<struct<{SEGMENTS.replace(' ', ':').replace(',:', ',')}>>", array=True)
    return rows.select(F.inline("examples"))


def first_rows(rows: DataFrame, n: int, order: str = "id") -> DataFrame:
    """The first n rows in a stated order."""
    return rows.orderBy(order).limit(n)


def write_json(rows: DataFrame, path: str, order: str | None = None) -> None:
    """JSON lines, one file for each partition, range-sorted over all by `order` if given."""
    (rows.orderBy(order) if order else rows).write.mode("overwrite").json(path)


def write_array(rows: DataFrame, path: str, order: str) -> None:
    """One JSON array in one text file, written row by row."""
    from spanloom.sources import arrays

    arrays.write_array(rows, path, order)


def metrics_document(entity: DataFrame, per_type: DataFrame, summary: DataFrame, source: str, timestamp: str) -> DataFrame:
    """One row with metadata, entity_level_metrics and event_level_metrics, from one-row results."""
    types = per_type.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", F.struct("precision", "recall", F.col("f1").alias("f1_score"), "support"))))).alias("per_type_metrics"))
    e, s = entity.withColumn("k", F.lit(1)), summary.withColumn("k", F.lit(1))
    row = e.join(types.withColumn("k", F.lit(1)), "k").join(s, "k")
    return row.select(
        F.struct(F.lit(source).alias("predictions_file"), F.lit(timestamp).alias("timestamp"), F.col("num_examples").cast("int").alias("num_examples"), F.lit(True).alias("include_events")).alias("metadata"),
        F.struct("precision", "recall", "f1", "per_type_metrics").alias("entity_level_metrics"),
        F.struct("event_detection_f1", "subject_f1", "counting_f1", "participant_vote_f1", "complete_event_f1").alias("event_level_metrics"),
    )


def config(path: str) -> dict:
    """A YAML run configuration; numbers in exponent form without a point are numbers too."""
    import re

    import yaml

    def numbers(x):
        if isinstance(x, dict):
            return {k: numbers(v) for k, v in x.items()}
        if isinstance(x, list):
            return [numbers(v) for v in x]
        return float(x) if isinstance(x, str) and re.fullmatch(r"[+-]?\d+(\.\d*)?[eE][+-]?\d+", x) else x

    return numbers(yaml.safe_load(Path(path).read_text())) or {}


def config_path(root: str, name: str, kind: str = "main_experiment") -> Path:
    """The place of a named run configuration."""
    return Path(root) / "configs" / kind / f"{name}.yaml"


def extraction_config(instructions: str, examples: str | None = None, use: int = 10, language: str = "pt") -> dict:
    """Instructions and the first examples of a JSON file; without the file there are none."""
    listed = json.loads(Path(examples).read_text()) if examples and Path(examples).exists() else []
    return {"system_prompt": instructions, "examples": listed[:use], "output_format": "json", "language": language}


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """A vocabulary (word and word_id, or char and char_id, or label and label_id) as Parquet."""
    vocabulary.write.mode("overwrite").parquet(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """A stored vocabulary; it fails if ids repeat."""
    rows = spark.read.parquet(path)
    key = next(c for c in rows.columns if c.endswith("_id"))
    count, distinct = rows.agg(F.count(key), F.countDistinct(key)).first()
    if count != distinct:
        raise ValueError(f"{path}: {key} repeats")
    return rows


def write_extraction(results: DataFrame, metrics: DataFrame, folder: str, model: str, timestamp: str) -> None:
    """Results of an outside model as JSON lines, their metrics (one row of soft_metrics) as JSON, and a summary in Markdown."""
    spark = results.sparkSession
    write_json(results, f"{folder}/predictions_events.jsonl")
    got = metrics.first().asDict()
    meta = {"model": model, "timestamp": timestamp, "total_documents": results.count(), "evaluation_method": "event_extraction"}
    write_text(spark, f"{folder}/evaluation_results_events.json", json.dumps({"metadata": meta, "event_level_metrics": got}, indent=2))
    lines = [f"| {k} | {v:.4f} |" if isinstance(v, float) else f"| {k} | {v} |" for k, v in got.items()]
    summary = [f"# Events extracted by {model}", "", f"{meta['total_documents']} documents, {timestamp}", "", "| metric | value |", "|---|---|", *lines, ""]
    write_text(spark, f"{folder}/evaluation_summary_events.md", "\n".join(summary))
