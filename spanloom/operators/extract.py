"""Extraction of events by an outside model: prompts, replies, and calls over an injected client."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: What an error of a used-up quota says, in lower case.
QUOTA = ("quota", "rate limit", "rate_limit_exceeded", "resource_exhausted", "resource has been exhausted", "429")
#: Headings and the task of a prompt.
EXAMPLES, TASK = "# Examples", "# Your Task"
ASK = "Extract the voting event from the following text and return ONLY the JSON object:"
ASK_LONG = "Given the input text below, extract the voting event and return ONLY the JSON object as specified."
#: The shape of an example's output; older forms of its fields are read too.
EXAMPLE = "text string, has_voting_event boolean, event struct<subject:string,participants:array<struct<text:string,position:string>>,counting:array<struct<text:string,type:string>>,voting_expressions:array<string>>"
REPLY = "struct<has_voting_event:boolean,event:string>"


def normal_event(event: Column) -> Column:
    """A VARIANT event in its present form: subject from the first of subjects, single values as lists, no outcome."""
    get = lambda p, t: F.try_variant_get(event, p, t)
    people, count = "array<struct<text:string,position:string>>", "struct<text:string,type:string>"
    return F.struct(
        F.coalesce(get("$.subject", "string"), get("$.subjects[0]", "string")).alias("subject"),
        F.coalesce(get("$.participants", people), F.array().cast(people)).alias("participants"),
        F.coalesce(get("$.counting", f"array<{count}>"), F.filter(F.array(get("$.counting", count)), lambda c: c.isNotNull()), F.array().cast(f"array<{count}>")).alias("counting"),
        F.coalesce(get("$.voting_expressions", "array<string>"), F.filter(F.array(get("$.voting_expression", "string")), lambda c: c.isNotNull()), F.array().cast("array<string>")).alias("voting_expressions"),
    )


def cut(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def shown(source: str, most: int, always: bool = False) -> str:
    """The start of an example's text, with dots where it was cut, or always."""
    text = source.strip()
    return text[:most] + ("..." if always or len(text) > most else "")


def prompt(text: Column, instructions: str, examples: list[tuple[str, str]] = (), use: int = 5, most: int = 400) -> Column:
    """Instructions, the first `use` examples (text, output JSON) with their texts cut, then the text itself."""
    block = "\n\n## Example {k}\n\nInput: {text}\n\nOutput: {output}\n"
    blocks = "".join(block.format(k=k, text=shown(x, most), output=y) for k, (x, y) in enumerate(examples[:use], 1))
    told = f"\n\n\n{EXAMPLES}\n{blocks}" if examples else ""
    return F.concat(F.lit(f"{instructions}{told}\n\n\n{TASK}\n\n{ASK}\n\n\nInput: "), text, F.lit("\n\n\nOutput:"))


def example_prompt(instructions: str, examples: list[tuple[str, str]], use: int = 10, most: int = 500) -> str:
    """The other form: instructions and examples with outputs as code blocks, the text to follow."""
    block = "\n\n## Example {k}\n\n\n**Input:**\n{text}\n\n\n**Output:**\n```json\n{output}\n```\n"
    blocks = "".join(block.format(k=k, text=shown(x, most, True), output=y) for k, (x, y) in enumerate(examples[:use], 1))
    return f"{instructions}\n\n\n{EXAMPLES}\n{blocks}\n\n\n{TASK}\n\n{ASK_LONG}\n"


def parse_reply(reply: Column) -> Column:
    """has_voting_event, event (JSON), error and raw_response of a reply.

    A reply that is no JSON object with has_voting_event is an error without event, its text cut at 1000.
    """
    value = F.try_parse_json(F.trim(reply))
    has = F.try_variant_get(value, "$.has_voting_event", "boolean")
    fine = F.coalesce(F.schema_of_variant(value).startswith("OBJECT<"), F.lit(False)) & has.isNotNull()
    return F.struct(
        F.coalesce(F.when(fine, has), F.lit(False)).alias("has_voting_event"),
        F.when(fine & has, F.to_json(F.variant_get(value, "$.event", "variant"))).alias("event"),
        F.when(~fine, "invalid response structure").alias("error"),
        F.when(fine, reply).otherwise(F.left(reply, F.lit(1000))).alias("raw_response"),
    )


def is_quota_error(error: Column) -> Column:
    low = F.lower(error)
    return F.coalesce(F.greatest(*[F.contains(low, F.lit(mark)) for mark in QUOTA]), F.lit(False))


def attempt(client: Callable[[str], str], text: str, retries: int = 3, wait: float = 60.0) -> tuple[str | None, str | None, float]:
    """The reply, else the error, and the seconds of a call, which is made again only after quota errors."""
    began, error = time.time(), None
    for k in range(retries + 1):
        try:
            return client(text), None, time.time() - began
        except Exception as e:
            error = str(e)
            if k == retries or not any(mark in error.lower() for mark in QUOTA):
                break
            time.sleep(wait)
    return None, error, time.time() - began


def call(rows: DataFrame, client: Callable[[str], str], prompt: str = "prompt", retries: int = 3, wait: float = 60.0, pause: float = 0.0) -> DataFrame:
    """rows with reply, error and seconds: client is called once for each row, again only after quota errors.

    A row whose calls fail has an error and no reply; none raises. The number of partitions of rows is the
    number of calls at a time.
    """
    names = rows.columns
    at = names.index(prompt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies, errors, seconds = [], [], []
            for text in batch.column(at).to_pylist():
                reply, error, took = attempt(client, text, retries, wait)
                replies.append(reply)
                errors.append(error)
                seconds.append(took)
                time.sleep(pause)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replies, pa.string()), pa.array(errors, pa.string()), pa.array(seconds, pa.float64())], names=[*names, "reply", "error", "seconds"])

    schema = StructType([*rows.schema.fields, StructField("reply", StringType()), StructField("error", StringType()), StructField("seconds", DoubleType())])
    return rows.mapInArrow(run, schema)


def resume(rows: DataFrame, client: Callable[[str], str], log: str, key: str = "id", prompt: str = "prompt", rate: float | None = None, commit: int = 10, again: bool = False, **how) -> DataFrame:
    """key, reply, error and seconds of each row of rows (key without repeats or nulls), of a job that can be stopped and run again.

    Results are kept in the folder `log`, which driver and executors share: a task writes a file for each `commit` calls, and what
    it has when it fails; so only a task that is killed outright loses the calls since its last file. A later run reads the log
    and calls for rows alone that are not in it, or with `again` for those too whose last call failed. At most `rate` calls begin a
    second over all tasks: each of the tasks that run at a time waits its share. A row whose calls fail stays, with its error.
    """
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, reply string, error string, seconds double, at double"

    def logged() -> DataFrame:
        place = spark._jvm.org.apache.hadoop.fs.Path(log)
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(log)

    done = logged() if not again else logged().filter("error IS NULL")
    left = rows.select(key, prompt).join(done.select(F.col(key).alias("__done")).distinct(), F.col(key) == F.col("__done"), "left_anti")
    tasks = max(1, min(left.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism))
    left = left.coalesce(tasks)
    share = tasks / rate if rate else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import pyarrow.parquet as pq
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(log) if "://" in log or log.startswith("file:") else (fs.LocalFileSystem(), log)
        system.create_dir(folder, recursive=True)
        kept: list[tuple] = []
        count, begun = 0, 0.0

        def flush(ids: pa.DataType) -> None:
            if kept:
                columns = [pa.array([k[0] for k in kept], ids), pa.array([k[1] for k in kept], pa.string()), pa.array([k[2] for k in kept], pa.string()), pa.array([k[3] for k in kept], pa.float64()), pa.array([k[4] for k in kept], pa.float64())]
                name = f"{folder}/{uuid.uuid4().hex}"
                pq.write_table(pa.table(columns, names=[key, "reply", "error", "seconds", "at"]), f"{name}.tmp", filesystem=system)
                system.move(f"{name}.tmp", f"{name}.parquet")  # a file is in the log as a whole or not at all
                kept.clear()

        for batch in batches:
            ids = batch.column(0).type
            try:
                for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    time.sleep(max(0.0, begun + share - time.time()))
                    begun = time.time()
                    kept.append((k, *attempt(client, text, **how), begun))
                    count += 1
                    if len(kept) >= commit:
                        flush(ids)
            finally:
                flush(ids)
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], names=["n"])

    left.mapInArrow(run, "n long").agg(F.sum("n")).collect()
    last = logged().groupBy(key).agg(F.max_by(F.struct("reply", "error", "seconds"), "at").alias("r"))
    return rows.select(F.col(key).alias("__key")).join(last, F.col("__key") == F.col(key)).select(key, "r.reply", "r.error", "r.seconds")


def example_json(has: bool, event: dict | None) -> str:
    return json.dumps({"has_voting_event": has, "event": event if has else None}, ensure_ascii=False)
