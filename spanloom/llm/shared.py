"""What the corpus operators share: the shared folder, stored intermediates, shipped code, tables."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Most groups whose table is broadcast.
SMALL = 10_000
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the session names none, as in tests on one machine, a temporary one is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = Path(tempfile.mkdtemp(prefix="spanloom-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def place(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends."""
    path = f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read back: its lineage ends there."""
    path = place(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a stored() table that no later plan reads."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for p in sorted((root / "spanloom").rglob("*.py")):
            z.write(p, p.relative_to(root).as_posix())
    to = os.path.join(tempfile.mkdtemp(prefix="spanloom-code-"), "spanloom.zip")
    Path(to).write_bytes(raw.getvalue())
    spark.sparkContext.addPyFile(to)
    _shipped.add(app)


def small_batches(spark: SparkSession, most: int = 1000) -> None:
    """Hand tasks at most `most` rows at once from here on: what they hold is texts. It stays so, as results are computed later."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(name))
    spark.conf.set(name, min(rows, most) if rows > 0 else most)


def least(rows: DataFrame, group: str, keys: list[str], most: int) -> DataFrame:
    """Of each group the `most` distinct rows with the least hash of their keys, with the hash as `__h`.

    rows has the columns group and keys alone, and equal rows are one. Only group and hash are ranked, and of those only about
    twice the wanted share, by a count of each group; the rows themselves are not shuffled but held against their group's last
    hash, and only then made distinct. The tables of groups are broadcast up to SMALL groups. Different rows of one hash (40 bits) stay
    or go together.
    """
    h = F.pmod(F.xxhash64(*keys, F.lit(11)), F.lit(1 << 40))
    narrow = rows.select(F.col(group).alias("__group"), h.alias("__o")).distinct()
    narrow = stored(narrow, "sample-hashes")
    counts = stored(narrow.groupBy("__group").agg(F.count(F.lit(1)).alias("__size")), "sample-sizes")
    small = F.broadcast if counts.count() <= SMALL else (lambda x: x)
    near = narrow.join(small(counts), "__group").filter(F.col("__o") / float(1 << 40) * F.col("__size") < 2 * most + 100)
    first = near.withColumn("__rank", F.row_number().over(Window.partitionBy("__group").orderBy("__o")))
    cuts = stored(first.filter(F.col("__rank") <= most).groupBy("__group").agg(F.max("__o").alias("__last")), "sample-cuts")
    joined = rows.withColumn("__h", h).join(small(cuts), F.col(group) == F.col("__group"))
    return joined.filter(F.col("__h") <= F.col("__last")).drop("__group", "__last").dropDuplicates([group, *keys])
