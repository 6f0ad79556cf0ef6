"""File sources and artefacts: cohorts by suffix, record files, kept tables that are read or else built.

A source that meets rows it cannot read returns them beside the rows it can: nothing is dropped in silence, and one bad
file does not end a job.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .records_text import REJECT_UPLOAD, json_entries, record_entries
from .tables import stored

CORRUPT = "_corrupt_record"
SOURCE_FILE = "_source_file"
CSV = {"header": "true", "escape": '"', "multiLine": "true"}


class Loaded(NamedTuple):
    """What was read, and what was not with the reason."""

    rows: DataFrame
    rejects: DataFrame


def load_cohort(spark: SparkSession, path: str) -> Loaded:
    """A cohort table: Parquet where the path ends in ``.parquet``, CSV with a header otherwise (all columns
    text; an empty field is null).

    rejects: (file, line, reason) of CSV rows whose number of fields is not the header's; none for Parquet.
    """
    if path.rstrip("/").lower().endswith(".parquet"):
        rows = spark.read.parquet(path)
        return Loaded(rows, spark.createDataFrame([], "file string, line string, reason string"))
    names = spark.read.options(**CSV).csv(path).columns              # reads the header only
    schema = StructType([StructField(n, StringType()) for n in [*names, CORRUPT]])
    read = spark.read.options(**CSV, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, enforceSchema="true") \
        .schema(schema).csv(path)
    # parsed once and kept: what Spark finds wrong with a row depends on the columns that are read
    parsed = stored(read.withColumn(SOURCE_FILE, F.col("_metadata.file_name")), "cohort")
    fields = [F.nullif(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names]
    return Loaded(parsed.where(F.col(CORRUPT).isNull()).select(*fields),
                  parsed.where(F.col(CORRUPT).isNotNull()).select(
                      F.col(SOURCE_FILE).alias("file"), F.col(CORRUPT).alias("line"),
                      F.lit("number of fields").alias("reason")))


def load_records(spark: SparkSession, path: str) -> Loaded:
    """Record files under ``path``, one record a file: (file, entries).

    A ``.json`` file must hold an object; any other file holds an object's text or ``key: value`` lines.
    rejects: (file, line, reason) of files without a field.  Files of no bytes are skipped by Spark's reader.
    """
    files = (spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
             .select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("body")))
    entries = F.when(F.lower("file").endswith(".json"), json_entries(F.trim(F.col("body")))).otherwise(
        record_entries(F.col("body")))
    parsed = files.select("file", "body", entries.alias("entries"))
    good = F.size("entries") > 0
    return Loaded(parsed.where(good).select("file", "entries"),
                  parsed.where(~good).select("file", F.col("body").alias("line"), F.lit(REJECT_UPLOAD).alias("reason")))


def path_written(spark: SparkSession, path: str) -> bool:
    """Whether a finished write lies at ``path``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_or_empty(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The Parquet table at ``path``; where none was finished, an empty one with the schema.

    Columns that an older table lacks are null, columns beyond the schema are left out.
    """
    if not path_written(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_or_build(spark: SparkSession, folder: str, fingerprint: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Rows kept as JSON lines under the fingerprint of what they come from; built and written where they are missing.

    An empty table is built again, as it may come from a source that was not there yet.
    """
    path = f"{folder.rstrip('/')}/{fingerprint}"
    df = build()                                                     # a plan: nothing runs unless it is written
    if path_written(spark, path):
        kept = spark.read.schema(df.schema).json(path)
        if not kept.isEmpty():
            return kept
        path = f"{path}-{uuid.uuid4().hex}"
    df.write.option("ignoreNullFields", "false").json(path)
    return spark.read.schema(df.schema).json(path)


def write_confusion(cells: DataFrame, folder: str, labels: dict[int, str]) -> None:
    """Confusion matrices as CSV, one folder a model: a row per true label, a column per predicted one, zeros included."""
    codes = sorted(labels)
    models = cells.select("model").distinct()
    truth = cells.sparkSession.createDataFrame([(k, labels[k]) for k in codes], "y int, label string")
    counted = cells.groupBy("model", "y").pivot("p", codes).agg(F.sum("n").cast("long"))
    grid = models.join(F.broadcast(truth)).join(counted, ["model", "y"], "left").fillna(0)   # classes: a fixed few
    grid.select("model", "y", "label", *[F.col(str(k)).alias(labels[k]) for k in codes]).repartition("model") \
        .sortWithinPartitions("model", "y").drop("y").write.partitionBy("model").option("header", "true").csv(folder)
