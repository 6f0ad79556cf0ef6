"""Catalogue: streaming keys.  Each runs a real Structured Streaming query to completion
(``availableNow``) into a Parquet sink and returns the sink, which must equal the batch result."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import exam_rules
from ..operators.ledger import Ledger
from ..sources import fixtures as X
from ..sources.tables import read_table, spread
from ..streaming import stream as ST
from .catalog import query

SOURCE_FILES = 4
FILE_ROWS = 100_000         # of a landed file


@query("stream_score")
def q_stream_score(spark: SparkSession, sf: str) -> DataFrame:
    base = ST.scratch_dir(spark, "stream-score")
    src = os.path.join(base, "source")
    # land the EXAM records as several files so the stream runs several micro-batches
    # and no task reads more than one file's records, however many there are
    spread(X.exam(spark, sf).drop("exam_date"), "record_id").write.option("maxRecordsPerFile", FILE_ROWS).parquet(src)
    schema = spark.read.parquet(src).schema
    ST.stream_scores(spark, src, schema, exam_rules(), X.EXAM_FIELDS, os.path.join(base, "sink"),
                     os.path.join(base, "checkpoint"))
    return spark.read.parquet(os.path.join(base, "sink"))


@query("stream_log")
def q_stream_log(spark: SparkSession, sf: str) -> DataFrame:
    base = ST.scratch_dir(spark, "stream-log")
    src = os.path.join(base, "source")
    read_table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "props") \
        .repartition(SOURCE_FILES, "event_id").write.parquet(src)
    schema = spark.read.parquet(src).schema
    ST.stream_logs(spark, src, schema, os.path.join(base, "sink"), os.path.join(base, "checkpoint"))
    return spark.read.parquet(os.path.join(base, "sink")).select("id", "username", "action", "detail", "created_at")


@query("stream_log_store")
def q_stream_log_store(spark: SparkSession, sf: str) -> DataFrame:
    """Events streamed into the log table in several micro-batches; ``ids_dense``: its ids are 1, 2, ... without a gap."""
    base = ST.scratch_dir(spark, "stream-log-store")
    src = os.path.join(base, "source")
    read_table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "props") \
        .repartition(SOURCE_FILES, "event_id").write.parquet(src)
    schema = spark.read.parquet(src).schema
    logs = Ledger(spark, os.path.join(base, "logs"))
    ST.stream_log_store(spark, src, schema, logs, Ledger(spark, os.path.join(base, "rejects")),
                        os.path.join(base, "checkpoint"), max_files_per_trigger=2)
    rows = logs.read()
    dense = rows.select((F.count("id") == F.max("id")) & (F.count_distinct("id") == F.max("id")) & (F.min("id") == 1))
    return rows.select("event_id", "username", "action", "detail", "created_at", dense.scalar().alias("ids_dense"))
