"""Structured Streaming jobs: score arriving records, append operation logs.

Both are stateless per micro-batch (no watermark needed): the same pure
transforms as the batch keys run inside ``readStream -> writeStream``.  The
sink is an append-only Parquet folder with a checkpoint, so a restarted query
(or a lost executor) resumes exactly where the last committed batch ended.
Ids in a stream come from the source key, not from a global row number.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import RuleSet
from ..operators.ledger import Ledger
from ..operators.scoring import score_records
from ..operators.serving import Artefacts
from ..operators.store import LOG_COLUMNS, normalize_log
from ..sources.tables import ensure_checkpoint_dir


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint location."""
    base = ensure_checkpoint_dir(spark)
    base = base[len("file:"):] if base.startswith("file:") else base
    path = os.path.join(base, f"{name}-{uuid.uuid4().hex}")
    return path


def run_available_now(stream: DataFrame, sink: str, checkpoint: str, timeout_s: int = 1800) -> None:
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError(f"stream to {sink} did not finish in {timeout_s}s")
    if q.exception() is not None:
        raise q.exception()


def _files(spark: SparkSession, schema, max_files_per_trigger: int | None):
    """A file stream reader; without a limit each batch takes what is there."""
    reader = spark.readStream.schema(schema)
    return reader.option("maxFilesPerTrigger", max_files_per_trigger) if max_files_per_trigger else reader


def stream_scores(spark: SparkSession, source_dir: str, schema, ruleset: RuleSet, roles, sink: str,
                  checkpoint: str, max_files_per_trigger: int | None = None) -> None:
    """readStream records -> score_records -> append to ``sink``."""
    src = _files(spark, schema, max_files_per_trigger).parquet(source_dir)
    scored = score_records(src, ruleset, roles)
    out = scored.select("record_id", F.col("final.source").alias("source"), F.col("final.label").alias("label"),
                        F.col("final.diagnosis").alias("diagnosis"), F.col("final.rule_id").alias("rule_id"),
                        F.array_join("final.trace", "\n").alias("trace"), "query")
    run_available_now(out, sink, checkpoint)


def stream_features(spark: SparkSession, source_dir: str, kept: Artefacts, key, sink: str, checkpoint: str,
                    max_files_per_trigger: int | None = None) -> None:
    """readStream records -> the stored feature plan -> append to ``sink``; long vocabularies are joined as tables."""
    schema = spark.read.parquet(source_dir).schema
    src = _files(spark, schema, max_files_per_trigger).parquet(source_dir)
    run_available_now(kept.transform(src, key), sink, checkpoint)


def stream_logs(spark: SparkSession, source: str, schema, sink: str, checkpoint: str,
                max_files_per_trigger: int | None = None) -> None:
    """readStream events -> operation-log projection -> append to ``sink``."""
    ev = _files(spark, schema, max_files_per_trigger).parquet(source)
    logs = ev.select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
                     F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("username"),
                     F.col("event_type").alias("action"), F.col("props").alias("detail"))
    run_available_now(normalize_log(logs), sink, checkpoint)


def _log_rows(events: DataFrame) -> DataFrame:
    """Operation-log rows of raw events; ``reason`` says why a row is rejected, null where it is not."""
    rows = normalize_log(events.select(
        "event_id", "ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("username"),
        F.col("event_type").alias("action"), F.col("props").alias("detail")))
    return rows.withColumn("reason", F.when(F.col("ts").isNull(), "no time").when(F.col("action") == "", "no action"))


def stream_log_store(spark: SparkSession, source: str, schema, logs: Ledger, rejects: Ledger, checkpoint: str,
                     name: str = "log", max_files_per_trigger: int | None = None) -> None:
    """readStream events -> log table with dense ids; rows without a time or an action go to the table of rejects.

    A micro-batch is appended under its number.  One that runs again, after a failure between the two appends or with a
    lost checkpoint over the same files, is recognised in both ledgers.
    """
    def append(batch: DataFrame, number: int) -> None:
        rows = _log_rows(batch)
        logs.append(rows.where(F.col("reason").isNull()), f"{name}-{number}", ["ts", "event_id"],
                    [*LOG_COLUMNS, "event_id"])
        rejects.append(rows.where(F.col("reason").isNotNull()), f"{name}-{number}", ["event_id"],
                       [*LOG_COLUMNS, "event_id", "reason"])

    run = (_files(spark, schema, max_files_per_trigger).parquet(source).writeStream.foreachBatch(append)
           .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    run.awaitTermination()
    if run.exception() is not None:
        raise run.exception()
