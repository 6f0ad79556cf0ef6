"""Catalogue: stored tables (RECORDS, CASES, LOG) and their searches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import store as ST
from ..sources import fixtures as X
from ..sources.tables import ensure_checkpoint_dir, stored
from .catalog import query

RECORD_LIST = ["id", "created_at", "username", "input_mode", "sample_id", "final_label", "final_source", "advice_mode"]
CASE_LIST = ["id", "created_at", "username", "final_label", "diagnosis", "rule_hit_tag", "rule_version", "note"]
LOG_LIST = ["id", "created_at", "username", "action", "detail"]
RECORD_KEYWORD_COLUMNS = ["username", "sample_id", "final_label", "diagnosis", "advice_mode"]
CASE_KEYWORD_COLUMNS = ["username", "final_label", "diagnosis", "note"]
LOG_KEYWORD_COLUMNS = ["username", "action", "detail"]
RECORD_SEARCH = {"keyword": "doctor3", "final_label": C.LABELS[3]}
CASE_SEARCH = {"rule_hit_tag": C.RULE_HIT, "rule_version": "v1"}
LOG_SEARCH = {"keyword": "9", "action": "click", "username": "user1"}


CASE_SOURCE = ["record_id", "username", "final_label", "final_source", "diagnosis", "rule_id", "created_at", "record_json",
               "result_json"]               # what case_rows reads
SECOND_BATCH = "1995-01-01 00:00:00"     # what was created from then on is appended as a second batch
_STORES: dict[tuple, str] = {}


def _stored(spark: SparkSession, sf: str, name: str, batches: Callable[[], list[DataFrame]], order: list[str],
            columns: list[str]) -> DataFrame:
    """The stored table, written batch by batch on first use in this application and read from then on."""
    key = (spark.sparkContext.applicationId, sf.rstrip("/"), name)
    if key not in _STORES:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/store-{name}-{uuid.uuid4().hex}"
        for number, batch in enumerate(batches()):
            ST.append_to(batch, path, order, columns, f"{name}-{number}")
        _STORES[key] = path
    return ST.read_store(spark, _STORES[key], dict.fromkeys(columns, "string"))


def _in_two(df: DataFrame) -> list[DataFrame]:
    """``df`` is stored: both batches read it."""
    return [df.where(F.col("created_at") < SECOND_BATCH), df.where(F.col("created_at") >= SECOND_BATCH)]


def saved_records(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf, "records", lambda: _in_two(stored(X.records(spark, sf), "batches")), ["created_at", "record_id"],
                   ST.RECORD_COLUMNS + ["record_id", "rule_id"])


def saved_cases(spark: SparkSession, sf: str) -> DataFrame:
    def batches() -> list[DataFrame]:
        # stored before the filter, which would otherwise be pushed below the scoring and evaluate the rules again
        rec = stored(X.records(spark, sf).select(*CASE_SOURCE), "batches").where(F.col("final_source") == C.SOURCE_RULES)
        return _in_two(ST.case_rows(rec, X.RULE_VERSION, note=F.col("diagnosis")))

    return _stored(spark, sf, "cases", batches, ["created_at", "record_id"], ST.CASE_COLUMNS + ["record_id"])


def saved_logs(spark: SparkSession, sf: str) -> DataFrame:
    def batches() -> list[DataFrame]:
        return [ST.normalize_log(X.log(spark, sf).withColumnRenamed("id", "event_id"))]

    return _stored(spark, sf, "logs", batches, ["ts", "event_id"], ST.LOG_COLUMNS + ["event_id"])


@query("append_records")
def q_append_records(spark: SparkSession, sf: str) -> DataFrame:
    return saved_records(spark, sf).drop("record_json")


@query("case_library")
def q_case_library(spark: SparkSession, sf: str) -> DataFrame:
    return saved_cases(spark, sf).drop("record_json", "result_json")


@query("log_append")
def q_log_append(spark: SparkSession, sf: str) -> DataFrame:
    return saved_logs(spark, sf)


@query("list_records")
def q_list_records(spark: SparkSession, sf: str) -> DataFrame:
    return ST.search(saved_records(spark, sf), keyword=RECORD_SEARCH["keyword"],
                     keyword_columns=RECORD_KEYWORD_COLUMNS, equals={"final_label": RECORD_SEARCH["final_label"]},
                     select=RECORD_LIST)


@query("list_cases")
def q_list_cases(spark: SparkSession, sf: str) -> DataFrame:
    return ST.search(saved_cases(spark, sf), keyword_columns=CASE_KEYWORD_COLUMNS,
                     prefix={"rule_hit_tag": CASE_SEARCH["rule_hit_tag"]},
                     contains={"rule_version": CASE_SEARCH["rule_version"]}, select=CASE_LIST)


@query("list_logs")
def q_list_logs(spark: SparkSession, sf: str) -> DataFrame:
    logs = ST.normalize_log(X.log(spark, sf))
    return ST.search(logs, keyword=LOG_SEARCH["keyword"], keyword_columns=LOG_KEYWORD_COLUMNS,
                     contains={"action": LOG_SEARCH["action"], "username": LOG_SEARCH["username"]}, select=LOG_LIST)


@query("replay_records")
def q_replay_records(spark: SparkSession, sf: str) -> DataFrame:
    table = saved_records(spark, sf)
    ids = q_list_records(spark, sf).select(F.col("id").cast("bigint").alias("id"))
    out = ST.replay(table, ids)
    return out.select("id", F.size("record").alias("n_fields"), F.col("result")["label"].alias("label"),
                      F.col("result")["source"].alias("source"), F.col("record")["sbp_result"].alias("sbp_result"))
