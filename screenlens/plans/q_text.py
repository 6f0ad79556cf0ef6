"""Catalogue: text outputs (query, advice, summary, report, prompt, gate) and record parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import findings as H
from ..functions.rules import exam_rules
from ..operators import prompts as PM
from ..operators.scoring import score_records
from ..sources import fixtures as X
from ..sources import records_text as RT
from .catalog import query

RECORD_FIELDS = [c for c in ["exam_date", "job", "gender", "age", "tenure", "exposure", "sbp_result", "sbp_unit",
                             "sbp_marker", "dbp_result", "glucose_result", "lung_result", "chest_judgment",
                             "chest_marker", "hearing_high_result", "hearing_high_marker", "hearing_speech_result",
                             "hearing_speech_marker", "symptom", "spare_result"]]


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return score_records(X.exam(spark, sf), exam_rules(), X.EXAM_FIELDS)


@query("query_text")
def q_query_text(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("record_id", "query")


@query("advice_template")
def q_advice_template(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(spark, sf)
    adv = H.advice_struct(F.col("final.label"), F.col("highlights"))
    return s.select("record_id", adv["mode"].alias("advice_mode"), adv["text"].alias("advice_text"))


@query("record_summary")
def q_record_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(spark, sf)
    f = H.Fields(s.columns, X.EXAM_FIELDS)
    sec = H.summary_sections(f, F.col("highlights"))
    return s.select("record_id", F.size(sec).alias("n_sections"), H.summary_text(sec).alias("summary"))


@query("report_text")
def q_report_text(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(spark, sf)
    logic = F.when(F.col("final.source") == C.SOURCE_RULES, F.col("final.trace")).otherwise(
        F.array().cast("array<string>"))
    adv = H.advice_struct(F.col("final.label"), F.col("highlights"))["text"]
    rep = H.report_text(RECORD_FIELDS, F.col("final.label"), F.col("final.source"), F.col("final.diagnosis"),
                        logic, F.array().cast("array<string>"), adv)
    return s.select("record_id", rep.alias("report"))


@query("prompt_build")
def q_prompt_build(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(spark, sf)
    ev = PM.evidence_block(F.col("final.source"), F.col("final.trace"))
    p = PM.user_prompt(F.col("final.label"), F.col("final.diagnosis"), F.col("final.source"), ev,
                       PM.record_block(RECORD_FIELDS), F.col("query"), PM.rag_block(None))
    return s.select("record_id", p.alias("user_prompt"))


@query("quality_gate")
def q_quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    g = RT.gen(spark, sf)
    from ..functions.text import split_lines
    return g.select("conv_id", "turn", PM.reject_reason(F.col("text")).alias("reject_reason"),
                    F.size(split_lines(F.trim("text"))).alias("n_lines"))


@query("parse_kv_text")
def q_parse_kv_text(spark: SparkSession, sf: str) -> DataFrame:
    e = RT.kv(spark, sf).select("record_id", RT.kv_entries(F.col("kv_text")).alias("e"))
    return e.select("record_id", F.size("e").alias("n_keys"), RT.entries_text(F.col("e")).alias("record_text"))


@query("parse_record_json")
def q_parse_record_json(spark: SparkSession, sf: str) -> DataFrame:
    ev = X.read_table(spark, sf, "events", "event_id", "props")
    e = ev.select("event_id", RT.record_entries(F.col("props")).alias("e"))
    return e.select("event_id", F.size("e").alias("n_keys"), RT.entries_text(F.col("e")).alias("record_text"))


@query("input_routing")
def q_input_routing(spark: SparkSession, sf: str) -> DataFrame:
    """Resolve each input by mode: dataset sample id, uploaded JSON text, or typed key/value text."""
    from .catalog import q_demo_samples
    base = RT.kv(spark, sf)
    rid = F.col("record_id")
    mode = F.element_at(F.array(*[F.lit(m) for m in RT.MODES]), (rid % 3 + 1).cast("int"))
    # demo samples: at most 5 labels x 4 rows, a proven bound for the broadcast
    demo = F.broadcast(q_demo_samples(spark, sf).select("sample_id", F.lit(1).alias("known")))
    sample_id = F.concat(F.coalesce(X._label_text_col(F.col("label")), F.lit("")), F.lit("_"), rid.cast("string"))
    upload_text = F.when(F.col("exposure").isNotNull(),
                         F.to_json(F.create_map(F.lit("exposure"), F.col("exposure"), F.lit("record_id"),
                                                rid.cast("string")))).otherwise(F.lit("[]"))
    manual_text = F.when(F.col("exposure").isNotNull(), F.col("kv_text")).otherwise(F.lit("   "))
    staged = base.select("record_id", mode.alias("mode"), sample_id.alias("sample_id"),
                         F.when(mode == "upload", upload_text).otherwise(manual_text).alias("text"))
    joined = staged.join(demo, "sample_id", "left")
    parsed = F.when(F.col("mode") == "dataset", F.array().cast("array<struct<k:string,v:string>>")) \
        .otherwise(RT.record_entries(F.col("text")))
    out = joined.select("record_id", "mode", "known", parsed.alias("e"))
    reason = (F.when(F.col("mode") == "dataset", F.when(F.col("known").isNull(), F.lit(RT.REJECT_DATASET)))
              .when(F.col("mode") == "upload", F.when(F.size("e") == 0, F.lit(RT.REJECT_UPLOAD)))
              .otherwise(F.when(F.size("e") == 0, F.lit(RT.REJECT_MANUAL))))
    return out.select("record_id", "mode", F.size("e").alias("n_fields"), reason.alias("reject_reason"))
