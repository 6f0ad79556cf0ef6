"""Derived test views over the driver tables (definitions in FIXTURES.md §3).

Each view is a deterministic projection of the parquet tables, written with
the DataFrame API so Catalyst prunes columns down to the scan and the work
grows with the tables.  The DuckDB twins live in ``screenlens.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table  # noqa: F401  (re-exported)

# role -> EXAM column (the wide schema's roles map onto the English test names)
EXAM_FIELDS = {
    "gender": "gender", "age": "age", "job": "job", "total_years": "tenure", "exposure_years": None,
    "hazard": "exposure", "protection": None, "sbp": "sbp_result", "sbp_marker": "sbp_marker",
    "dbp": "dbp_result", "dbp_marker": None, "glucose": "glucose_result", "chest_judgment": "chest_judgment",
    "chest_marker": "chest_marker", "lung": "lung_result", "high_freq": "hearing_high_result",
    "speech_freq": "hearing_speech_result", "ecg": None, "symptom": "symptom",
}
EXAM_LABEL = "label"
EXAM_KEY = "record_id"
EXAM_PRIVACY = ["name"]
EXAM_TEXT_COLUMNS = ["name", "job", "gender", "tenure", "exposure", "sbp_result", "sbp_unit", "sbp_marker",
                     "dbp_result", "glucose_result", "lung_result", "chest_judgment", "chest_marker",
                     "hearing_high_result", "hearing_high_marker", "hearing_speech_result",
                     "hearing_speech_marker", "symptom", "spare_result"]


def _s(c) -> F.Column:
    return c.cast("string")


def exposure_by_order(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted distinct product-type tokens per order ('LARGE' is written 'LARGE、XL')."""
    li = read_table(spark, sf, "lineitem", "l_orderkey", "l_partkey")
    part = read_table(spark, sf, "part", "p_partkey", "p_type")
    tok = F.when(F.col("p_type") == "LARGE", F.lit("LARGE、XL")).otherwise(F.col("p_type"))
    return (li.join(part, li.l_partkey == part.p_partkey)
            .groupBy("l_orderkey")
            .agg(F.array_join(F.array_sort(F.collect_set(tok)), ",").alias("exposure")))


def exam(spark: SparkSession, sf: str) -> DataFrame:
    """EXAM: one dirty screening record per order."""
    o = read_table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                   "o_orderdate", "o_orderpriority")
    c = read_table(spark, sf, "customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    h = exposure_by_order(spark, sf)
    # orders ⋈ exposure share the order key; the customer join comes last
    n = o.join(h, o.o_orderkey == h.l_orderkey, "left").join(c, F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    tp = F.floor("o_totalprice").cast("bigint")
    ab = F.floor(F.abs("c_acctbal")).cast("bigint")
    sv = F.lit(90) + F.floor(F.col("o_totalprice") / 5000).cast("bigint")
    dv = F.lit(55) + tp % 60
    gv = F.lit(30) + tp % 60
    hv = ab % 70
    spv = (ab + 13) % 60
    return n.select(
        k.alias("record_id"),
        F.col("c_name").alias("name"),
        F.col("o_orderdate").alias("exam_date"),
        F.col("c_mktsegment").alias("job"),
        F.when(F.col("c_custkey") % 2 == 0, "M").otherwise("F").alias("gender"),
        (F.lit(18) + F.col("c_custkey") % 48).cast("int").alias("age"),
        F.when(k % 23 == 0, F.lit(None)).when(k % 7 == 0, "")
         .otherwise(F.concat(_s(k % 31), F.lit("年"), _s(k % 12), F.lit("月"))).alias("tenure"),
        F.col("exposure"),
        F.when(k % 13 == 0, F.lit(None)).when(k % 17 == 0, "未检")
         .when(k % 19 == 0, F.concat(_s(sv), F.lit(" mmHg"))).otherwise(_s(sv)).alias("sbp_result"),
        F.lit("mmHg").alias("sbp_unit"),
        F.when(k % 11 == 0, F.lit(None)).when(sv >= 140, "不合格").otherwise("合格").alias("sbp_marker"),
        _s(dv).alias("dbp_result"),
        F.when(k % 3 == 0, F.lit(None))
         .otherwise(F.concat(_s(F.floor(gv / 10.0).cast("bigint")), F.lit("."), _s(gv % 10))).alias("glucose_result"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "轻度阻塞性")
         .when(F.col("o_orderpriority") == "2-HIGH", "中度拘束性")
         .when(F.col("o_orderpriority") == "3-MEDIUM", "未见异常")
         .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "　肺功能　 正常 ").alias("lung_result"),
        F.when(k % 40 == 0, "尘肺样改变").when(k % 40 < 4, "其他异常").when(k % 40 == 4, "未检查")
         .otherwise("未见异常").alias("chest_judgment"),
        F.when(k % 40 < 4, "不合格").otherwise("合格").alias("chest_marker"),
        _s(hv).alias("hearing_high_result"),
        F.when(hv >= 25, "不合格").otherwise("合格").alias("hearing_high_marker"),
        _s(spv).alias("hearing_speech_result"),
        F.when(spv >= 25, "不合格").when(k % 5 == 0, F.lit(None)).otherwise("合格").alias("hearing_speech_marker"),
        F.when(k % 9 == 0, "咳嗽").when(k % 9 == 1, "无特殊情况").when(k % 9 == 2, F.lit(None))
         .otherwise("无").alias("symptom"),
        F.lit(None).cast("string").alias("spare_result"),
        F.when(k % 97 == 0, F.lit(None)).when(k % 211 == 0, "suspected").when(k % 50 == 0, "contraindication")
         .when(F.col("o_orderstatus") == "F", "other").when(F.col("o_orderstatus") == "O", "normal")
         .otherwise("recheck").alias("label"),
    )


# English fixture label -> conclusion text of the original label dictionary
EXAM_LABEL_TEXT = {"other": "其他疾病或异常", "normal": "目前未见异常", "recheck": "复查",
                   "contraindication": "职业禁忌证", "suspected": "疑似职业病"}


def pred(spark: SparkSession, sf: str) -> DataFrame:
    """PRED: three models' predictions with class probabilities (ties -> lowest class)."""
    o = read_table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    w = o.select(
        F.col("o_orderkey").alias("row_id"),
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("y"),
        (1 + F.col("o_custkey") % 7).alias("a"),
        (1 + F.col("o_orderkey") % 5).alias("b"),
        (1 + F.floor("o_totalprice").cast("bigint") % 11).alias("d"),
    )
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(bst).alias("boost"))
                       for m, bst in (("m0", 6), ("m1", 4), ("m2", 2))])
    s = w.select("*", F.inline(models))
    hit = F.col("row_id") % 10 < 6
    a = F.col("a") + F.when((F.col("y") == 0) & hit, F.col("boost")).otherwise(0)
    b = F.col("b") + F.when((F.col("y") == 1) & hit, F.col("boost")).otherwise(0)
    d = F.col("d") + F.when((F.col("y") == 2) & hit, F.col("boost")).otherwise(0)
    s = s.select("model", "row_id", "y", a.alias("a"), b.alias("b"), d.alias("d"))
    tot = F.col("a") + F.col("b") + F.col("d")
    return s.select(
        "model", "row_id", "y",
        F.when((F.col("a") >= F.col("b")) & (F.col("a") >= F.col("d")), 0)
         .when(F.col("b") >= F.col("d"), 1).otherwise(2).alias("p"),
        (F.col("a").cast("double") / tot).alias("p0"),
        (F.col("b").cast("double") / tot).alias("p1"),
        (F.col("d").cast("double") / tot).alias("p2"),
    )


# ------------------------------------------------------------------ stored-table views

INPUT_MODES = ["dataset", "manual", "upload"]
RULE_VERSION = "rules-v1"


def _label_text_col(c: F.Column) -> F.Column:
    m = F.create_map(*[x for k, v in EXAM_LABEL_TEXT.items() for x in (F.lit(k), F.lit(v))])
    return m[c]


def sparse_json(df: DataFrame, columns: list[str]) -> F.Column:
    """JSON object of the non-null fields, values as text (the sparse record form)."""
    entries = [x for c in columns for x in (F.lit(c), F.col(c).cast("string"))]
    return F.to_json(F.map_filter(F.create_map(*entries), lambda k, v: v.isNotNull()))


def records(spark: SparkSession, sf: str) -> DataFrame:
    """RECORDS: one saved analysis per EXAM record (result of score_records), before id assignment."""
    from ..functions.rules import exam_rules
    from ..operators.scoring import score_records
    df = score_records(exam(spark, sf), exam_rules(), EXAM_FIELDS)
    rid = F.col("record_id")
    mode = F.element_at(F.array(*[F.lit(m) for m in INPUT_MODES]), (rid % 3 + 1).cast("int"))
    fields = [c for c in df.columns if c not in ("record_id", "name", "label", "final", "highlights", "query")]
    result = F.to_json(F.map_filter(F.create_map(
        F.lit("source"), F.col("final.source"), F.lit("label"), F.col("final.label"),
        F.lit("diagnosis"), F.col("final.diagnosis"), F.lit("rule_id"), F.col("final.rule_id")),
        lambda k, v: v.isNotNull()))
    return df.select(
        "record_id", F.concat(F.lit("doctor"), (rid % 7).cast("string")).alias("username"), mode.alias("input_mode"),
        F.when(mode == "dataset", F.concat(F.coalesce(_label_text_col(F.col("label")), F.lit("")), F.lit("_"),
                                           rid.cast("string"))).otherwise(F.lit("")).alias("sample_id"),
        F.col("final.label").alias("final_label"), F.col("final.source").alias("final_source"),
        F.col("final.diagnosis").alias("diagnosis"), F.col("final.rule_id").alias("rule_id"),
        F.lit("template_fallback").alias("advice_mode"),
        F.date_format("exam_date", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        sparse_json(df, fields).alias("record_json"), result.alias("result_json"))


def log(spark: SparkSession, sf: str) -> DataFrame:
    """LOG: one operation-log row per event."""
    ev = read_table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "props")
    return ev.select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
                     F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("username"),
                     F.col("event_type").alias("action"), F.col("props").alias("detail"), "ts")
