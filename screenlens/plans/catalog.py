"""Query catalogue: one Spark plan per SURVEY §7.3 key.

Each entry is ``fn(spark, sf_dir) -> DataFrame`` over the driver tables (or
views Spark derives from them).  Outputs are flat, aliased columns so they
compare 1:1 with the DuckDB oracle in ``screenlens.plans.oracle``; arrays
are rendered as joined text in a defined order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import findings as H
from ..functions.rules import evaluate_rules, exam_rules
from ..operators.scoring import score_records
from ..sources import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _label_text(c: F.Column) -> F.Column:
    m = F.create_map(*[x for k, v in X.EXAM_LABEL_TEXT.items() for x in (F.lit(k), F.lit(v))])
    return m[c]


# ------------------------------------------------------------------ rules

@query("rule_eval")
def q_rule_eval(spark: SparkSession, sf: str) -> DataFrame:
    df = evaluate_rules(X.exam(spark, sf), exam_rules())
    return df.select("record_id", F.col("rule_hit.rule_id").alias("rule_id"),
                     F.col("rule_hit.label").alias("rule_label"), F.col("rule_hit.diagnosis").alias("diagnosis"))


@query("rule_trace")
def q_rule_trace(spark: SparkSession, sf: str) -> DataFrame:
    df = evaluate_rules(X.exam(spark, sf), exam_rules()).where(F.col("rule_hit").isNotNull())
    return df.select("record_id", F.col("rule_hit.rule_id").alias("rule_id"),
                     F.size("rule_hit.trace").cast("bigint").alias("n_lines"),
                     F.array_join("rule_hit.trace", "\n").alias("trace"))


@query("rule_profile")
def q_rule_profile(spark: SparkSession, sf: str) -> DataFrame:
    df = evaluate_rules(X.exam(spark, sf), exam_rules())
    expected = F.coalesce(_label_text(F.col("label")), F.lit(""))
    return (df.groupBy(F.coalesce(F.col("rule_hit.rule_id"), F.lit("")).alias("rule_id"),
                       expected.alias("expected_label"))
            .agg(F.count(F.lit(1)).alias("n"),
                 F.sum((F.col("rule_hit.label") == expected).cast("bigint")).alias("n_agree")))


@query("highlights")
def q_highlights(spark: SparkSession, sf: str) -> DataFrame:
    df = X.exam(spark, sf)
    hl = H.highlights(H.Fields(df.columns, X.EXAM_FIELDS))
    return df.select("record_id", hl.alias("h")).select(
        "record_id", F.size("h").cast("bigint").alias("n_highlights"), F.array_join("h", "\n").alias("highlights"))


@query("heuristic_label")
def q_heuristic_label(spark: SparkSession, sf: str) -> DataFrame:
    df = X.exam(spark, sf)
    f = H.Fields(df.columns, X.EXAM_FIELDS)
    return df.select("record_id", H.heuristic_label(f, H.highlights(f)).alias("heuristic_label"))


@query("score_records")
def q_score_records(spark: SparkSession, sf: str) -> DataFrame:
    out = score_records(X.exam(spark, sf), exam_rules(), X.EXAM_FIELDS)
    return out.select("record_id", F.col("final.source").alias("source"), F.col("final.label").alias("label"),
                      F.col("final.diagnosis").alias("diagnosis"), F.col("final.rule_id").alias("rule_id"),
                      F.array_join("final.trace", "\n").alias("trace"), "query")


# ------------------------------------------------------------------ prep

from ..operators import prep as P  # noqa: E402

EXAM_FILL = {"symptom": "无", "lung_result": "无", "spare_result": "已成"}
EXAM_BINARY = ["symptom", "chest_judgment", "lung_result", "tenure"]
EXAM_PRIVACY = ["name"]
EXAM_UNIT_KEYWORDS = ["unit"]
EXAM_MARKER_KEYWORDS = ["marker"]
FIXED_HAZARDS = ["STANDARD", "SMALL", "LARGE", "LARGE、XL", "PROMO", "BRASS"]


@query("norm_values")
def q_norm_values(spark: SparkSession, sf: str) -> DataFrame:
    df = P.normalize_values(X.exam(spark, sf))
    return df.select("record_id", *X.EXAM_TEXT_COLUMNS)


@query("fill_rules")
def q_fill_rules(spark: SparkSession, sf: str) -> DataFrame:
    return P.fill_values(X.exam(spark, sf), EXAM_FILL).select("record_id", *EXAM_FILL)


@query("binary_flags")
def q_binary_flags(spark: SparkSession, sf: str) -> DataFrame:
    return P.binary_flags(X.exam(spark, sf), EXAM_BINARY).select("record_id", *EXAM_BINARY)


@query("duration_months")
def q_duration_months(spark: SparkSession, sf: str) -> DataFrame:
    df = X.exam(spark, sf).select("record_id", "tenure", F.col("tenure").alias("months"))
    return P.durations_to_months(df, ["months"], with_valid=True).withColumnRenamed("months_valid", "valid")


@query("marker_fill")
def q_marker_fill(spark: SparkSession, sf: str) -> DataFrame:
    df = P.fill_markers(X.exam(spark, sf), EXAM_MARKER_KEYWORDS)
    return df.select("record_id", *[c for c in df.columns if "marker" in c])


@query("hazard_top")
def q_hazard_top(spark: SparkSession, sf: str) -> DataFrame:
    t = P.top_tokens(X.exam(spark, sf), "exposure")
    return t.select("token", "n", F.round("share", 6).alias("share"))


def _dummies_long(df: DataFrame, vocab: list[str]) -> DataFrame:
    cols = [C.HAZARD_PREFIX + t for t in vocab]
    long = df.select("record_id", *[F.col(f"`{c}`") for c in cols]).unpivot("record_id", cols, "hazard", "flag")
    return long.where(F.col("flag") == 1).select("record_id", "hazard")


@query("hazard_dummies")
def q_hazard_dummies(spark: SparkSession, sf: str) -> DataFrame:
    df = X.exam(spark, sf)
    # the fitted top-20 vocabulary is the one small driver-side result (bounded by k)
    vocab = [r["token"] for r in P.top_tokens(df, "exposure").collect()]
    return _dummies_long(P.hazard_dummies(df, "exposure", vocab), vocab)


@query("hazard_dummies_fixed")
def q_hazard_dummies_fixed(spark: SparkSession, sf: str) -> DataFrame:
    df = X.exam(spark, sf)
    return _dummies_long(P.hazard_dummies(df, "exposure", FIXED_HAZARDS, delims=",、"), FIXED_HAZARDS)


SMART_TYPE_COLUMNS = [c for c in ["job", "gender", "age", "tenure", "exposure", "sbp_result", "sbp_unit", "sbp_marker",
                                  "dbp_result", "glucose_result", "lung_result", "chest_judgment", "chest_marker",
                                  "hearing_high_result", "hearing_high_marker", "hearing_speech_result",
                                  "hearing_speech_marker", "symptom", "spare_result"]]


@query("smart_types")
def q_smart_types(spark: SparkSession, sf: str) -> DataFrame:
    df = X.exam(spark, sf).select(*SMART_TYPE_COLUMNS)
    total = df.select(F.count(F.lit(1))).scalar()
    shares = df.agg(*[F.sum(P.strict_double(F.col(c)).isNotNull().cast("long")).alias(c) for c in SMART_TYPE_COLUMNS])
    long = shares.unpivot([], SMART_TYPE_COLUMNS, "column_name", "n_numeric")
    rate = F.col("n_numeric") / total
    return long.select("column_name", F.round(rate, 6).alias("conversion_rate"),
                       F.when(rate > 0.8, "numeric").otherwise("categorical").alias("kind"))


@query("prep_report")
def q_prep_report(spark: SparkSession, sf: str) -> DataFrame:
    df = X.exam(spark, sf)
    plan = P.fit_clean(df, privacy=EXAM_PRIVACY, unit_keywords=EXAM_UNIT_KEYWORDS, other=[])
    cleaned = P.apply_clean(df, plan)
    rows = P.report_rows(plan)
    rows += [("shape", 0, f"{plan.rows}x{plan.original_columns}"), ("shape", 1, f"{plan.rows}x{len(cleaned.columns)}")]
    return spark.createDataFrame(rows, "step string, pos int, column_name string")


# ------------------------------------------------------------------ profile, labels, records

from ..functions import text as T  # noqa: E402
from ..operators import profile as PR  # noqa: E402

PROBE_KEYWORD = "result"
SEARCH_KEYWORDS = ["result", "marker", "hearing", "unit", "????"]
AGREE_FIRST = [C.LABELS[3], C.LABELS[4]]


@query("missing_ratio")
def q_missing_ratio(spark: SparkSession, sf: str) -> DataFrame:
    df = X.exam(spark, sf)
    return P.missing_ratio(df).select(F.col("column").alias("column_name"),
                                      F.round("missing_ratio", 6).alias("missing_ratio"))


@query("column_profile")
def q_column_profile(spark: SparkSession, sf: str) -> DataFrame:
    df = X.exam(spark, sf)
    cols = P.string_columns(df)
    # one row per distinct (column, value), counted per task first; no copy of the table per column
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column_name", "value")
    values = long.groupBy("column_name", "value").agg(F.count("value").alias("n"))
    return values.groupBy("column_name").agg(F.count("value").alias("n_distinct"), F.sum("n").alias("non_null")).select(
        "column_name", "n_distinct", "non_null", (F.col("n_distinct") == 1).alias("single_value"))


@query("label_distribution")
def q_label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    df = X.exam(spark, sf)
    raw = PR.label_distribution(df, F.col("label"), "raw")
    clean = _label_codes(spark, df)
    filtered = PR.label_distribution(clean, F.col("y").cast("string"), "filtered")
    return raw.unionByName(filtered).select("stage", "label", "n", F.round("pct", 6).alias("pct"))


def _label_dim(spark: SparkSession) -> DataFrame:
    rows = [(text, code) for code, text in C.LABELS.items()]
    return spark.createDataFrame(rows, "label_text string, code int")


def _label_codes(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Null labels dropped, text -> code (broadcast dim), codes 3/4 excluded, 5 -> 2; an unknown label is an error."""
    text = _label_text(F.col("label"))
    dim = F.broadcast(_label_dim(spark))   # five rows: size bound by the label dictionary
    coded = df.where(F.col("label").isNotNull()).select("record_id", text.alias("label_text")) \
        .join(dim, "label_text", "left")
    known = F.coalesce(F.col("code"), F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(
        "label_text", F.lit("(not in the dictionary)")))).cast("int"))
    coded = coded.withColumn("code", known)
    y = F.col("code")
    for src, dst in C.REMAP_CODES.items():
        y = F.when(y == src, dst).otherwise(y)
    return coded.where(~F.col("code").isin(*C.EXCLUDED_CODES)).select("record_id", y.alias("y"))


@query("label_clean")
def q_label_clean(spark: SparkSession, sf: str) -> DataFrame:
    return _label_codes(spark, X.exam(spark, sf))


@query("label_unknown")
def q_label_unknown(spark: SparkSession, sf: str) -> DataFrame:
    # raw fixture labels checked against the conclusion dictionary, as the loader does before training
    df = X.exam(spark, sf).where(F.col("label").isNotNull())
    dim = F.broadcast(_label_dim(spark))
    unknown = df.join(dim, df.label == dim.label_text, "left_anti")
    return unknown.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("completeness")
def q_completeness(spark: SparkSession, sf: str) -> DataFrame:
    df = X.exam(spark, sf)
    cols = df.columns
    return df.select("record_id", PR.non_null_count(cols).alias("field_score"),
                     PR.non_empty_count(cols).alias("non_empty"))


@query("value_probe")
def q_value_probe(spark: SparkSession, sf: str) -> DataFrame:
    df = X.exam(spark, sf)
    cols = [c for c in df.columns if PROBE_KEYWORD in c]
    return PR.value_probe(df, cols, 10).select("column_name", "value", "n", F.col("rank").cast("int").alias("rank"))


@query("column_search")
def q_column_search(spark: SparkSession, sf: str) -> DataFrame:
    cols = X.exam(spark, sf).columns
    return spark.createDataFrame(PR.column_search(cols, SEARCH_KEYWORDS), "keyword string, pos int, column_name string")


@query("samples_per_label")
def q_samples_per_label(spark: SparkSession, sf: str) -> DataFrame:
    df = X.exam(spark, sf).select("record_id", "label", "sbp_result", "glucose_result", "tenure")
    return PR.samples_per_label(df, "label", [F.col("record_id")], 5)


@query("demo_samples")
def q_demo_samples(spark: SparkSession, sf: str) -> DataFrame:
    df = evaluate_rules(X.exam(spark, sf), exam_rules())
    cols = [c for c in df.columns if c != "rule_hit"]
    picked = PR.demo_samples(df, _label_text(F.col("label")), F.col("rule_hit.label"), PR.non_null_count(cols),
                             F.col("record_id"), AGREE_FIRST)
    return picked.select(F.concat_ws("_", "expected_label", F.col("record_id").cast("string")).alias("sample_id"),
                         "expected_label", "record_id", F.coalesce("expert_hit", F.lit("")).alias("expert_hit"),
                         "field_score", F.col("sample_rank").cast("int").alias("sample_rank"))


@query("sparse_record")
def q_sparse_record(spark: SparkSession, sf: str) -> DataFrame:
    df = X.exam(spark, sf).drop(*X.EXAM_PRIVACY, "label")
    entries = [x for c in df.columns if c != "record_id" for x in (F.lit(c), T.as_text(F.col(c)))]
    m = F.map_filter(F.create_map(*entries), lambda k, v: v.isNotNull())
    return df.select("record_id", F.to_json(m).alias("record_json"), F.size(m).alias("n_fields"))


@query("sanitize_names")
def q_sanitize_names(spark: SparkSession, sf: str) -> DataFrame:
    docs = X.read_table(spark, sf, "documents", "doc_id", "text")
    name = T.sanitize_name(F.col("text"))
    return docs.select("doc_id", name.alias("file_name"), P.base_feature_name(name).alias("base_name"))


@query("safe_float")
def q_safe_float(spark: SparkSession, sf: str) -> DataFrame:
    df = X.exam(spark, sf)
    return df.select("record_id", T.safe_float("sbp_result").alias("sbp"), T.safe_float("glucose_result").alias("glucose"),
                     T.safe_float("lung_result", None).alias("lung"), T.safe_float("tenure", -1.0).alias("tenure"))


@query("norm_ws")
def q_norm_ws(spark: SparkSession, sf: str) -> DataFrame:
    docs = X.read_table(spark, sf, "documents", "doc_id", "text")
    n = T.norm_ws("text")
    return docs.select("doc_id", F.length(n).cast("bigint").alias("n_chars"), F.md5(n).alias("text_md5"))


# ------------------------------------------------------------------ metrics over PRED

from ..operators import metrics as M  # noqa: E402

PROBS = ["p0", "p1", "p2"]


def _r6(c: str) -> F.Column:
    return F.round(F.col(c), 6).alias(c)


@query("confusion_matrix")
def q_confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    cells = M.confusion_cells(X.pred(spark, sf))
    names = F.create_map(*[x for k in C.THREE_CLASS for x in (F.lit(k), F.lit(C.LABELS[k]))])
    wide = cells.groupBy("model", "y").pivot("p", list(C.THREE_CLASS)).agg(F.sum("n").cast("bigint")).fillna(0)
    return wide.select("model", names[F.col("y")].alias("true_label"),
                       *[F.col(str(k)).alias(f"n_pred_{k}") for k in C.THREE_CLASS])


@query("per_class_metrics")
def q_per_class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    ct = M.class_table(M.confusion_cells(X.pred(spark, sf)))
    pc = M.per_class_metrics(ct)
    return pc.select("model", F.col("cls").cast("int").alias("cls"),
                     *[F.col(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn", "tn")],
                     *[_r6(c) for c in ("precision", "recall", "f1", "specificity", "npv")])


def _all_metrics(pred: DataFrame) -> DataFrame:
    s = M.summary_metrics(M.class_table(M.confusion_cells(pred)))
    return s.join(M.brier(pred, PROBS), "model").join(M.auc_ovo(pred, PROBS), "model")


ALL_METRICS = M.ALL_METRICS


@query("metrics_all")
def q_metrics_all(spark: SparkSession, sf: str) -> DataFrame:
    """The ten metrics in long form, for every model."""
    wide = _all_metrics(X.pred(spark, sf))
    return wide.unpivot(["model"], ALL_METRICS, "metric", "value").select("model", "metric", _r6("value"))


@query("metrics_by_model")
def q_metrics_by_model(spark: SparkSession, sf: str) -> DataFrame:
    return _all_metrics(X.pred(spark, sf)).select("model", *[_r6(c) for c in ALL_METRICS])


@query("brier_score")
def q_brier_score(spark: SparkSession, sf: str) -> DataFrame:
    return M.brier(X.pred(spark, sf), PROBS).select("model", _r6("brier"))


@query("auc_ovo")
def q_auc_ovo(spark: SparkSession, sf: str) -> DataFrame:
    return M.auc_ovo(X.pred(spark, sf), PROBS).select("model", _r6("auc_ovo_macro"))


@query("bootstrap_ci")
def q_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    out = M.bootstrap_ci(X.pred(spark, sf), PROBS)
    return out.select("model", "metric", *[_r6(c) for c in ("estimate", "boot_mean", "lo", "hi")],
                      F.col("n_replicates").cast("bigint").alias("n_replicates"))


@query("argmax_label")
def q_argmax_label(spark: SparkSession, sf: str) -> DataFrame:
    pred = X.pred(spark, sf)
    idx = H.argmax_index([F.col(c) for c in PROBS])
    names = F.array(*[F.lit(C.LABELS[k]) for k in C.THREE_CLASS])
    return pred.select("model", "row_id", idx.alias("pred_idx"), F.element_at(names, idx + 1).alias("label"),
                       F.round(F.greatest(*PROBS), 6).alias("p_max"))


@query("prob_display")
def q_prob_display(spark: SparkSession, sf: str) -> DataFrame:
    pred = X.pred(spark, sf)
    entries = F.array(*[F.struct(F.col(c).alias("prob"), F.lit(i).alias("idx"), F.lit(C.LABELS[i]).alias("label"))
                        for i, c in enumerate(PROBS)])
    ordered = F.array_sort(entries, lambda l, r: F.when(l["prob"] > r["prob"], -1).when(l["prob"] < r["prob"], 1)
                           .otherwise(l["idx"] - r["idx"]))
    text = F.array_join(F.transform(ordered, lambda e: F.concat(
        e["label"], F.lit("="), H.prob_display(e["prob"]), F.lit("|"),
        F.format_string("%.2f", F.bround(H.bar_width(e["prob"]), 2)))), ";")
    return pred.select("model", "row_id", text.alias("display"))


@query("explain_sample")
def q_explain_sample(spark: SparkSession, sf: str) -> DataFrame:
    """C.EXPLAIN_SAMPLE rows of every model to explain (the sampling is the feature), least portable hashes first."""
    pred = X.pred(spark, sf).select("model", "row_id", "y", "p").withColumn(
        "h", T.portable_hash("explain", F.col("row_id")))
    return PR.least_per_group(pred, ["model"], ["h", "row_id"], C.EXPLAIN_SAMPLE).select("model", "row_id", "y", "p")
