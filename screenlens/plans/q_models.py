"""Catalogue: scorecards over PRED, feature operators over lineitem/EXAM, kNN and SMOTE over VEC, Spark ML fits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import features as FE
from ..operators import metrics as M
from ..operators import retrieval as RV
from ..functions.text import portable_hash
from ..operators import serving as SV
from ..sources import fixtures as X
from ..sources.tables import ensure_checkpoint_dir, spread, stored
from ..streaming import stream as ST
from .catalog import FIXED_HAZARDS, _label_codes, query

# fixed fixture parameters: training times per model, linear model over lineitem features
TRAIN_SECONDS = {"m0": 12.5, "m1": 3.25, "m2": 0.75}
RETRAINED = {"m1": 4.0, "m2": 0.75}
CI_REPLICATES = C.BOOTSTRAP_REPLICATES
CARD_METRICS = M.ALL_METRICS
LI_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net_price", "charge", "line_no"]
ATTR_FEATURES = [*LI_FEATURES, "discount_sum", "tax_sum"]       # more than the eight that are kept per row
COEF = {"A": [0.8, -0.2, 0.5, 0.1, -0.3, 0.05, 0.2, 0.15, -0.25], "N": [-0.4, 0.6, -0.1, 0.3, 0.2, -0.5, 0.1, -0.35, 0.45],
        "R": [0.1, 0.1, -0.6, -0.2, 0.4, 0.3, -0.3, 0.25, 0.15]}
INTERCEPT = {"A": 0.0, "N": 0.1, "R": -0.1}
CAT_COLUMNS = ["job", "gender", "chest_judgment", "lung_result", "symptom"]
KNN_K = 5
FILE_ROWS = 100_000         # of a file that is landed for a stream


def _r6(c: str) -> F.Column:
    return F.round(F.col(c), 6).alias(c)


def scorecard(spark: SparkSession, sf: str, times: dict[str, float] = TRAIN_SECONDS) -> DataFrame:
    """SCORECARD: point metrics per model, bootstrap bounds of all ten, training seconds."""
    pred = X.pred(spark, sf)
    point = stored(M.point_metrics(pred, ["p0", "p1", "p2"]), "points")     # one row per model, read three times
    ci = M.bootstrap_ci(pred, ["p0", "p1", "p2"], replicates=CI_REPLICATES, point=point).where(
        F.col("metric").isin(*CARD_METRICS))
    bounds = ci.groupBy("model").pivot("metric", CARD_METRICS).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    bounds = bounds.select("model", *[F.col(f"{m}_{b}") for m in CARD_METRICS for b in ("lo", "hi")])
    tmap = F.create_map(*[x for k, v in times.items() for x in (F.lit(k), F.lit(float(v)))])
    return point.join(bounds, "model", "left").withColumn("train_seconds", tmap[F.col("model")])


@query("scorecard_upsert")
def q_scorecard_upsert(spark: SparkSession, sf: str) -> DataFrame:
    pred = X.pred(spark, sf)
    point = M.summary_metrics(M.class_table(M.confusion_cells(pred))).select("model", "accuracy", "f1_macro")

    def with_time(df: DataFrame, times: dict[str, float]) -> DataFrame:
        tmap = F.create_map(*[x for k, v in times.items() for x in (F.lit(k), F.lit(float(v)))])
        return df.where(F.col("model").isin(*times)).withColumn("train_seconds", tmap[F.col("model")])

    old = with_time(point, {k: v for k, v in TRAIN_SECONDS.items() if k != "m2"})
    new = with_time(point, RETRAINED)
    return FE.upsert(old, new).select("model", _r6("accuracy"), _r6("f1_macro"), "train_seconds")


@query("model_ranking")
def q_model_ranking(spark: SparkSession, sf: str) -> DataFrame:
    r = FE.ranking(scorecard(spark, sf))
    # one row per model: a global window over a handful of rows
    return r.select("model", _r6("composite"), _r6("time_share"),
                    F.rank().over(Window.orderBy(F.desc("composite"))).cast("int").alias("rank"))


@query("model_radar")
def q_model_radar(spark: SparkSession, sf: str) -> DataFrame:
    r = FE.radar(scorecard(spark, sf))
    return r.select("model", "metric", _r6("value_scaled"), _r6("lo_scaled"), _r6("hi_scaled"))


@query("ci_long")
def q_ci_long(spark: SparkSession, sf: str) -> DataFrame:
    card = scorecard(spark, sf)
    long = card.select("model", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.col(f"{m}_lo").alias("lower"),
                 F.col(f"{m}_hi").alias("upper")) for m in CARD_METRICS])).alias("s")).select("model", "s.*")
    return long.select("model", "metric", _r6("value"), _r6("lower"), _r6("upper"),
                       F.round(F.col("value") - F.col("lower"), 6).alias("err_low"),
                       F.round(F.col("upper") - F.col("value"), 6).alias("err_high"))


# ------------------------------------------------------------------ lineitem features

def lineitem_features(spark: SparkSession, sf: str) -> DataFrame:
    li = X.read_table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                      "l_discount", "l_tax", "l_returnflag")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("double").alias("line_no"), "l_quantity",
                     "l_extendedprice", "l_discount", "l_tax", net.alias("net_price"),
                     (net * (1 + F.col("l_tax"))).alias("charge"),
                     (F.col("l_extendedprice") * F.col("l_discount")).alias("discount_sum"),
                     (F.col("l_extendedprice") * F.col("l_tax")).alias("tax_sum"), F.col("l_returnflag").alias("cls"))


def _scaled(spark: SparkSession, sf: str) -> DataFrame:
    df = lineitem_features(spark, sf)
    return FE.standard_scale(df, FE.fit_standard_scaler(df, ATTR_FEATURES))


@query("standard_scale")
def q_standard_scale(spark: SparkSession, sf: str) -> DataFrame:
    return _scaled(spark, sf).select("l_orderkey", "l_linenumber", *[_r6(f) for f in LI_FEATURES])


@query("gaussian_nb_stats")
def q_gaussian_nb_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = FE.gaussian_nb_stats(lineitem_features(spark, sf), "cls", LI_FEATURES)
    return s.select("cls", "feature", "n", _r6("prior"), _r6("mean"), _r6("var"))


def _attr(spark: SparkSession, sf: str) -> DataFrame:
    # lineitem has no unique key: (orderkey, linenumber) repeats, so each row carries its own id
    rows = _scaled(spark, sf).withColumn("row_key", F.monotonically_increasing_id())
    return FE.linear_attributions(rows, ["row_key", "l_orderkey", "l_linenumber"], ATTR_FEATURES, COEF, INTERCEPT)


@query("feature_importance")
def q_feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    imp = FE.mean_abs_attribution(_attr(spark, sf))
    return imp.select("feature", "cls", _r6("mean_abs"),
                      F.substring_index("feature", "_", 1).alias("base_name"))


@query("top_features")
def q_top_features(spark: SparkSession, sf: str) -> DataFrame:
    t = FE.row_top_attributions(_scaled(spark, sf), ["l_orderkey", "l_linenumber"], ATTR_FEATURES, COEF, INTERCEPT)
    return t.select("l_orderkey", "l_linenumber", "predicted", F.col("rank").cast("int").alias("rank"), "feature",
                    _r6("contribution"))


# ------------------------------------------------------------------ EXAM features

def _split(spark: SparkSession, sf: str) -> DataFrame:
    return FE.stratified_split(_label_codes(spark, X.exam(spark, sf)), "y", "record_id")


@query("stratified_split")
def q_stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return _split(spark, sf).select("record_id", "y", "split")


@query("category_encode")
def q_category_encode(spark: SparkSession, sf: str) -> DataFrame:
    ex = X.exam(spark, sf)
    vocab = FE.fit_vocabulary(ex, CAT_COLUMNS)
    return FE.encode(ex, ["record_id"], CAT_COLUMNS, vocab).select("record_id", "column_name", "code")


def _train(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """EXAM, its split and its training side."""
    ex = X.exam(spark, sf)
    split = _split(spark, sf).select("record_id", "y", "split")
    return ex, split, ex.join(split.where(F.col("split") == "train").select("record_id"), "record_id", "left_semi")


@query("safe_encode")
def q_safe_encode(spark: SparkSession, sf: str) -> DataFrame:
    ex, _, train = _train(spark, sf)
    plan, vocabulary = SV.fit_plan(train, [], CAT_COLUMNS)
    coded = SV.transform(ex, plan, ["record_id"], vocabulary)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("int").alias("code"))
                               for c in CAT_COLUMNS]))
    return coded.select("record_id", each.alias("c")).select("record_id", "c.*")


ALIGN_NUMERIC = ["age", "hearing_high_result", "hearing_speech_result", "dbp_result", "absent_numeric"]
ALIGN_CATEGORICAL = ["job", "gender", "chest_judgment", "absent_category"]


@query("align_features")
def q_align_features(spark: SparkSession, sf: str) -> DataFrame:
    """Impose a frozen model schema: add absent columns (0 / ''), coerce numerics, safe-encode categories."""
    ex, _, train = _train(spark, sf)
    plan, vocabulary = SV.fit_plan(train, ALIGN_NUMERIC, ALIGN_CATEGORICAL)
    return SV.transform(ex, plan, ["record_id"], vocabulary)


# a served schema with a filled column, a long vocabulary (name: one value per customer), a category without codes
# (dbp_result, read as a number), columns that no record has, and hazard tokens
SERVE_NUMERIC = ["age", "sbp_result", "glucose_result", "absent_numeric"]
SERVE_FILLS = {"sbp_result": "120"}
SERVE_CODED = ["job", "gender", "symptom", "name"]
SERVE_CATEGORICAL = [*SERVE_CODED, "dbp_result", "absent_category"]


def _artefacts(spark: SparkSession, sf: str) -> tuple[DataFrame, SV.Artefacts]:
    """EXAM, and the bundle fitted on its training side, stored and read back."""
    ex, split, train = _train(spark, sf)
    plan, vocabulary = SV.fit_plan(train, SERVE_NUMERIC, SERVE_CATEGORICAL, encoded=SERVE_CODED, fills=SERVE_FILLS,
                                   hazard_column="exposure", hazard_tokens=FIXED_HAZARDS, hazard_delims=",、")
    numbers = SV.transform(train, SV.FeaturePlan(SERVE_NUMERIC, [], SERVE_FILLS), [])
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/artefacts-{uuid.uuid4().hex}"
    SV.save_artefacts(spark, folder, plan, vocabulary, split, FE.fit_standard_scaler(numbers, SERVE_NUMERIC))
    return ex, SV.load_artefacts(spark, folder)


def _named(df: DataFrame) -> DataFrame:
    return df.toDF(*["hazard_" + str(FIXED_HAZARDS.index(c[len(C.HAZARD_PREFIX):])) if c.startswith(C.HAZARD_PREFIX) else c
                     for c in df.columns])


@query("serve_features")
def q_serve_features(spark: SparkSession, sf: str) -> DataFrame:
    """The stored plan over all records."""
    ex, kept = _artefacts(spark, sf)
    return _named(kept.transform(ex, ["record_id"]))


@query("stream_features")
def q_stream_features(spark: SparkSession, sf: str) -> DataFrame:
    """The stored plan over a stream of the same records; the sink equals the batch."""
    ex, kept = _artefacts(spark, sf)
    base = ST.scratch_dir(spark, "stream-features")
    spread(ex.drop("exam_date"), "record_id").write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{base}/source")
    ST.stream_features(spark, f"{base}/source", kept, ["record_id"], f"{base}/sink", f"{base}/checkpoint")
    return _named(spark.read.parquet(f"{base}/sink"))


@query("training_artefacts")
def q_training_artefacts(spark: SparkSession, sf: str) -> DataFrame:
    """What the stored bundle holds: split sizes, vocabulary sizes, feature order, scaler."""
    _, kept = _artefacts(spark, sf)
    row = lambda kind, name, value: [F.lit(kind).alias("kind"), name.alias("name"),
                                     F.round(value.cast("double"), 6).alias("value")]
    split = kept.split.groupBy("split", "y").agg(F.count("*").alias("n"))
    return (split.select(*row("split", F.concat_ws(":", "split", F.col("y").cast("string")), F.col("n")))
            .union(kept.vocabulary.groupBy("column_name").agg(F.count("*").alias("n"))
                   .select(*row("vocabulary", F.col("column_name"), F.col("n"))))
            .union(kept.features.select(*row("feature", F.regexp_replace("feature", f"^{C.HAZARD_PREFIX}", "hazard:"),
                                             F.col("position"))))
            .union(kept.scaler.select(*row("mean", F.col("feature"), F.col("mean"))))
            .union(kept.scaler.select(*row("std", F.col("feature"), F.col("std")))))


# ------------------------------------------------------------------ VEC: kNN, SMOTE

def _vec(spark: SparkSession, sf: str) -> DataFrame:
    return X.read_table(spark, sf, "embeddings", "vec_id", "embedding", "label")


@query("knn_classify")
def q_knn_classify(spark: SparkSession, sf: str) -> DataFrame:
    v = _vec(spark, sf)
    nb = RV.vector_topk(v, "vec_id", "embedding", KNN_K, metric="l2").withColumn(
        "dist", F.sqrt(F.greatest(-F.col("score"), F.lit(0.0))))
    votes = FE.knn_vote(nb, v.select(F.col("vec_id").alias("id"), "label"))
    return v.select(F.col("vec_id").alias("qid"), "label").join(votes, "qid").select(
        F.col("qid").alias("vec_id"), "label", "pred_uniform", "pred_distance")


@query("smote")
def q_smote(spark: SparkSession, sf: str) -> DataFrame:
    """Synthetic minority rows: each class is topped up to the largest class's size; synthetic row j takes a
    hash-chosen base row, one of its 5 nearest same-class neighbours and a hash-drawn gap."""
    from ..operators.ids import group_row_number
    v = _vec(spark, sf)
    sizes = v.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    draws = FE.oversampling_draws(sizes)
    key = F.concat(F.col("label").cast("string"), F.lit(":"), F.col("j").cast("string"))
    draws = draws.withColumn("base_pos", F.pmod(portable_hash("smote-base", key), F.col("n")) + 1) \
        .withColumn("nn_rank", (F.pmod(portable_hash("smote-nn", key), F.lit(KNN_K)) + 1).cast("int"))
    draws = M.with_mix_uniform(draws, F.col("j"), F.col("label"), "gap")
    pos = group_row_number(v.select("vec_id", "label"), ["label"], ["vec_id"], "pos").drop("group_size")
    base = draws.join(pos, (draws.label == pos.label) & (draws.base_pos == pos.pos)).select(
        draws.label, "j", "nn_rank", "gap", F.col("vec_id").alias("base_id"))
    nbrs = RV.vector_topk(v, "vec_id", "embedding", KNN_K, group="label", metric="l2").select(
        F.col("qid").alias("base_id"), F.col("cid").alias("neighbor_id"), F.col("rank").alias("nn_rank"))
    picked = base.join(nbrs, ["base_id", "nn_rank"])
    emb = v.select("vec_id", "embedding")
    both = picked.join(emb.withColumnRenamed("vec_id", "base_id").withColumnRenamed("embedding", "b"), "base_id") \
        .join(emb.withColumnRenamed("vec_id", "neighbor_id").withColumnRenamed("embedding", "nb"), "neighbor_id")
    synth = F.zip_with(F.col("b").cast("array<double>"), F.col("nb").cast("array<double>"),
                       lambda x, y: x + F.col("gap") * (y - x))
    # computed before the projection that rounds the gap
    text = F.array_join(F.transform("x", lambda x: F.floor(x * 1e4).cast("bigint").cast("string")), ",")
    return both.withColumn("x", synth).select("label", "j", "base_id", "neighbor_id", _r6("gap"), text.alias("x_e4"))
