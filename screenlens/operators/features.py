"""Feature engineering and model-side operators: scaling, label encoding,
stratified split, Gaussian naive-Bayes statistics, linear attributions,
kNN classification, scorecards.

Fitting is an aggregate (one small result: means, variances, vocabularies);
applying it is a projection or a broadcast join against that small result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import portable_hash
from .ids import group_row_number
from .serving import category_value, fit_vocabulary  # noqa: F401  (vocabularies are part of the serving plan)


def q(c: str) -> Column:
    return F.col(f"`{c}`")


# ------------------------------------------------------------------ M3 standard scaling

def fit_standard_scaler(df: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and *population* standard deviation per feature (one aggregate job, one small row)."""
    row = df.agg(*[x for f in features for x in (F.avg(q(f)).alias(f"m_{f}"), F.stddev_pop(q(f)).alias(f"s_{f}"))]).first()
    return {f: (row[f"m_{f}"], row[f"s_{f}"]) for f in features}


def standard_scale(df: DataFrame, stats: Mapping[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    """z = (x - mean) / std; a constant column (std 0) scales to 0."""
    cols = {}
    for f, (m, s) in stats.items():
        cols[f + suffix] = (q(f) - F.lit(m)) / F.lit(s) if s and s > 0 else F.lit(0.0)
    return df.withColumns(cols)


# ------------------------------------------------------------------ M2 label encoding

def encode(df: DataFrame, key: Sequence[str], columns: Sequence[str], vocab: DataFrame) -> DataFrame:
    """Long (key..., column_name, value, code); null where the vocabulary lacks the value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), category_value(c).alias("value"))
                                for c in columns]))
    return df.select(*key, pairs.alias("p")).select(*key, "p.*").join(vocab, ["column_name", "value"], "left")


# ------------------------------------------------------------------ M1 stratified split

def stratified_split(df: DataFrame, label: str, key: str, test_share: float = C.TEST_SHARE,
                     seed: int = C.SEED) -> DataFrame:
    """Per class, order rows by a portable hash of the key and send the first round(share * n) to test.

    Exact class shares (unlike ``sampleBy``), and the per-class numbering is distributed
    (``ids.group_row_number``), so a class holding a third of the table is not one task.
    """
    staged = df.withColumn("__h", portable_hash(f"split{seed}", F.col(key)))
    numbered = group_row_number(staged, [label], ["__h", key], "__rn")
    test = F.col("__rn") <= F.round(F.col("group_size") * test_share)
    return numbered.withColumn("split", F.when(test, "test").otherwise("train")).drop("__h", "__rn", "group_size")


# ------------------------------------------------------------------ M9 Gaussian NB statistics

def gaussian_nb_stats(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Long (cls, feature, n, prior, mean, var) with population variance per class."""
    per = df.groupBy(F.col(label).alias("cls")).agg(
        F.count(F.lit(1)).alias("n"), *[x for f in features for x in (F.avg(q(f)).alias(f"m_{f}"),
                                                                       F.var_pop(q(f)).alias(f"v_{f}"))])
    total = df.select(F.count(F.lit(1))).scalar()
    long = per.select("cls", "n", (F.col("n") / total).alias("prior"),
                      F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"m_{f}").alias("mean"),
                                                   F.col(f"v_{f}").alias("var")) for f in features])).alias("s"))
    return long.select("cls", F.col("s.feature").alias("feature"), "n", "prior", F.col("s.mean").alias("mean"),
                       F.col("s.var").alias("var"))


# ------------------------------------------------------------------ M14 / A21 linear attributions

def linear_attributions(df: DataFrame, key: Sequence[str], features: Sequence[str],
                        coef: Mapping[str, Sequence[float]], intercept: Mapping[str, float]) -> DataFrame:
    """Long (key..., cls, feature, contribution, predicted) with contribution = coef[cls][f] * z_f.

    ``df`` holds standardised features; ``predicted`` is the argmax class of intercept + sum of contributions
    (ties: first class in ``coef`` order)."""
    classes = list(coef)
    scores = [F.lit(float(intercept.get(k, 0.0))) + sum((F.lit(float(c)) * q(f) for c, f in zip(coef[k], features)),
                                                         F.lit(0.0)) for k in classes]
    best = F.greatest(*scores)
    pred = None
    for k, s in zip(classes, scores):
        pred = F.when(s == best, F.lit(k)) if pred is None else pred.when(s == best, F.lit(k))
    items = F.array(*[F.struct(F.lit(k).alias("cls"), F.lit(f).alias("feature"),
                               (F.lit(float(coef[k][i])) * q(f)).alias("contribution"))
                      for k in classes for i, f in enumerate(features)])
    return df.select(*key, pred.alias("predicted"), F.inline(items))


def mean_abs_attribution(attr: DataFrame) -> DataFrame:
    """Mean |contribution| per (feature, class) and per feature over all classes (cls = '*')."""
    per_cls = attr.groupBy("feature", "cls").agg(F.avg(F.abs("contribution")).alias("mean_abs"))
    overall = attr.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs")).withColumn("cls", F.lit("*"))
    return per_cls.unionByName(overall)


def top_attributions(attr: DataFrame, key: Sequence[str], n: int = C.TOP_ATTRIBUTIONS) -> DataFrame:
    """Per row: the predicted class's top-n contributions by |value| (ties: feature name)."""
    own = attr.where(F.col("cls") == F.col("predicted"))
    w = Window.partitionBy(*key).orderBy(F.desc(F.abs("contribution")), F.asc("feature"))
    return own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def row_top_attributions(df: DataFrame, key: Sequence[str], features: Sequence[str], coef: Mapping[str, Sequence[float]],
                         intercept: Mapping[str, float], n: int = C.TOP_ATTRIBUTIONS) -> DataFrame:
    """(key..., predicted, rank, feature, contribution): the same top-n, sorted inside each row, without a shuffle."""
    classes = list(coef)
    parts = {k: F.array(*[F.struct((-F.abs(F.lit(float(c)) * q(f))).alias("o"), F.lit(f).alias("feature"),
                                   (F.lit(float(c)) * q(f)).alias("contribution"))
                          for c, f in zip(coef[k], features)]) for k in classes}
    scores = [F.lit(float(intercept.get(k, 0.0))) + sum((F.lit(float(c)) * q(f) for c, f in zip(coef[k], features)),
                                                         F.lit(0.0)) for k in classes]
    best = F.greatest(*scores)
    pred, own = F.lit(None).cast("string"), None
    for k, s in reversed(list(zip(classes, scores))):
        pred = F.when(s == best, F.lit(k)).otherwise(pred)
        own = parts[k] if own is None else F.when(s == best, parts[k]).otherwise(own)
    top = F.slice(F.array_sort(own), 1, n)
    return df.select(*key, pred.alias("predicted"), F.posexplode(top).alias("pos", "s")).select(
        *key, "predicted", (F.col("pos") + 1).alias("rank"), "s.feature", "s.contribution")


# ------------------------------------------------------------------ M8 kNN vote

def knn_vote(neighbors: DataFrame, labels: DataFrame, key: str = "qid", nkey: str = "cid") -> DataFrame:
    """Uniform and inverse-distance votes from (qid, cid, dist) neighbour lists; ties -> smallest label."""
    nb = neighbors.join(labels.select(F.col("id").alias(nkey), F.col("label").alias("nlabel")), nkey)
    w_dist = F.when(F.col("dist") == 0, F.lit(1e300)).otherwise(1.0 / F.col("dist"))
    votes = nb.groupBy(key, "nlabel").agg(F.count(F.lit(1)).alias("n"), F.sum(w_dist).alias("wsum"))
    wu = Window.partitionBy(key).orderBy(F.desc("n"), F.asc("nlabel"))
    wd = Window.partitionBy(key).orderBy(F.desc("wsum"), F.asc("nlabel"))
    u = votes.withColumn("r", F.row_number().over(wu)).where("r = 1").select(key, F.col("nlabel").alias("pred_uniform"))
    d = votes.withColumn("r", F.row_number().over(wd)).where("r = 1").select(key, F.col("nlabel").alias("pred_distance"))
    return u.join(d, key)


# ------------------------------------------------------------------ M4 draws for oversampling

def oversampling_draws(sizes: DataFrame) -> DataFrame:
    """label, n, j: for every class of ``sizes(label, n)`` the numbers 0.. of the rows that top it up to the largest class.

    All draws are one global range, split over tasks whatever class they fall to; a class holds the stretch that begins
    at the draws of the classes before it.  The broadcast table has one row per class.
    """
    spark = sizes.sparkSession
    most = sizes.select(F.max("n")).scalar()
    need = sizes.select("label", "n", (most - F.col("n")).alias("need")).where(F.col("need") > 0)
    before = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)     # over the classes only
    stretch = need.withColumn("start", F.coalesce(F.sum("need").over(before), F.lit(0)))
    total = need.agg(F.sum("need")).first()[0] or 0
    place = F.col("id")
    return spark.range(total).join(F.broadcast(stretch), (place >= F.col("start")) & (place < F.col("start") + F.col("need"))
                                   ).select("label", "n", (place - F.col("start")).alias("j"))


# ------------------------------------------------------------------ scorecards (K5, A19, A20, W6, M16)

def upsert(old: DataFrame, new: DataFrame, key: str = "model") -> DataFrame:
    """Replace rows of ``old`` whose key appears in ``new``; keep the rest; add the new ones."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def ranking(card: DataFrame, metrics: Sequence[str] = tuple(C.RADAR_METRICS), time_col: str = "train_seconds") -> DataFrame:
    composite = sum((F.col(m) for m in metrics), F.lit(0.0)) / len(metrics)
    total = F.sum(time_col).over(Window.partitionBy(F.lit(1)))      # one row per model; the card is computed once
    return card.select("model", composite.alias("composite"), (F.col(time_col) / total).alias("time_share"))


def radar(card: DataFrame, metrics: Sequence[str] = tuple(C.RADAR_METRICS)) -> DataFrame:
    """Min-max scale every metric across models; CI bounds use the point estimates' min and max."""
    long = card.select("model", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.col(f"{m}_lo").alias("lo"),
                 F.col(f"{m}_hi").alias("hi")) for m in metrics])).alias("s")).select("model", "s.*")
    of_metric = Window.partitionBy("metric")                        # one row per model; the card is computed once
    j = long.withColumns({"vmin": F.min("value").over(of_metric), "vmax": F.max("value").over(of_metric)})
    span = F.when(F.col("vmax") - F.col("vmin") > 0, F.col("vmax") - F.col("vmin")).otherwise(F.lit(1.0))
    return j.select("model", "metric", ((F.col("value") - F.col("vmin")) / span).alias("value_scaled"),
                    ((F.col("lo") - F.col("vmin")) / span).alias("lo_scaled"),
                    ((F.col("hi") - F.col("vmin")) / span).alias("hi_scaled"))
