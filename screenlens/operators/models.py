"""Fitted classifiers for records: train on the labelled matrix, predict a table, save and reload.

A candidate is a Spark ML pipeline (category indexing, one-hot, assembling, scaling, one model or an ensemble's stages).
Hyper-parameters are searched by a population over ranges on the macro-F1 of five folds (``search``).  Search and fit read
every labelled training row, dealt to tasks of ``FIT_PART_ROWS`` rows; prediction is a narrow transform.

``fit_or_load`` keeps the fitted pipelines under a folder: with the folder present, training is skipped.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import findings as H
from ..functions import text as T
from . import metrics as M
from .boosting import ODDS, samme, softmax_boosting
from .search import FOLDS, GENERATIONS, PARALLEL, POPULATION, Choice, Range, Space, TrialTable, fold_column, search

FIT_ROWS = 20_000       # training rows that one task holds as they come; more are dealt out
FIT_PART_ROWS = 100_000     # rows of a task then
PREFIX = "mx_"          # working columns of the matrix
EMPTY = "(empty)"       # Spark ML's column metadata takes no empty category name
N_CLASSES = len(C.THREE_CLASS)


def bounded_sample(df: DataFrame, key: str, rows: int = FIT_ROWS, seed: str = "fit") -> DataFrame:
    """At most ``rows`` rows, the same ones every time: the least portable hashes of the key.  No model is fitted on it."""
    h = T.portable_hash(seed, F.col(key))
    total = df.count()
    if total <= rows:
        return df
    share = min(1.0, 1.2 * rows / total)                 # thin first, so the exact cut sorts about ``rows`` rows
    return df.where(h < int(share * 2**32)).orderBy(h, key).limit(rows)


def with_matrix(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                months: Sequence[str] = ()) -> DataFrame:
    """Working columns: first numbers of free text (null -> 0 plus a missing flag), months, normalised categories."""
    cols: dict[str, Column] = {}
    for c in numeric:
        value = T.safe_float(F.col(c), None)
        cols[f"{PREFIX}n_{c}"] = F.coalesce(value, F.lit(0.0))
        cols[f"{PREFIX}m_{c}"] = value.isNull().cast("double")
    for c in months:
        cols[f"{PREFIX}d_{c}"] = T.duration_months(F.col(c)).cast("double")
    for c in categorical:
        value = T.norm_ws(F.col(c))
        cols[f"{PREFIX}c_{c}"] = F.when(value == "", F.lit(EMPTY)).otherwise(value)
    return df.withColumns(cols)


def _preparation(numeric: Sequence[str], categorical: Sequence[str], months: Sequence[str]) -> tuple[list, list[str]]:
    numbers = [f"{PREFIX}{kind}_{c}" for c in numeric for kind in ("n", "m")] + [f"{PREFIX}d_{c}" for c in months]
    cats = [f"{PREFIX}c_{c}" for c in categorical]
    index, hot = [f"{c}_i" for c in cats], [f"{c}_h" for c in cats]
    stages = [
        StringIndexer(inputCols=cats, outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=index, outputCols=hot, handleInvalid="keep"),
        VectorAssembler(inputCols=[*numbers, *hot], outputCol=f"{PREFIX}raw"),
        StandardScaler(inputCol=f"{PREFIX}raw", outputCol="features", withMean=True, withStd=True),
    ]
    return stages, numbers


class MacroF1(Evaluator):
    """Macro-F1 from the confusion cells: one aggregate, at most classes x classes rows to the driver."""

    def _evaluate(self, dataset: DataFrame) -> float:
        cells = dataset.groupBy("y", "prediction").count().collect()
        classes = {v for r in cells for v in (r["y"], r["prediction"])}
        scores = []
        for k in classes:
            hit = sum(r["count"] for r in cells if r["y"] == r["prediction"] == k)
            either = sum(r["count"] * ((r["y"] == k) + (r["prediction"] == k)) for r in cells)
            scores.append(2 * hit / either)
        return sum(scores) / len(scores) if scores else 0.0

    def isLargerBetter(self) -> bool:  # noqa: N802 - Spark ML's name
        return True


@dataclass(frozen=True)
class Candidate:
    """What can be fitted: parameter ranges, and (rows with y and features, parameters) -> pipeline stages."""

    space: Space
    stages: Callable[[DataFrame, dict], list]


def candidates(seed: int = C.SEED) -> dict[str, Candidate]:
    common = {"featuresCol": "features", "labelCol": "y"}

    def ml(make: Callable[..., Estimator]) -> Callable[[DataFrame, dict], list]:
        return lambda rows, params: [make(**params).fit(rows)]

    depth = Range(3, 9, whole=True)
    return {
        # elastic net 0 is the L2 penalty, 1 the L1 penalty
        "logistic": Candidate({"regParam": Range(1e-4, 0.3, log=True), "elasticNetParam": Choice((0.0, 1.0))},
                              ml(lambda **p: LogisticRegression(maxIter=30, **common, **p))),
        "tree": Candidate({"maxDepth": depth, "minInstancesPerNode": Range(1, 30, log=True, whole=True)},
                          ml(lambda **p: DecisionTreeClassifier(seed=seed, **common, **p))),
        "forest": Candidate({"maxDepth": depth, "numTrees": Range(10, 40, whole=True)},
                            ml(lambda **p: RandomForestClassifier(seed=seed, **common, **p))),
        "bayes": Candidate({}, ml(lambda **p: NaiveBayes(modelType="gaussian", **common, **p))),
        "boosted": Candidate({"maxIter": Range(3, 6, whole=True), "maxDepth": Range(2, 4, whole=True)},
                             ml(lambda **p: OneVsRest(classifier=GBTClassifier(seed=seed, **common, **p), **common))),
        "samme": Candidate({"rounds": Range(3, 6, whole=True), "max_depth": Range(1, 4, whole=True)},
                           lambda rows, p: samme(rows, N_CLASSES, seed=seed, **p)[0]),
        "softmax_boosting": Candidate({"rounds": Range(2, 4, whole=True), "max_depth": Range(2, 4, whole=True),
                                       "rate": Range(0.2, 2.0, log=True)},
                                      lambda rows, p: softmax_boosting(rows, N_CLASSES, seed=seed, **p)[0]),
    }


@dataclass
class FittedModel:
    """A fitted pipeline over raw record columns; ``transform`` adds ``probability`` and drops its working columns."""

    name: str
    pipeline: PipelineModel
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    months: tuple[str, ...]

    def transform(self, df: DataFrame, keep_features: bool = False) -> DataFrame:
        out = self.pipeline.transform(with_matrix(df, self.numeric, self.categorical, self.months))
        if ODDS in out.columns:                          # an ensemble's class probabilities
            out = out.withColumn("probability", array_to_vector(F.col(ODDS)))
        elif "probability" not in out.columns:           # one-vs-rest gives margins only
            raw = vector_to_array("rawPrediction")
            odds = F.transform(raw, lambda x: 1.0 / (1.0 + F.exp(-x)))
            total = F.aggregate(odds, F.lit(0.0), lambda a, b: a + b)
            out = out.withColumn("probability", array_to_vector(F.transform(odds, lambda x: x / total)))
        work = [c for c in out.columns if c.startswith(PREFIX) or c in ("rawPrediction", "prediction")
                and c not in df.columns]
        return out.drop(*work, *([] if keep_features else ["features"]))

    def feature_names(self) -> list[str]:
        """Names of the entries of ``features``, in order."""
        _, numbers = _preparation(self.numeric, self.categorical, self.months)
        labels = self.pipeline.stages[0].labelsArray
        names = [n[len(PREFIX):] for n in numbers]
        for c, values in zip(self.categorical, labels):
            names += [f"{c}={v}" for v in [*values, "?"]]
        return names


def predict(df: DataFrame, model: FittedModel, key: str, label: str | None = None) -> DataFrame:
    """model, key, (y,) p and p0.. of every row."""
    arr = vector_to_array("probability")
    probs = [arr[i].alias(f"p{i}") for i in range(N_CLASSES)]
    keep = [F.col(key)] + ([F.col(label).cast("int").alias("y")] if label else [])
    out = model.transform(df).select(F.lit(model.name).alias("model"), *keep, *probs)
    return out.withColumn("p", H.argmax_index([F.col(f"p{i}") for i in range(N_CLASSES)]).cast("int"))


def linear_top_features(df: DataFrame, model: FittedModel, key: str, n: int = C.TOP_ATTRIBUTIONS) -> DataFrame:
    """key, predicted, top (n largest |coefficient x feature| of the predicted class) of a fitted linear model."""
    fitted = model.pipeline.stages[-1]
    rows = fitted.coefficientMatrix.toArray().tolist()
    names = F.array(*[F.lit(x) for x in model.feature_names()[: len(rows[0])]])
    coefs = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in rows])
    arr = vector_to_array("probability")
    best = H.argmax_index([arr[i] for i in range(N_CLASSES)])
    scored = model.transform(df, keep_features=True).select(key, best.alias("predicted"),
                                                           vector_to_array("features").alias("z"))
    parts = F.zip_with(F.zip_with(F.element_at(coefs, F.col("predicted") + 1), F.col("z"), lambda c, z: c * z), names,
                       lambda v, f: F.struct((-F.abs(v)).alias("order"), f.alias("feature"), v.alias("contribution")))
    top = F.transform(F.slice(F.array_sort(parts), 1, n), lambda s: F.struct(s["feature"], s["contribution"]))
    return scored.select(key, "predicted", top.alias("top"))


def _dealt(matrix: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """(the matrix, its number of tasks): trees depend on the rows' order and task, so both follow from the content."""
    if rows <= FIT_ROWS:
        return matrix.coalesce(1), 1
    parts = -(-rows // FIT_PART_ROWS)
    return matrix.repartition(parts, "place").sortWithinPartitions("place"), parts


def fit(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], months: Sequence[str],
        names: Sequence[str] | None = None, folds: int = FOLDS, seed: int = C.SEED, population: int = POPULATION,
        generations: int = GENERATIONS, trials: str | None = None, key: str | None = None) -> dict[str, tuple]:
    """name -> (FittedModel, mean macro-F1 of the best parameters over the folds, seconds); ``train`` has the label y.

    ``trials``: folder of the trial table; a search that was stopped goes on from it.  ``key`` deals equal rows apart.
    """
    chosen = {k: v for k, v in candidates(seed).items() if names is None or k in names}
    matrix = with_matrix(train, numeric, categorical, months)
    content = [F.col("y").cast("double").alias("y"), *[c for c in matrix.columns if c.startswith(PREFIX)]]
    matrix = matrix.select(*content, F.xxhash64(*([key] if key else []), *content).alias("place"))
    matrix = matrix.withColumn("fold", fold_column(matrix.columns[:-1], folds)).cache()
    table = TrialTable(train.sparkSession, trials) if trials else None
    try:
        stages, _ = _preparation(numeric, categorical, months)
        prepared = Pipeline(stages=stages).fit(matrix)
        ready, parts = _dealt(prepared.transform(matrix), matrix.count())
        ready = ready.select("y", "features", "fold").cache()
        ready.count()
        matrix.unpersist()
        out = {}
        for name, candidate in chosen.items():
            began = time.time()

            def predictor(rows: DataFrame, params: dict) -> Callable[[DataFrame], DataFrame]:
                return PipelineModel(candidate.stages(rows, params)).transform

            params, value, _ = search(name, candidate.space, ready, predictor, MacroF1().evaluate, table,
                                      population=population, generations=generations, folds=folds, seed=seed,
                                      parallel=max(2, PARALLEL // parts))
            model = PipelineModel([*prepared.stages, *candidate.stages(ready, params)])
            out[name] = (FittedModel(name, model, tuple(numeric), tuple(categorical), tuple(months)), value,
                         time.time() - began)
        ready.unpersist()
        return out
    finally:
        matrix.unpersist()


def save(models: dict[str, tuple], spark: SparkSession, folder: str) -> None:
    """Pipelines under ``folder/<name>`` and, last, the table of scores that marks the bundle as complete."""
    for name, (model, _, _) in models.items():
        model.pipeline.write().overwrite().save(f"{folder}/{name}")
    spark.createDataFrame([(n, f1, s) for n, (_, f1, s) in models.items()],
                          "model string, search_f1_macro double, train_seconds double").coalesce(1).write.mode(
        "overwrite").parquet(f"{folder}/scores")


def load(spark: SparkSession, folder: str, numeric: Sequence[str], categorical: Sequence[str],
         months: Sequence[str]) -> dict[str, tuple] | None:
    """The saved bundle, or None if it is absent or incomplete."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/scores/_SUCCESS")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.parquet(f"{folder}/scores").collect()       # one row per candidate model
    return {r["model"]: (FittedModel(r["model"], PipelineModel.load(f"{folder}/{r['model']}"), tuple(numeric),
                                     tuple(categorical), tuple(months)), r["search_f1_macro"], r["train_seconds"])
            for r in rows}


def fit_or_load(train: Callable[[], DataFrame], spark: SparkSession, folder: str, numeric: Sequence[str],
                categorical: Sequence[str], months: Sequence[str], **options) -> dict[str, tuple]:
    found = load(spark, folder, numeric, categorical, months)
    if found is None:
        found = fit(train(), numeric, categorical, months, trials=f"{folder}/trials", **options)
        save(found, spark, folder)
    return found
