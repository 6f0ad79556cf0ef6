"""Multi-class boosting over Spark ML trees: reweighted voting trees (SAMME) and joint softmax gradient boosting.

Each loop fits one tree (or one per class) a round on all rows with Spark ML and keeps only the fitted stages.  An
ensemble is a list of pipeline stages, so it is saved, reloaded and applied like any other model: the trees write one
column each, and a last SQL stage turns those columns into class probabilities and a prediction.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ODDS = "mx_odds"        # class probabilities as an array
LEAST_ERROR = 1e-10


def _combine(scores: list[str]) -> SQLTransformer:
    """Softmax over the classes' score expressions, and the class of the largest (the first of equals)."""
    array = f"array({', '.join(scores)})"
    return SQLTransformer(statement=(
        f"select *, cast(array_position({ODDS}, array_max({ODDS})) - 1 as double) as prediction from ("
        f"select *, transform(mx_e, e -> e / aggregate(mx_e, cast(0 as double), (a, b) -> a + b)) as {ODDS} from ("
        f"select *, transform(mx_s, s -> exp(s - array_max(mx_s))) as mx_e from ("
        f"select *, {array} as mx_s from __THIS__)))"))


def samme(rows: DataFrame, classes: int, rounds: int = 10, max_depth: int = 2, rate: float = 1.0, seed: int = 0,
          label: str = "y", features: str = "features") -> tuple[list, list[float]]:
    """(stages, tree weights).  A round's weight is log((1 - e) / e) + log(classes - 1) for its weighted error e; rows that
    it misses gain by its exponential.  Rounds end early when a tree misses nothing or does no better than chance."""
    now = rows.select(label, features, F.lit(1.0).alias("mx_w")).persist(StorageLevel.MEMORY_AND_DISK)
    kept, stages, weights = [now], [], []
    try:
        for t in range(rounds):
            tree = DecisionTreeClassifier(labelCol=label, featuresCol=features, weightCol="mx_w", maxDepth=max_depth,
                                          predictionCol=f"mx_p{t}", rawPredictionCol="", probabilityCol="",
                                          seed=seed).fit(now)
            missed = (F.col(f"mx_p{t}") != F.col(label)).cast("double")
            scored = tree.transform(now).select(label, features, "mx_w", missed.alias("mx_missed"))
            total, wrong = scored.agg(F.sum("mx_w"), F.sum(F.col("mx_w") * F.col("mx_missed"))).first()
            error = max(wrong / total, LEAST_ERROR)
            if error >= 1 - 1 / classes and stages:
                break
            weight = max(rate * (math.log((1 - error) / error) + math.log(classes - 1)), LEAST_ERROR)
            stages.append(tree)
            weights.append(weight)
            if wrong == 0:
                break
            # scaled so that the weights' mean stays one
            grown = total + wrong * (math.exp(weight) - 1)
            now = scored.select(label, features, (F.col("mx_w") * F.exp(weight * F.col("mx_missed"))
                                                  * (total / grown)).alias("mx_w")).persist(StorageLevel.MEMORY_AND_DISK)
            kept.append(now)
        votes = [" + ".join(f"{w!r} * if(mx_p{t} = {k}, 1.0D, 0.0D)" for t, w in enumerate(weights))
                 for k in range(classes)]
        return [*stages, _combine([f"cast(({v}) / {classes - 1} as double)" for v in votes])], weights
    finally:
        for df in kept:
            df.unpersist()


def softmax_boosting(rows: DataFrame, classes: int, rounds: int = 10, max_depth: int = 3, rate: float = 0.5,
                     seed: int = 0, label: str = "y", features: str = "features") -> tuple[list, list[float]]:
    """(stages, starting scores).  Starting from the classes' log shares, each round fits one regression tree per class to
    the class's residual (is it the class, less its softmax probability) and adds ``rate`` times its answer."""
    total, *shares = rows.agg(F.count("*"), *[F.sum((F.col(label) == k).cast("double")) for k in range(classes)]).first()
    start = [math.log(max(s / total, LEAST_ERROR)) for s in shares]
    columns = [f"mx_s{k}" for k in range(classes)]
    now = rows.select(label, features, *[F.lit(s).alias(c) for s, c in zip(start, columns)]).persist(
        StorageLevel.MEMORY_AND_DISK)
    kept, stages = [now], []
    try:
        for t in range(rounds):
            largest = F.greatest(*columns)
            odds = [F.exp(F.col(c) - largest) for c in columns]
            residual = {f"mx_r{k}": (F.col(label) == k).cast("double") - odds[k] / sum(odds[1:], odds[0])
                        for k in range(classes)}
            ready = now.withColumns(residual).persist(StorageLevel.MEMORY_AND_DISK)
            kept.append(ready)
            trees = [DecisionTreeRegressor(labelCol=f"mx_r{k}", featuresCol=features, maxDepth=max_depth, seed=seed,
                                           predictionCol=f"mx_f{t}_{k}").fit(ready) for k in range(classes)]
            stages += trees
            if t < rounds - 1:
                now = PipelineModel(trees).transform(ready).select(
                    label, features, *[(F.col(c) + rate * F.col(f"mx_f{t}_{k}")).alias(c) for k, c in enumerate(columns)])
        scores = [" + ".join([repr(start[k]), *(f"{rate!r} * mx_f{t}_{k}" for t in range(rounds))]) for k in range(classes)]
        return [*stages, _combine([f"cast({s} as double)" for s in scores])], start
    finally:
        for df in kept:
            df.unpersist()
