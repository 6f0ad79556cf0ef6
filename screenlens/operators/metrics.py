"""Classification metrics over a tall prediction table.

Input: one row per (group..., row) with the true class ``y``, the predicted
class ``p`` and class probabilities ``p0..p{K-1}``.  Every metric except
Brier and AUC depends only on the K x K confusion cells, so the only pass
over the big table is one ``groupBy(group, y, p)`` with map-side partial
aggregation; everything after that runs on a few rows per group.

The bootstrap uses *Poisson* resampling: replicate ``r`` gives row ``i``
weight ``w ~ Poisson(1)`` drawn from a portable hash of ``(r, i)``, so a
replicate needs neither a dense row index nor a join.  The weights of a
batch of rows are one matrix, reduced inside the task (``resample``).
The same hash gives the same resample for every model and metric (paired
bootstrap), like the original's fixed seed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import portable_hash
from ..sources.tables import reliable_checkpoint
from .resample import auc_pairs, auc_replicates, auc_segments, replicate_cells, weight_maker

CELL_METRICS = ["accuracy", "precision_macro", "recall_macro", "f1_macro", "specificity_macro", "npv_macro",
                "mcc", "kappa"]
ALL_METRICS = [*CELL_METRICS, "brier", "auc_ovo_macro"]


def _g(group: Sequence[str]) -> list[Column]:
    return [F.col(g) for g in group]


def confusion_cells(pred: DataFrame, group: Sequence[str] = ("model",), y: str = "y", p: str = "p",
                    weight: Column | None = None) -> DataFrame:
    w = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return pred.groupBy(*_g(group), F.col(y).alias("y"), F.col(p).alias("p")).agg(w.cast("double").alias("n"))


def class_table(cells: DataFrame, group: Sequence[str] = ("model",)) -> DataFrame:
    """Per (group, class): tp, fp, fn, tn over classes seen in y ∪ p."""
    g = list(group)
    rows = cells.groupBy(*g, F.col("y").alias("cls")).agg(
        F.sum("n").alias("t_k"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0.0)).alias("tp"))
    cols = cells.groupBy(*g, F.col("p").alias("cls")).agg(F.sum("n").alias("p_k"))
    total = cells.groupBy(*g).agg(F.sum("n").alias("n_total"))
    ct = rows.join(cols, g + ["cls"], "full_outer").join(total, g) if g else \
        rows.join(cols, ["cls"], "full_outer").join(total)
    ct = ct.select(*g, "cls", *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("t_k", "tp", "p_k")), "n_total")
    return ct.select(*g, "cls", "tp", (F.col("p_k") - F.col("tp")).alias("fp"), (F.col("t_k") - F.col("tp")).alias("fn"),
                     (F.col("n_total") - F.col("t_k") - F.col("p_k") + F.col("tp")).alias("tn"),
                     "t_k", "p_k", "n_total")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def per_class_metrics(ct: DataFrame, group: Sequence[str] = ("model",)) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return ct.select(*group, "cls", "tp", "fp", "fn", "tn", "t_k", "p_k", "n_total",
                     _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"),
                     _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), _ratio(tn, tn + fp).alias("specificity"),
                     _ratio(tn, tn + fn).alias("npv"))


def summary_metrics(ct: DataFrame, group: Sequence[str] = ("model",)) -> DataFrame:
    """Accuracy, macro P/R/F1/specificity/NPV, MCC and Cohen's kappa per group."""
    pc = per_class_metrics(ct, group)
    agg = pc.groupBy(*group).agg(
        F.sum("tp").alias("c"), F.first("n_total").alias("s"), F.sum(F.col("t_k") * F.col("p_k")).alias("tp_sum"),
        F.sum(F.col("p_k") * F.col("p_k")).alias("pp"), F.sum(F.col("t_k") * F.col("t_k")).alias("tt"),
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"), F.avg("specificity").alias("specificity_macro"),
        F.avg("npv").alias("npv_macro"))
    c, s = F.col("c"), F.col("s")
    den = F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt")))
    mcc = F.when(den > 0, (c * s - F.col("tp_sum")) / den).otherwise(F.lit(0.0))
    po = c / s
    pe = F.col("tp_sum") / (s * s)
    kappa = F.when(pe < 1, (po - pe) / (1 - pe))
    return agg.select(*group, (c / s).alias("accuracy"), "precision_macro", "recall_macro", "f1_macro",
                      "specificity_macro", "npv_macro", mcc.alias("mcc"), kappa.alias("kappa"))


def brier(pred: DataFrame, probs: Sequence[str], group: Sequence[str] = ("model",), y: str = "y") -> DataFrame:
    """Multiclass Brier: mean over n*K cells of (p_k - [y == k])^2 (always K columns)."""
    k = len(probs)
    row = sum(((F.col(c) - (F.col(y) == i).cast("double")) ** 2 for i, c in enumerate(probs)), F.lit(0.0)) / k
    return pred.groupBy(*group).agg(F.avg(row).alias("brier"))


def auc_ovo(pred: DataFrame, probs: Sequence[str], group: Sequence[str] = ("model",), y: str = "y") -> DataFrame:
    """Macro one-vs-one AUC (Hand & Till), exact with mid-ranks for ties.

    Rows are counted per distinct score, range-partitioned by score and reduced to one stretch per partition; only the
    stretches are ordered (``resample.auc_segments``).
    """
    pairs = auc_pairs(auc_segments(pred, probs, group, y, None, None), group)
    return pairs.groupBy(*group).agg(F.avg("auc").alias("auc_ovo_macro"))


# ------------------------------------------------------------------ bootstrap

def poisson_thresholds(kmax: int = 12) -> list[float]:
    """CDF of Poisson(1) at 0..kmax: weight = number of thresholds <= u."""
    out, acc = [], 0.0
    for k in range(kmax + 1):
        acc += math.exp(-1.0) / math.factorial(k)
        out.append(acc)
    return out


def poisson_weight(u: Column) -> Column:
    return sum(((u >= F.lit(t)).cast("int") for t in poisson_thresholds()), F.lit(0))


MIX_PRIME = 2147483647  # 2^31 - 1: every product below stays inside bigint


def with_mix_uniform(df: DataFrame, key: Column, draw: Column, out: str = "u", seed: int = C.SEED) -> DataFrame:
    """Append a portable uniform in [0, 1) from an integer key and a draw number.

    Two quadratic mixing rounds modulo a prime, integer arithmetic only, so
    the exact same value comes out of Spark and of DuckDB, and it stays in
    whole-stage codegen (no string hashing per draw).  Each round is its own
    projection so the expression tree never duplicates a sub-round.  Keys
    that are not integers should be hashed once per row first.
    """
    p = F.lit(MIX_PRIME).cast("bigint")
    x0 = F.pmod(key.cast("bigint"), p)
    df = df.withColumn("__x1", (x0 * 48271 + (draw.cast("bigint") + 1) * 16807 + seed) % p)
    x1 = F.col("__x1")
    df = df.withColumn("__x2", ((x1 * x1) % p * 69621 + x1 * 40692 + 1) % p)
    x2 = F.col("__x2")
    df = df.withColumn(out, (((x2 * x2) % p * 48271 + x2 * 16807 + 7) % p) / F.lit(float(MIX_PRIME)))
    return df.drop("__x1", "__x2")


def point_metrics(pred: DataFrame, probs: Sequence[str], group: Sequence[str] = ("model",)) -> DataFrame:
    """All ten metrics per group, one row each."""
    g = list(group)
    summary = summary_metrics(class_table(confusion_cells(pred, g), g), g)
    return summary.join(brier(pred, probs, g), g).join(auc_ovo(pred, probs, g), g)


def bootstrap_ci(pred: DataFrame, probs: Sequence[str], group: Sequence[str] = ("model",),
                 replicates: int = C.BOOTSTRAP_REPLICATES, alpha: float = C.CI_ALPHA, seed: int = C.SEED,
                 row_key: str = "row_id", point: DataFrame | None = None) -> DataFrame:
    """Long table (group..., metric, estimate, boot_mean, lo, hi, n_replicates) for all ten metrics.

    Replicates in which a metric is undefined are skipped, as the count shows.  ``point``: ``point_metrics`` of the same
    rows, if the caller has them.
    """
    g = list(group)
    k = len(probs)
    point = point_metrics(pred, probs, g) if point is None else point
    row_brier = sum(((F.col(c) - (F.col("y") == i).cast("double")) ** 2 for i, c in enumerate(probs)), F.lit(0.0)) / k
    gr = g + ["rep"]
    weights = weight_maker(replicates, seed, poisson_thresholds())
    # replicate cells are tiny (groups x replicates x K^2) and feed several branches: written once
    rcells = reliable_checkpoint(replicate_cells(pred, g, "y", "p", row_brier, row_key, weights))
    rep_metrics = summary_metrics(class_table(rcells.select(*gr, "y", "p", "n"), gr), gr)
    rep_brier = rcells.groupBy(*gr).agg((F.sum("bw") / F.sum("n")).alias("brier"))
    rep_auc = auc_replicates(pred, probs, g, "y", row_key, weights)
    rep_all = rep_metrics.join(rep_brier, gr).join(rep_auc, gr)
    long_rep = rep_all.unpivot(gr, ALL_METRICS, "metric", "value").where(F.col("value").isNotNull())
    stats = long_rep.groupBy(*g, "metric").agg(
        F.avg("value").alias("boot_mean"), F.percentile("value", alpha / 2).alias("lo"),
        F.percentile("value", 1 - alpha / 2).alias("hi"), F.count(F.lit(1)).alias("n_replicates"))
    long_point = point.unpivot(g, ALL_METRICS, "metric", "estimate")
    return long_point.join(stats, g + ["metric"], "left")
