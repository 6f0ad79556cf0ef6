"""Score a table of records: rules first, statistical fallback second.

``score_records`` is a single narrow plan: the rule set is one ``coalesce``
expression, the fallback is either a fitted Spark ML model's
``transform`` (probabilities, argmax) or the highlight heuristic.  Nothing
is collected and nothing shuffles, so it runs unchanged as a streaming
transform.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import findings as H
from ..functions.rules import RuleSet, evaluate_rules

def _final_from_rule(hit: Column) -> Column:
    return F.struct(F.lit(C.SOURCE_RULES).alias("source"), hit["label"].alias("label"),
                    hit["diagnosis"].alias("diagnosis"), hit["rule_id"].alias("rule_id"),
                    hit["trace"].alias("trace"),
                    F.lit(None).cast("map<string,double>").alias("probabilities"))


def _final_from_heuristic(label: Column) -> Column:
    return F.struct(F.lit(C.SOURCE_HEURISTIC).alias("source"), label.alias("label"), F.lit("").alias("diagnosis"),
                    F.lit(None).cast("string").alias("rule_id"), F.array(F.lit(C.HEURISTIC_TRACE)).alias("trace"),
                    F.lit(None).cast("map<string,double>").alias("probabilities"))


def _final_from_model(prob: Column, n_classes: int = 3) -> Column:
    from pyspark.ml.functions import vector_to_array
    arr = vector_to_array(prob)
    ps = [arr[i] for i in range(n_classes)]
    idx = H.argmax_index(ps)
    names = F.array(*[F.lit(C.LABELS[i]) for i in range(n_classes)])
    return F.struct(F.lit(C.SOURCE_MODEL).alias("source"), F.element_at(names, idx + 1).alias("label"),
                    F.lit("").alias("diagnosis"), F.lit(None).cast("string").alias("rule_id"),
                    F.array().cast("array<string>").alias("trace"),
                    F.map_from_arrays(names, F.slice(arr, 1, n_classes)).alias("probabilities"))


def score_records(df: DataFrame, ruleset: RuleSet, roles: Mapping[str, str | None], *,
                  model=None, compat: bool = False) -> DataFrame:
    """Append ``final`` (struct), ``highlights`` and ``query`` to every record.

    ``model``: optional fitted transformer producing a ``probability`` vector
    for the three classes; records no rule catches get its argmax.  Without
    a model, the highlight heuristic decides (the original's fallback).
    """
    scored = evaluate_rules(df, ruleset, "__hit")
    if model is not None:
        scored = model.transform(scored)
    f = H.Fields(scored.columns, roles)
    hl = H.highlights(f, compat)
    scored = scored.withColumn("highlights", hl)
    hl = F.col("highlights")
    fallback = (_final_from_model(F.col("probability")) if model is not None
                else _final_from_heuristic(H.heuristic_label(f, hl)))
    final = F.when(F.col("__hit").isNotNull(), _final_from_rule(F.col("__hit"))).otherwise(fallback)
    scored = scored.withColumn("final", final)
    q = H.query_text(f, F.col("final.label"), F.col("final.diagnosis"), hl)
    out = scored.withColumn("query", q).drop("__hit")
    if model is not None:
        out = out.drop(*[c for c in ("probability", "rawPrediction", "prediction", "features") if c in out.columns
                         and c not in df.columns])
    return out
