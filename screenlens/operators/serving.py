"""The frozen feature plan of a trained model: fitted once, stored, and applied to any batch or stream.

``fit_plan`` decides the model's columns: which are numeric, the fill of each, every category's codes, the hazard tokens
and the order of the features.  ``transform`` is one projection over the arriving columns, however many there are:
missing columns get their default, numbers are parsed, categories coded, tokens flagged.  It runs no job, so it is the
same expression in a batch and in a stream, and it never looks at other rows.

Category codes are positions in the sorted distinct values of a column.  They are numbered over range partitions
(``ids.group_row_number``), so a column with very many values is no single task.  Columns with at most ``INLINE_VALUES``
values are looked up in the projection itself; the others by a left join with the stored vocabulary, whose size Spark
measures before it picks the join.

An unseen value takes the code of the first fallback value that the column has, else 0.  A category column that was given
no codes is read as a number, 0 where it is none.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import as_text, norm_ws, strict_double
from ..sources.tables import stored
from .ids import group_row_number
from .prep import q, split_tokens

INLINE_VALUES = 64      # values of a column that are looked up in the projection


def category_value(c: str | Column) -> Column:
    """A category as it is looked up: white space normalised, null kept."""
    c = q(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), norm_ws(c))


def fit_vocabulary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, code): sorted distinct non-null values per column, code = position (0-based)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), category_value(c).alias("value")) for c in columns]))
    distinct = df.select(pairs.alias("p")).select("p.*").where(F.col("value").isNotNull()).distinct()
    numbered = group_row_number(stored(distinct, "vocabulary"), ["column_name"], ["value"], "position")
    return numbered.select("column_name", "value", (F.col("position") - 1).cast("int").alias("code"))


@dataclass(frozen=True)
class FeaturePlan:
    """Everything but the long vocabularies; plain data, JSON round-trips."""
    numeric: list[str]
    categorical: list[str]
    fills: dict[str, str] = field(default_factory=dict)
    codes: dict[str, dict[str, int]] = field(default_factory=dict)      # columns looked up in the projection
    joined: list[str] = field(default_factory=list)                     # columns looked up in the vocabulary table
    fallback: dict[str, int] = field(default_factory=dict)
    hazard_column: str | None = None
    hazard_tokens: list[str] = field(default_factory=list)
    hazard_delims: str = ","
    hazard_prefix: str = C.HAZARD_PREFIX

    @property
    def features(self) -> list[str]:
        """The model's columns, in order."""
        return [*self.numeric, *self.categorical, *(self.hazard_prefix + t for t in self.hazard_tokens)]

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> "FeaturePlan":
        return FeaturePlan(**json.loads(text))


def fit_plan(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], *,
             encoded: Sequence[str] | None = None, fills: Mapping[str, str] | None = None,
             fallbacks: Sequence[str] = tuple(C.ENCODE_FALLBACKS), hazard_column: str | None = None,
             hazard_tokens: Sequence[str] = (), hazard_delims: str = ",",
             inline_values: int = INLINE_VALUES) -> tuple[FeaturePlan, DataFrame]:
    """The plan, and the vocabulary (column_name, value, code) of the ``encoded`` columns, written once.

    ``encoded``: the category columns that get codes; by default those that ``train`` has.  To the driver come one size
    and one fallback a column, and the values of columns with at most ``inline_values`` of them.
    """
    encoded = [c for c in (categorical if encoded is None else encoded) if c in train.columns]
    vocabulary = stored(fit_vocabulary(train, encoded), "vocabulary") if encoded else None
    codes: dict[str, dict[str, int]] = {c: {} for c in encoded}
    joined: list[str] = []
    fallback: dict[str, int] = {}
    if encoded:
        rank = F.create_map(*[x for i, v in enumerate(fallbacks) for x in (F.lit(v), F.lit(i))])
        sizes = vocabulary.groupBy("column_name").agg(
            F.count("*").alias("size"), F.min_by("code", rank[F.col("value")]).alias("fallback")).collect()
        joined = sorted(r["column_name"] for r in sizes if r["size"] > inline_values)
        fallback = {r["column_name"]: r["fallback"] for r in sizes if r["fallback"] is not None}
        for r in vocabulary.where(~F.col("column_name").isin(joined)).collect():
            codes[r["column_name"]][r["value"]] = r["code"]
    plan = FeaturePlan(list(numeric), list(categorical), dict(fills or {}),
                       {c: dict(sorted(v.items())) for c, v in codes.items() if c not in joined}, joined, fallback,
                       hazard_column, list(hazard_tokens), hazard_delims)
    return plan, vocabulary


def _source(df: DataFrame, plan: FeaturePlan, c: str, default: str) -> Column:
    """The arriving column as text, filled; ``default`` where the table has no such column."""
    if c not in df.columns:
        return F.lit(default)
    value = as_text(q(c))
    return F.coalesce(value, F.lit(plan.fills[c])) if c in plan.fills else value


def transform(df: DataFrame, plan: FeaturePlan, key: Sequence[str], vocabulary: DataFrame | None = None) -> DataFrame:
    """key..., then the plan's features in order, all double (category codes and flags included)."""
    number = lambda c: F.coalesce(strict_double(c), F.lit(0.0))
    out: dict[str, Column] = {c: number(_source(df, plan, c, "0")) for c in plan.numeric}
    lookups: dict[str, Column] = {}
    for c in plan.categorical:
        value = category_value(_source(df, plan, c, ""))
        code = None
        if c in plan.joined:
            lookups[f"__value_{c}"] = value
            code = F.col(f"`__code_{c}`")
        elif plan.codes.get(c):
            code = F.lit(None).cast("int")
            for v, n in reversed(plan.codes[c].items()):
                code = F.when(value == v, n).otherwise(code)
        if c in plan.joined or c in plan.codes:
            code = F.lit(None).cast("int") if code is None else code
            out[c] = F.coalesce(code, F.lit(plan.fallback.get(c, 0))).cast("double")
        else:
            out[c] = number(value)
    if plan.hazard_column is not None:
        tokens = split_tokens(_source(df, plan, plan.hazard_column, ""), plan.hazard_delims)
        out |= {plan.hazard_prefix + t: F.array_contains(tokens, t).cast("double") for t in plan.hazard_tokens}
    # the projection comes first, so that a join carries the features instead of the arriving columns
    staged = df.select(*[q(k) for k in key], *[out[c].alias(c) for c in plan.features if c not in plan.joined],
                       *[v.alias(n) for n, v in lookups.items()])
    for c in plan.joined:
        known = vocabulary.where(F.col("column_name") == c).select(F.col("value").alias(f"__known_{c}"),
                                                                   F.col("code").alias(f"__code_{c}"))
        staged = staged.join(known, F.col(f"`__value_{c}`") == F.col(f"`__known_{c}`"), "left")
    return staged.select(*[q(k) for k in key], *[out[c].alias(c) if c in plan.joined else q(c) for c in plan.features])


# ------------------------------------------------------------------ the stored bundle

def save_artefacts(spark: SparkSession, folder: str, plan: FeaturePlan, vocabulary: DataFrame | None, split: DataFrame,
                   scaler: Mapping[str, tuple[float, float]]) -> None:
    """The split (one folder per side), vocabulary, scaler, feature table and, last, the plan, which completes it."""
    split.write.mode("overwrite").partitionBy("split").parquet(f"{folder}/split")
    if vocabulary is not None:
        vocabulary.write.mode("overwrite").parquet(f"{folder}/vocabulary")
    kind = {c: "numeric" for c in plan.numeric} | {c: "categorical" for c in plan.categorical}
    spark.createDataFrame([(i, c, kind.get(c, "hazard")) for i, c in enumerate(plan.features)],
                          "position int, feature string, kind string").coalesce(1).write.mode("overwrite").parquet(
        f"{folder}/features")
    spark.createDataFrame([(f, m, s) for f, (m, s) in scaler.items()], "feature string, mean double, std double"
                          ).coalesce(1).write.mode("overwrite").parquet(f"{folder}/scaler")
    spark.createDataFrame([(plan.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/plan")


@dataclass(frozen=True)
class Artefacts:
    plan: FeaturePlan
    vocabulary: DataFrame | None
    split: DataFrame
    features: DataFrame
    scaler: DataFrame

    def transform(self, df: DataFrame, key: Sequence[str]) -> DataFrame:
        return transform(df, self.plan, key, self.vocabulary)


def load_artefacts(spark: SparkSession, folder: str) -> Artefacts | None:
    """The stored bundle, or None where it is absent or was not completed."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/plan/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        return None
    plan = FeaturePlan.from_json(spark.read.text(f"{folder}/plan").first()[0])
    vocabulary = spark.read.parquet(f"{folder}/vocabulary") if plan.codes or plan.joined else None
    return Artefacts(plan, vocabulary, *(spark.read.parquet(f"{folder}/{n}") for n in ("split", "features", "scaler")))
