"""Cleaning and profiling decisions over wide, dirty tables.

The data-dependent decisions (null counts, single-value test, convertibility share, hazard token frequencies) are a few
wide aggregate jobs, each over a chunk of ``CHUNK`` columns to stay inside codegen limits; ``fit_clean`` and ``fit_types``
collect them in a small, JSON-serialisable :class:`PrepPlan`, and ``apply_clean`` and ``apply_types`` are lazy
projections.  What a trained model freezes on top of that (vocabularies, fills, feature order) is ``serving.FeaturePlan``.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions.text import as_text, duration_months, duration_valid, norm_ws, strict_double

CHUNK = 300


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


# --------------------------------------------------------------- P1 / P2

def normalize_values(df: DataFrame, common: Sequence[str] = tuple(C.COMMON_NORMAL_VALUES),
                     specific: Mapping[str, Sequence[str]] | None = None,
                     target: str = C.NORMAL_TARGET) -> DataFrame:
    """Exact "normal" spellings -> ``target`` in every string column, one projection."""
    specific = dict(C.SPECIFIC_NORMAL_VALUES if specific is None else specific)
    strings = set(string_columns(df))
    out = []
    for c in df.columns:
        if c in strings:
            values = list(common) + list(specific.get(c, []))
            out.append(F.when(q(c).isin(*values), F.lit(target)).otherwise(q(c)).alias(c))
        else:
            out.append(q(c))
    return df.select(*out)


# --------------------------------------------------------------- P3 / P4 / P5 / P12

def fill_values(df: DataFrame, rules: Mapping[str, str] = C.FILL_RULES) -> DataFrame:
    present = {k: v for k, v in rules.items() if k in df.columns}
    return df.fillna(present) if present else df


def binary_flags(df: DataFrame, columns: Sequence[str] = tuple(C.BINARY_FEATURES),
                 negations: Sequence[str] = tuple(C.NEGATION_TOKENS_TRAIN), compat: bool = False) -> DataFrame:
    """flag = 1 unless the text contains a negation token.  Null -> 0 (compat: 1, as 'nan').

    Absent columns are skipped (trap 35)."""
    pattern = "|".join(negations)
    repl = {}
    for c in columns:
        if c not in df.columns:
            continue
        t = as_text(q(c))
        neg = F.coalesce(t.rlike(pattern), F.lit(False))
        flag = (~neg).cast("int")
        repl[c] = flag if compat else F.when(t.isNull(), F.lit(0)).otherwise(flag)
    return df.withColumns(repl) if repl else df


def durations_to_months(df: DataFrame, columns: Sequence[str] = tuple(C.DURATION_FIELDS),
                        with_valid: bool = False) -> DataFrame:
    repl = {c: duration_months(q(c)) for c in columns if c in df.columns}
    if with_valid:
        repl.update({f"{c}_valid": duration_valid(q(c)) for c in columns if c in df.columns})
    return df.withColumns(repl) if repl else df


def fill_markers(df: DataFrame, keywords: Sequence[str] = tuple(C.MARKER_KEYWORDS),
                 value: str = C.MARKER_FILL) -> DataFrame:
    cols = [c for c in df.columns if any(k in c for k in keywords)]
    return df.fillna(value, subset=cols) if cols else df


# --------------------------------------------------------------- A1 / A2 / P13 / P14

def split_tokens(c: Column, delims: str = ",") -> Column:
    pattern = "[" + "".join("\\" + d if d in "\\]^-[" else d for d in delims) + "]"
    parts = F.transform(F.split(F.coalesce(as_text(c), F.lit("")), pattern), lambda t: F.trim(t))
    return F.filter(parts, lambda t: t != "")


def token_frequency(df: DataFrame, column: str, delims: str = ",") -> DataFrame:
    """(token, n): rows mentioning a token once per mention (partial aggregation before the shuffle)."""
    return (df.select(F.explode(split_tokens(q(column), delims)).alias("token"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("n")))


def top_tokens(df: DataFrame, column: str, k: int = C.TOP_HAZARDS, delims: str = ",") -> DataFrame:
    """Top-k tokens by count (ties: token ascending) with share of *all* rows."""
    total = df.select(F.count(F.lit(1))).scalar()
    freq = token_frequency(df, column, delims)
    return (freq.orderBy(F.desc("n"), F.asc("token")).limit(k)
            .select("token", "n", (F.col("n") / total).alias("share")))


def hazard_dummies(df: DataFrame, column: str, vocabulary: Sequence[str], delims: str = ",",
                   prefix: str = C.HAZARD_PREFIX, drop_source: bool = True) -> DataFrame:
    """One int column per vocabulary token: 1 if the token is one of the row's split tokens."""
    toks = split_tokens(q(column), delims)
    out = df.select("*", *[F.array_contains(toks, t).cast("int").alias(prefix + t) for t in vocabulary])
    return out.drop(column) if drop_source else out


# --------------------------------------------------------------- P6-P11, A3, A4, A6

def _chunks(cols: Sequence[str]) -> list[list[str]]:
    return [list(cols[i:i + CHUNK]) for i in range(0, len(cols), CHUNK)]


def column_stats(df: DataFrame, columns: Sequence[str] | None = None) -> list[dict]:
    """One aggregate pass per column chunk: rows, non-null count, min/max text, numeric share.

    Returns a small list (one dict per column, bounded by the schema width).
    """
    columns = list(columns or df.columns)
    out: list[dict] = []
    for chunk in _chunks(columns):
        exprs = [F.count(F.lit(1)).alias("__rows")]
        for i, c in enumerate(chunk):
            exprs += [F.count(q(c)).alias(f"n{i}"),
                      F.min(as_text(q(c))).alias(f"lo{i}"), F.max(as_text(q(c))).alias(f"hi{i}"),
                      F.sum(strict_double(q(c)).isNotNull().cast("long")).alias(f"num{i}")]
        row = df.agg(*exprs).first()
        for i, c in enumerate(chunk):
            out.append({"column": c, "rows": row["__rows"], "non_null": row[f"n{i}"], "min": row[f"lo{i}"],
                        "max": row[f"hi{i}"], "numeric": row[f"num{i}"]})
    return out


def missing_ratio(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Long table (column, missing_ratio): one aggregate, then unpivot; stays distributed."""
    columns = list(columns or df.columns)
    agg = df.agg(*[F.avg(q(c).isNull().cast("double")).alias(c) for c in columns])
    return agg.unpivot([], columns, "column", "missing_ratio")


@dataclass
class PrepPlan:
    """Frozen cleaning decisions: plain data, JSON round-trips."""
    dropped: dict[str, list[str]] = field(default_factory=dict)
    remaining: list[str] = field(default_factory=list)
    numeric_cols: list[str] = field(default_factory=list)
    categorical_cols: list[str] = field(default_factory=list)
    conversion: dict[str, float] = field(default_factory=dict)
    hazard_column: str | None = None
    hazard_vocabulary: list[str] = field(default_factory=list)
    rows: int = 0
    original_columns: int = 0

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> "PrepPlan":
        return PrepPlan(**json.loads(text))


def fit_clean(df: DataFrame, privacy: Sequence[str] = tuple(C.PRIVACY_COLUMNS),
              unit_keywords: Sequence[str] = tuple(C.UNIT_KEYWORDS),
              other: Sequence[str] = tuple(C.OTHER_REMOVED_COLUMNS)) -> PrepPlan:
    """Decide the five cleaning drops with one aggregate job per column chunk."""
    stats = {s["column"]: s for s in column_stats(df)}
    strings = set(string_columns(df))
    cols = list(df.columns)
    plan = PrepPlan(original_columns=len(cols), rows=next(iter(stats.values()))["rows"] if stats else 0)
    full_missing = [c for c in cols if stats[c]["non_null"] == 0]
    cols = [c for c in cols if c not in full_missing]
    single = [c for c in cols if c in strings and stats[c]["non_null"] > 0 and stats[c]["min"] == stats[c]["max"]]
    cols = [c for c in cols if c not in single]
    priv = [c for c in privacy if c in cols]
    cols = [c for c in cols if c not in priv]
    units = [c for c in cols if any(k in c for k in unit_keywords)]
    cols = [c for c in cols if c not in units]
    others = [c for c in other if c in cols]
    cols = [c for c in cols if c not in others]
    plan.dropped = {"full_missing_removed": full_missing, "single_value_removed": single,
                    "privacy_removed": priv, "unit_columns_removed": units, "other_removed": others}
    plan.remaining = cols
    return plan


def fit_types(df: DataFrame, plan: PrepPlan, threshold: float = 0.8, exclude: Sequence[str] = ()) -> PrepPlan:
    """Numeric if the strict-numeric share over *all* rows exceeds ``threshold``."""
    cols = [c for c in plan.remaining if c not in exclude]
    stats = column_stats(df, cols)
    conv = {s["column"]: (s["numeric"] or 0) / s["rows"] if s["rows"] else 0.0 for s in stats}
    plan.conversion = conv
    plan.numeric_cols = [c for c in cols if conv[c] > threshold]
    plan.categorical_cols = [c for c in cols if conv[c] <= threshold]
    return plan


def apply_clean(df: DataFrame, plan: PrepPlan) -> DataFrame:
    return df.select(*[q(c) for c in plan.remaining if c in df.columns])


def apply_types(df: DataFrame, plan: PrepPlan) -> DataFrame:
    """Numeric columns -> double (bad -> 0); categorical -> string with null kept (trap 7)."""
    out = []
    for c in df.columns:
        if c in plan.numeric_cols:
            out.append(F.coalesce(strict_double(q(c)), F.lit(0.0)).alias(c))
        elif c in plan.categorical_cols:
            out.append(as_text(q(c)).alias(c))
        else:
            out.append(q(c))
    return df.select(*out)


def report_rows(plan: PrepPlan) -> list[tuple[str, int, str]]:
    rows = []
    for step, cols in plan.dropped.items():
        rows += [(step, i, c) for i, c in enumerate(cols)]
    rows += [("remaining", i, c) for i, c in enumerate(plan.remaining)]
    return rows


# --------------------------------------------------------------- P21 / P22

def base_feature_name(c: Column) -> Column:
    return F.substring_index(c, "_", 1)
