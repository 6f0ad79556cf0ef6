"""Table profiling: label distribution, completeness, value probes, column
search, per-label samples and the demo-sample picker.

All top-k-per-group operators use ``row_number() <= k`` so Catalyst plans a
``WindowGroupLimit`` below the shuffle: each task keeps only its local top-k
per group before exchanging, which bounds the data of a hot group.
Totals come from scalar subqueries, never from ``sum() over ()`` (which
would pull every row into one partition).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import as_text, is_non_empty


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def total_rows(df: DataFrame) -> Column:
    """Row count as a scalar-subquery column (no driver round trip, no global window)."""
    return df.select(F.count(F.lit(1))).scalar()


def label_distribution(df: DataFrame, label: Column, stage: str = "all") -> DataFrame:
    """(stage, label, n, pct) with pct = 100 * n / rows."""
    counted = df.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.lit(stage).alias("stage"), "label", "n",
                          (F.col("n") * 100.0 / total_rows(df)).alias("pct"))


def non_null_count(columns: Sequence[str]) -> Column:
    """Row-wise count of non-null fields ("field score")."""
    return sum((q(c).isNotNull().cast("int") for c in columns), F.lit(0))


def non_empty_count(columns: Sequence[str]) -> Column:
    return sum((is_non_empty(q(c)).cast("int") for c in columns), F.lit(0))


def value_probe(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """Top-k value counts per column: unpivot -> partial-aggregated count -> per-column top-k."""
    long = df.select(*[as_text(q(c)).alias(c) for c in columns]).unpivot([], list(columns), "column_name", "value")
    counts = long.where(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def column_search(columns: Sequence[str], keywords: Sequence[str]) -> list[tuple[str, int, str]]:
    """Keyword -> matching column names (schema metadata; bounded by the schema width)."""
    return [(kw, i, c) for kw in keywords for i, c in enumerate([c for c in columns if kw in c])]


def samples_per_label(df: DataFrame, label: str, order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per label in a total order; string nulls become ''."""
    w = Window.partitionBy(q(label)).orderBy(*order)
    picked = df.where(q(label).isNotNull()).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n)
    out = [F.coalesce(q(f.name), F.lit("")).alias(f.name) if f.dataType.simpleString() == "string" else q(f.name)
           for f in df.schema.fields]
    return picked.select(*out, F.col("__rn").alias("sample_rank"))


def least_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows per group in ``order``, for an ``n`` above what Spark plans a group limit for: each group is
    dealt over as many parts as the shuffle has, and only the first ``n`` of every part meet in one task."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("__part", F.pmod(F.xxhash64(*[q(c) for c in df.columns]), F.lit(parts)))
    for keys in ([*group, "__part"], list(group)):
        w = Window.partitionBy(*[q(c) for c in keys]).orderBy(*[q(c) for c in order])
        dealt = dealt.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
    return dealt.drop("__part")


def demo_samples(df: DataFrame, label: Column, expert_label: Column, field_score: Column, key: Column,
                 agree_first: Sequence[str], per_label: int = 4, precut: int = 200) -> DataFrame:
    """Per label: best ``precut`` rows by field score, then the top ``per_label`` with
    rule-agreeing rows first for the labels in ``agree_first``.  Two windowed
    top-k passes, each planned with a group limit below its shuffle."""
    base = df.select("*", label.alias("expected_label"), field_score.alias("field_score"),
                     expert_label.alias("expert_hit")).where(F.col("expected_label").isNotNull())
    w1 = Window.partitionBy("expected_label").orderBy(F.desc("field_score"), key)
    cut = base.withColumn("__rn1", F.row_number().over(w1)).where(F.col("__rn1") <= precut)
    agree = F.when(F.col("expected_label").isin(*agree_first) & (F.col("expert_hit") == F.col("expected_label")), 0) \
        .otherwise(1)
    w2 = Window.partitionBy("expected_label").orderBy(agree, F.desc("field_score"), key)
    return (cut.withColumn("sample_rank", F.row_number().over(w2)).where(F.col("sample_rank") <= per_label)
            .drop("__rn1"))
