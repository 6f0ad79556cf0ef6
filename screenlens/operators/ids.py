"""Dense row numbers without a single-partition window.

``row_number() over (order by k)`` sorts the whole table in one task.  Here
the table is range-partitioned on the order key (balanced even under skew,
because the bounds come from a sample of the key space), sorted inside each
partition, and numbered from a tiny per-partition count table whose prefix
sums are broadcast back (one row per partition: a proven size bound).

The order key must be a total order (append a unique tie-breaker): then a
recomputed partition after an executor loss reproduces the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import reliable_checkpoint


def _cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def global_row_number(df: DataFrame, order: Sequence[str | Column], out: str = "row_number",
                      num_partitions: int | None = None) -> DataFrame:
    """1-based dense position of each row in ``order`` (ascending), computed distributedly."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    oc = _cols(order)
    staged = (df.repartitionByRange(n, *oc).sortWithinPartitions(*oc)
              .withColumn("__pid", F.spark_partition_id())
              .withColumn("__local", F.monotonically_increasing_id()))
    staged = staged.withColumn("__local", F.col("__local") - F.shiftleft(F.col("__pid").cast("bigint"), 33))
    # Range bounds come from a sample of the input, whose row order may differ between two evaluations
    # (it is shuffle output).  Materialise the numbered partitions once in the checkpoint folder so the
    # count table and the rows agree, and a lost executor re-reads instead of re-sampling.
    staged = reliable_checkpoint(staged)
    counts = staged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    prefix = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(prefix), F.lit(0)).alias("__off"))
    out_df = staged.join(F.broadcast(offsets), "__pid")
    return out_df.withColumn(out, F.col("__off") + F.col("__local") + 1).drop("__pid", "__local", "__off")


def group_row_number(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], out: str = "rn",
                     num_partitions: int | None = None) -> DataFrame:
    """1-based position inside each group, for a *small number of groups* (e.g. classes).

    Rows are numbered globally in (group, order); each group's start comes
    from a per-group count table (one row per group).  Unlike a window
    partitioned by the group, a group holding a third of the rows is spread
    over many range partitions instead of one task.
    """
    numbered = global_row_number(df, [*group, *order], "__g", num_partitions)
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__gn"))
    prefix = Window.orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, F.coalesce(F.sum("__gn").over(prefix), F.lit(0)).alias("__gs"),
                           F.col("__gn").alias("group_size"))
    joined = numbered.join(F.broadcast(starts), list(group))
    return joined.withColumn(out, F.col("__g") - F.col("__gs")).drop("__g", "__gs")


def append_ids(new: DataFrame, order: Sequence[str | Column], existing_max: Column | int = 0,
               out: str = "id") -> DataFrame:
    """Auto-increment ids for an appended batch: existing max id + dense position."""
    base = existing_max if isinstance(existing_max, Column) else F.lit(int(existing_max))
    return global_row_number(new, order, "__pos").withColumn(out, base + F.col("__pos")).drop("__pos")
