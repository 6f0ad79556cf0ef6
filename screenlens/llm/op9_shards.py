"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records uniformly into memory-sized buckets by a seeded hash of their content; pass 2 runs a seeded
Fisher-Yates shuffle in each bucket and writes it.  Buckets in order form one random permutation of the table; shard i
takes the ranks from ceil(i * n / shards) on, so shard sizes differ by one row at most (the law ``rows``) and every
bucket is written to one shard or two.

The hash depends on seed, key and text alone, not on how the input is split, so a run can be repeated and a lost
executor's buckets come out the same.  Rows that are equal in all columns cannot be told apart by content and would meet
in one bucket; where their bytes exceed a quarter of a bucket they are counted (pre-aggregated before the shuffle) and
dealt out again by copy number.

Edge cases: null text is written as null and counts as no bytes; null keys are hashed like any value; repeated rows are
all written; an empty table gives no rows; columns besides key and text are carried along (names that clash with the
operator's own, ``shard`` and ``slot``, are refused).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import Stage

SHARDS = 24
SEED = 20240607
BUCKET_BYTES = 8 << 20
ROW_BYTES = 8
OWN = ("shard", "slot")
SPAN = 4096             # buckets per group of the two-level prefix sum


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of range(n): draw all swap partners, then swap from the end."""
    order = list(range(n))
    partners = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64).tolist()
    for i in range(n - 1, 0, -1):
        j = partners[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def _sized(df: DataFrame, key: str, text: str, seed: int) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return (df.withColumn("_size", F.octet_length(body).cast("long") + ROW_BYTES)
            .withColumn("_h", F.xxhash64(F.lit(seed), F.col(key), F.crc32(F.encode(body, "UTF-8")), F.col(text).isNull(),
                                         F.octet_length(body))))


def scatter(df: DataFrame, *, key: str, text: str, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Pass 1: every row with its ``_bucket`` and ``_h`` (the canonical order before shuffling)."""
    sized = _sized(df, key, text, seed)
    narrow = sized.select("_h", "_size")
    total = narrow.agg(F.sum("_size")).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    heavy = (narrow.groupBy("_h").agg(F.count("*").alias("_n"), F.sum("_size").alias("_b"))
             .filter((F.col("_n") > 1) & (F.col("_b") > bucket_bytes // 4)).select(F.col("_h").alias("_hh")))
    if heavy.limit(1).count():
        many = sized.join(heavy, F.col("_h") == F.col("_hh"), "left_semi")
        copies = (many.groupBy(*sized.columns).agg(F.count("*").alias("_n"))
                  .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))))
        copies = copies.withColumn("_h", F.xxhash64("_h", "_copy")).select(*sized.columns)
        sized = sized.join(heavy, F.col("_h") == F.col("_hh"), "left_anti").unionByName(copies)
    return sized.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "_h"), F.lit(buckets)))


def offsets(scattered: DataFrame) -> DataFrame:
    """_bucket, _first (rank of the bucket's first row), _rows in all: prefix sums over spans of buckets, then inside."""
    sizes = scattered.groupBy("_bucket").agg(F.count("*").alias("_n")).withColumn(
        "_span", F.floor(F.col("_bucket") / SPAN))
    spans = sizes.groupBy("_span").agg(F.sum("_n").alias("_m"))
    before = W.orderBy("_span").rowsBetween(W.unboundedPreceding, -1)       # one row per SPAN buckets
    spans = spans.select("_span", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_start"),
                         F.sum("_m").over(W.orderBy("_span").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
                         .alias("_rows"))
    inside = W.partitionBy("_span").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    return (sizes.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(spans, "_span")
            .select("_bucket", (F.col("_start") + F.col("_in")).alias("_first"), "_rows"))


def shards(df: DataFrame, *, key: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = SEED,
           bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every row of ``df`` with its ``shard`` (0 .. shards - 1) and ``slot`` (gapless from 0 in each shard)."""
    clash = [c for c in df.columns if c in OWN or c.startswith("_")]
    if clash:
        raise ValueError(f"column names in use by the operator: {clash}")
    scattered = scatter(df, key=key, text=text, seed=seed, bucket_bytes=bucket_bytes)
    placed = scattered.join(offsets(scattered), "_bucket")
    schema = T.StructType([*df.schema, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    names = df.columns

    def deal(table):
        bucket = table.column("_bucket")[0].as_py()
        table = table.sort_by([("_h", "ascending"), *[(c, "ascending") for c in (key, text)]])
        order = fisher_yates(table.num_rows, np.random.default_rng([seed, bucket]))
        rank = table.column("_first")[0].as_py() + np.arange(table.num_rows, dtype=np.int64)
        rows = table.column("_rows")[0].as_py()
        shard = rank * shards // rows
        slot = rank - -(-shard * rows // shards)
        dealt = table.take(pa.array(order)).select(names)
        return (dealt.append_column("shard", pa.array(shard.astype(np.int32)))
                .append_column("slot", pa.array(slot)))

    return placed.groupBy("_bucket").applyInArrow(deal, schema)


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Write the shards as Parquet folders ``shard=i``, rows in slot order inside each file."""
    shards(df, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def report(df: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Write the shards to a stage folder and describe the written rows: the columns of the query."""
    stage = Stage(df.sparkSession, "shards")
    path = f"{stage.root}/shards"
    write_shards(df, path, key=key, text=text, **options)
    schema = T.StructType([*df.schema, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    written = df.sparkSession.read.schema(schema).parquet(path)
    body = F.coalesce(F.col(text), F.lit(""))
    return written.select(
        F.col(key), (F.octet_length(body).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
