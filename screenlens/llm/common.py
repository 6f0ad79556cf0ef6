"""Helpers shared by the operators: stored intermediates, connected components, Arrow batches."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlens.sources.tables import ensure_checkpoint_dir

BATCH_ROWS = 1_000
ASCII_SPACE = " \t\n\x0b\x0c\r"  # the bytes 0x20 and 0x09-0x0D that separate words


def lower_bytes(text: str) -> bytes:
    """The UTF-8 bytes with A-Z lower-cased (``bytes.lower`` touches nothing else)."""
    return text.encode("utf-8", "surrogatepass").lower()


class Stage:
    """Tables written under one fresh folder of the shared checkpoint directory.

    A written table cuts lineage: after it, a lost executor re-reads files and never re-runs the work before.
    ``drop`` removes a table as soon as the ones derived from it are written.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        w = df.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(partition_by)
        w.parquet(f"{self.root}/{name}")
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def importable_on_workers(spark: SparkSession) -> None:
    """Prepare the session: texts travel to Python workers in batches of BATCH_ROWS rows (a worker and the JVM each hold
    a batch), and in local mode workers can import this package whatever folder the driver was started in."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if sc.master.startswith("local"):
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
        if root not in paths:
            sc.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The strings of a column, null as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def row_identity(key: str, text: str) -> Column:
    """What tells rows apart when their keys repeat or are null: a digest of key and text."""
    return F.xxhash64(F.col(key), F.col(text))


def without(documents: DataFrame, key: str | Column, keys: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose key is not in the one-column ``keys`` (a null key meets a null key).

    The rows travel as one struct, so their column names cannot clash with the join's.
    """
    drop = keys.toDF("drop_key").distinct()
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("record"),
                              (F.col(key) if isinstance(key, str) else key).alias("record_key"))
    return packed.join(drop, F.col("record_key").eqNullSafe(F.col("drop_key")), "left_anti").select("record.*")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``limit`` bytes at most (one longer value stays whole)."""
    for batch in batches:
        at, size = 0, 0
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        for i, n in enumerate(lengths):
            if i > at and size + n > limit:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += n
        if at < batch.num_rows:
            yield batch.slice(at)


def components(edges: DataFrame, stage: Stage, name: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row (node, component), component = smallest node reachable.

    Each round lowers every node's label to the least label among its neighbours, then jumps to that label's own
    label, so path lengths about halve.  Labels live in written tables; the driver sees one count per round.
    Edges of a hot node are joined, never gathered: the joins can be split by AQE and the minimum is pre-aggregated.
    Self-loops and repeated edges are harmless; an empty input gives an empty result.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stage.write(both, f"{name}-edges")
    labels = stage.write(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")),
        f"{name}-0")
    for r in range(1, max_rounds + 1):
        near = (both.join(labels.withColumnRenamed("node", "a"), "a")
                .groupBy(F.col("b").alias("node")).agg(F.min("component").alias("near")))
        lower = (labels.join(near, "node")
                 .select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid")))
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("jump"))
        nxt = stage.write(
            lower.join(jump, "mid").select("node", F.least("mid", "jump").alias("component"),
                                           (F.least("mid", "jump") != F.col("old")).alias("changed")),
            f"{name}-{r}")
        stage.drop(f"{name}-{r - 1}")
        labels = nxt.select("node", "component")
        if nxt.filter("changed").limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return labels
