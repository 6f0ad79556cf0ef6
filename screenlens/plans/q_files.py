"""Catalogue: tables through files (CSV cohort, kept JSON samples, confusion matrices as CSV)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import metrics as M
from ..operators.corpus_index import shared_folder, source_digest
from ..operators.store import save_table
from ..sources import files as FL
from ..sources import fixtures as X
from ..streaming.stream import scratch_dir
from .catalog import QUERIES, query

COHORT = ["record_id", "job", "exposure", "age", "sbp_result", "chest_judgment", "symptom", "label"]
LABEL_NAMES = {k: C.LABELS[k] for k in C.THREE_CLASS}


@query("cohort_csv")
def q_cohort_csv(spark: SparkSession, sf: str) -> DataFrame:
    """EXAM saved as CSV and loaded by its suffix."""
    path = f"{scratch_dir(spark, 'cohort')}/exam.csv"
    save_table(X.exam(spark, sf).select(*COHORT), path, "csv")
    return FL.load_cohort(spark, path).rows


@query("demo_samples_kept")
def q_demo_samples_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Demo samples from their kept JSON, built where the tables' files have changed."""
    tables = "-".join(source_digest(X.read_table(spark, sf, t)) for t in ("lineitem", "orders", "customer"))
    return FL.read_or_build(spark, f"{shared_folder(spark)}/samples", tables,
                            lambda: QUERIES["demo_samples"](spark, sf))


@query("confusion_csv")
def q_confusion_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The models' confusion matrices read back from their CSV files."""
    folder = scratch_dir(spark, "confusion")
    FL.write_confusion(M.confusion_cells(X.pred(spark, sf)), folder, LABEL_NAMES)
    read = spark.read.option("header", "true").csv(folder)
    return read.select("model", "label", *[F.col(f"`{n}`").cast("bigint").alias(f"predicted_{k}")
                                           for k, n in LABEL_NAMES.items()])
