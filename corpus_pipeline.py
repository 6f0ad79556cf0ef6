"""A corpus pipeline of five stages over ``documents``.

quality rules -> MinHash near-dedup -> suffix-array dedup -> benchmark decontamination -> byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns a DataFrame; all but the
last return the columns of ``documents``.  ``run`` writes each stage's result as Parquet under the shared checkpoint
folder and reads it again as the next stage's input, so a lost executor re-runs at most one stage's tasks.

A stage's row identity is the whole row: rows that repeat an id are each judged, null ids are kept and judged too.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlens.llm import op1_decontaminate, op2_quality, op3_minhash, op8_bpe, op10_suffix
from screenlens.llm.common import Stage, importable_on_workers
from screenlens.sources.tables import read_table

#: no SQL twin: the stages hash, fit a forest, sample and encode
ORACLE_SQL = None
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
NEAR_SHINGLE = 5        # words; similarity 0.8, the defaults of near-duplicate stages
REPEAT_BYTES = 250      # a passage of over 50 words is at least about this long (the operator's own default is 400)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the isolation forest accept."""
    importable_on_workers(spark)
    labels = read_table(spark, sf_dir, "labels", "doc_id", "quality")
    return op2_quality.accepted(docs.select(*COLUMNS), labels)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least id of each near-duplicate group; rows without a group stay."""
    importable_on_workers(spark)
    return op3_minhash.deduplicated(docs.select(*COLUMNS), shingle=NEAR_SHINGLE)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the bytes of long repeated passages; n_chars follows the new text."""
    importable_on_workers(spark)
    cut = op10_suffix.remove_repeats(docs.select(*COLUMNS), length=REPEAT_BYTES)
    return cut.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))
                          .otherwise(F.col("n_chars")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    importable_on_workers(spark)
    benchmark = read_table(spark, sf_dir, "benchmark", "item_id", "text")
    return op1_decontaminate.clean_rows(docs.select(*COLUMNS), benchmark)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded bytes."""
    importable_on_workers(spark)
    return op8_bpe.digests(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                           public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup),
          ("decontaminate", decontaminate), ("byte_bpe", byte_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; the last stage's rows."""
    stage = Stage(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents", *COLUMNS)
    for number, (name, function) in enumerate(STAGES):
        docs = stage.write(function(spark, docs, sf_dir), f"{number}-{name}")
        if number:
            stage.drop(f"{number - 1}-{STAGES[number - 1][0]}")
    return docs
