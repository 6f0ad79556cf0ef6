"""Append-only result, case and operation-log tables and their searches.

Tables are Parquet batches with a ledger of claimed id ranges (``ledger``),
so retries and several writers leave rows single and ids dense.  Searches are chained
``filter``s ending in ``orderBy(desc id).limit(n)``, which Spark plans as a
``TakeOrderedAndProject``: each task keeps its own top-n, so listing never
sorts the whole table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.findings import rule_hit_tag
from ..functions.text import sanitize_name
from .ledger import Ledger

RECORD_COLUMNS = ["id", "username", "input_mode", "sample_id", "final_label", "final_source", "diagnosis",
                  "advice_mode", "created_at", "record_json", "result_json"]
CASE_COLUMNS = ["id", "username", "final_label", "diagnosis", "note", "created_at", "record_json", "result_json",
                "rule_hit_tag", "rule_version"]
LOG_COLUMNS = ["id", "username", "action", "detail", "created_at"]


def clean_text(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def normalize_log(df: DataFrame) -> DataFrame:
    """Operation-log projection: blank user -> 'anonymous', trimmed action and detail."""
    user = clean_text(F.col("username"))
    return df.select(*[c for c in df.columns if c not in ("username", "action", "detail")],
                     F.when(user == "", F.lit(C.ANONYMOUS_USER)).otherwise(user).alias("username"),
                     clean_text(F.col("action")).alias("action"), clean_text(F.col("detail")).alias("detail"))


def read_store(spark: SparkSession, path: str, columns: Mapping[str, str]) -> DataFrame | None:
    """The stored table, columns that an older version lacks filled with ''; None before the first append."""
    table = Ledger(spark, path).read()
    return None if table is None else ensure_columns(table, columns)


def append_to(batch: DataFrame, path: str, order: Sequence[str | Column], columns: Sequence[str],
              batch_id: str) -> DataFrame:
    """Append a batch to the table at ``path``; its ids go on after the stored ones.  Returns the whole table.

    Safe for several writers; a batch id that is stored already is not appended again (``ledger``).
    """
    spark = batch.sparkSession
    Ledger(spark, path).append(batch, batch_id, order, columns)
    return read_store(spark, path, {})


def export_text(df: DataFrame, path: str, name: Column, body: Column, buckets: int = 64) -> None:
    """Write one text per row (advice, report) as (file_name, body) Parquet rows, dealt into folders by name hash."""
    out = df.select(sanitize_name(name).alias("file_name"), body.alias("body"))
    out.withColumn("bucket", F.pmod(F.xxhash64("file_name"), F.lit(buckets))).write.mode("overwrite").partitionBy(
        "bucket").parquet(path)


def save_table(df: DataFrame, path: str, kind: str) -> None:
    """Save as ``csv`` (with header) or ``parquet``; any other kind is an error."""
    if kind == "csv":
        df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
    elif kind == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown table format: {kind!r} (csv or parquet)")


def ensure_columns(df: DataFrame, columns: Mapping[str, str], default: str = "") -> DataFrame:
    """Add missing columns (schema evolution of an older table), filled with ``default``."""
    missing = {c: F.lit(default).cast(t) for c, t in columns.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def case_rows(records: DataFrame, rule_version: str, note: Column | None = None) -> DataFrame:
    """Expert-case projection: rule-hit tag from the result, version, note."""
    return records.select(
        "username", "final_label", "diagnosis", (note if note is not None else F.lit("")).alias("note"),
        "created_at", "record_json", "result_json",
        rule_hit_tag(F.col("final_source"), F.col("rule_id")).alias("rule_hit_tag"),
        F.lit(rule_version).alias("rule_version"), *[c for c in ("record_id",) if c in records.columns])


# ------------------------------------------------------------------ search

def keyword_match(columns: Sequence[str], keyword: str, compat: bool = False) -> Column:
    """Any column contains the keyword (case-insensitive).  compat: SQL LIKE with user wildcards."""
    if compat:
        pat = f"%{keyword}%"
        return _any([F.col(c).cast("string").ilike(pat) for c in columns])
    kw = keyword.lower()
    return _any([F.coalesce(F.lower(F.col(c).cast("string")).contains(kw), F.lit(False)) for c in columns])


def _any(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def search(table: DataFrame, *, keyword: str = "", keyword_columns: Sequence[str] = (),
           equals: Mapping[str, str] | None = None, contains: Mapping[str, str] | None = None,
           prefix: Mapping[str, str] | None = None, select: Sequence[str] = (), limit: int = C.LIST_LIMIT,
           compat: bool = False) -> DataFrame:
    """Filtered listing, newest first.  Blank parameters are ignored; output values are text, null -> ''."""
    df = table
    if keyword.strip():
        df = df.where(keyword_match(keyword_columns, keyword.strip(), compat))
    for c, v in (equals or {}).items():
        if v.strip():
            df = df.where(F.col(c) == v.strip())
    for c, v in (contains or {}).items():
        if v.strip():
            df = df.where(keyword_match([c], v.strip(), compat))
    for c, v in (prefix or {}).items():
        if v.strip():
            cond = keyword_match([c], v.strip(), True) if compat else F.col(c).startswith(v.strip())
            df = df.where(cond)
    out = df.orderBy(F.desc("id")).limit(limit)
    return out.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in select])


def replay(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Saved rows for a batch of ids, with the JSON payloads decoded."""
    hit = table.join(ids.select("id").distinct(), "id", "left_semi")
    return hit.select("*", F.from_json("record_json", "map<string,string>").alias("record"),
                      F.from_json("result_json", "map<string,string>").alias("result"))
