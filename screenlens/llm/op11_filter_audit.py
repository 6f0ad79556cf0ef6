"""Audit of how five text filters interact, from a sparse document-term matrix.

The matrix: each task counts the words of its documents against a dictionary of its own shard (about ``SHARD_BYTES`` of
text, or one longer document); the shards' words meet once, a number is given to each word of the whole table, and each
shard's columns are rewritten to those global codes.  A shard is then a CSR block (row starts, global column codes,
counts): a row's sum is its number of words, its stored entries are its distinct words.

Filters (a document *fails* one): A under ``MIN_WORDS`` words; B distinct words under half of the words; C capital letters
A-Z over 2 % of the code points; D holds one of ``#$%&*|``; E equal to the text of a smaller id anywhere in the table.
Documents are then counted per (part, set of failed filters, labels), and the 120 orders are evaluated on those counts.

Hot groups: copies of one text collapse before they are shuffled (their counts meet under the text's digest), null ids
are kept out of the joins, parts are only ever counted.  Texts are read once and never shuffled; words travel once per
shard, a document's entries once.

Edge cases: a null text is the empty text (fails A only, unless a smaller id has it too); a null part is the empty
string; a null id is smaller than none and has none smaller, and no labels; rows that repeat an id are each counted, and
do not fail E because of each other; labels that repeat an id count if any of their rows does; a text of any length is
cut at white space and counted piece by piece; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Stage, slices

FILTERS = "ABCDE"
MIN_WORDS = 200
SHARD_BYTES = 16 << 20
PIECE = 4 << 20
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#$%&*|"
_SPACE = b" \t\n\x0b\x0c\r"


def pieces(data: bytes, step: int = PIECE) -> Iterator[bytes]:
    """The text in pieces that end at white space (or at the end), so that no word is cut."""
    at = 0
    while at < len(data):
        stop = min(len(data), at + step)
        while stop < len(data) and data[stop] not in _SPACE:
            stop += 1
        yield data[at:stop]
        at = stop


def word_counts(data: bytes) -> Counter:
    """Words (runs of bytes that are not ASCII white space) and how often each occurs."""
    counts: Counter = Counter()
    for piece in pieces(data):
        counts.update(piece.split())
    return counts


def text_marks(data: bytes, code_points: int) -> int:
    """The failed ones of the filters that need no words: 4 for C, 8 for D."""
    capitals = len(data) - len(data.translate(None, CAPITALS))
    return 4 * (100 * capitals > 2 * code_points) + 8 * (len(data.translate(None, SYMBOLS)) < len(data))


def counted(documents: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "source",
            shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Documents in shards, with columns of the shard's own dictionary; one more row per shard holds its ``words``."""
    schema = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("doc", documents.schema[key].dataType),
        T.StructField("part", T.StringType()), T.StructField("marks", T.IntegerType()),
        T.StructField("digest", T.BinaryType()), T.StructField("columns", T.ArrayType(T.IntegerType())),
        T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("words", T.ArrayType(T.BinaryType()))])
    names = schema.names

    def run(batches):
        def words_row(shard, codes):
            empty = [pa.nulls(1, k) for k in (doc_kind, pa.string(), pa.int32(), pa.binary(), entries, entries)]
            return pa.RecordBatch.from_arrays(
                [pa.array([shard]), *empty, pa.array([list(codes)], pa.list_(pa.binary()))], names=names)

        entries = pa.list_(pa.int32())
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        number, codes, size, doc_kind = 0, {}, 0, pa.null()
        for batch in slices(batches, "text"):
            doc_kind = batch.schema.field("doc").type
            columns, counts, starts, marks, digests = [], [], [0], [], []
            for t in batch.column("text").to_pylist():
                t = t or ""
                data = t.encode("utf-8", "surrogatepass")
                found = word_counts(data)
                columns.extend([codes.setdefault(w, len(codes)) for w in found])
                counts.extend(found.values())
                starts.append(len(columns))
                marks.append(text_marks(data, len(t)))
                digests.append(xxhash.xxh3_128_digest(data))
                size += len(data)
            at = pa.array(starts, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(batch.num_rows, first + number)), batch.column("doc"), batch.column("part"),
                 pa.array(marks, pa.int32()), pa.array(digests, pa.binary()),
                 pa.ListArray.from_arrays(at, pa.array(columns, pa.int32())),
                 pa.ListArray.from_arrays(at, pa.array(counts, pa.int32())),
                 pa.nulls(batch.num_rows, pa.list_(pa.binary()))], names=names)
            if size >= shard_bytes:
                yield words_row(first + number, codes)
                number, codes, size = number + 1, {}, 0
        if codes:
            yield words_row(first + number, codes)

    return documents.select(F.col(key).alias("doc"), F.col(text).alias("text"),
                            F.coalesce(F.col(part), F.lit("")).alias("part")).mapInArrow(run, schema)


def global_codes(in_shards: DataFrame, stage: Stage) -> DataFrame:
    """shard, at, code: the words of all shards (shard, at, word) numbered from 0 without gaps.

    A word's rows (one per shard that has it) meet in one partition, which numbers its words in order; the partitions'
    word counts, one row each, then give every partition its first number.
    """
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("at", T.IntegerType()),
                           T.StructField("slot", T.IntegerType()), T.StructField("own", T.LongType())])

    def run(batches):
        slot, last, number = TaskContext.get().partitionId(), None, -1
        for batch in batches:
            word = batch.column("word")
            if not len(word):
                continue
            fresh = np.ones(len(word), np.int64)
            fresh[1:] = pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)
            fresh[0] = last is None or word[0].as_py() != last
            own = number + np.cumsum(fresh)
            last, number = word[-1].as_py(), int(own[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), batch.column("at"), pa.array(np.full(len(word), slot, np.int32)), pa.array(own)],
                names=schema.names)

    numbered = stage.write(in_shards.repartition("word").sortWithinPartitions("word").mapInArrow(run, schema), "codes")
    before = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    first = (numbered.groupBy("slot").agg((F.max("own") + 1).alias("words"))
             .select("slot", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("first")))
    return numbered.join(F.broadcast(first), "slot").select("shard", "at", (F.col("first") + F.col("own")).alias("code"))


def csr_block(documents: pa.Table, dictionary: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard as CSR: row starts, global column codes, counts.  ``dictionary`` maps the shard's columns (at) to codes."""
    local = documents.column("columns").combine_chunks()
    starts = np.concatenate(([0], np.cumsum(pc.list_value_length(local).to_numpy(zero_copy_only=False))))
    codes = np.zeros(dictionary.num_rows, np.int64)
    codes[dictionary.column("at").to_numpy()] = dictionary.column("code").to_numpy()
    data = documents.column("counts").combine_chunks().flatten().to_numpy()
    return starts.astype(np.int64), codes[local.flatten().to_numpy()], data


def row_statistics(starts: np.ndarray, columns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of a CSR block: the sum of its entries and the number of its nonzero columns."""
    total = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((columns, row))
    row, column = row[order], columns[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (column[1:] != column[:-1])
    return total[starts[1:]] - total[starts[:-1]], np.bincount(row[fresh], minlength=len(starts) - 1)


def document_facts(documents: DataFrame, stage: Stage, *, key: str = "doc_id", text: str = "text",
                   part: str = "source", min_words: int = MIN_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc, part, digest of the text, n_words, n_distinct, failed (bits 1, 2, 4, 8 for A to D); one row per row."""
    local = stage.write(counted(documents, key=key, text=text, part=part, shard_bytes=shard_bytes), "counted")
    coded = global_codes(local.select("shard", F.posexplode("words").alias("at", "word")), stage)
    rows = stage.read("counted", local.schema).filter("digest is not null").drop("words")
    schema = T.StructType([rows.schema["doc"], rows.schema["part"], rows.schema["digest"],
                           T.StructField("n_words", T.LongType()), T.StructField("n_distinct", T.LongType()),
                           T.StructField("failed", T.IntegerType())])

    def judge(docs: pa.Table, codes: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table([pa.array([], f.type) for f in out_schema], schema=out_schema)
        n_words, n_distinct = row_statistics(*csr_block(docs, codes))
        failed = (docs.column("marks").to_numpy() + (n_words < min_words) + 2 * (100 * n_distinct < 50 * n_words))
        return pa.table([docs.column("doc"), docs.column("part"), docs.column("digest"), pa.array(n_words, pa.int64()),
                         pa.array(n_distinct, pa.int64()), pa.array(failed, pa.int32())], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_schema
    out_schema = to_arrow_schema(schema)
    return stage.write(rows.groupBy("shard").cogroup(coded.groupBy("shard")).applyInArrow(judge, schema), "facts")


def failure_counts(facts: DataFrame, labels: DataFrame, stage: Stage, label_key: str = "doc_id") -> DataFrame:
    """n documents per (part, failed bits of A to E, good, toxic)."""
    marked = (labels.select(F.col(label_key).alias("doc"), "quality", "toxic").filter("doc is not null").groupBy("doc")
              .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                   F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")))
    same = ["digest", "part", "failed", "good", "toxic"]
    no = F.lit(False)
    # copies with one id first (the rows are dealt by id, which no text can make hot), then all copies of a text
    known = (facts.filter("doc is not null").join(marked, "doc", "left")
             .withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})
             .groupBy("doc", *same).agg(F.count("*").alias("n"))
             .groupBy(*same).agg(F.sum("n").alias("n"), F.min(F.struct("doc", "n")).alias("least")))
    unknown = (facts.filter("doc is null").withColumns({"good": no, "toxic": no})
               .groupBy(*same).agg(F.count("*").alias("n")))
    alike = stage.write(known.select(*same, "n", F.col("least.doc").alias("doc"), F.col("least.n").alias("n_least")),
                        "alike")
    first = alike.groupBy("digest").agg(F.min("doc").alias("first"))
    split = (alike.join(first, "digest")
             .select("part", "failed", "good", "toxic", "n",
                     F.when(F.col("doc") == F.col("first"), F.col("n_least")).otherwise(0).alias("passing")))
    cell = ["part", "good", "toxic"]
    cells = (split.select(*cell, "failed", F.col("passing").alias("n"))
             .union(split.select(*cell, F.col("failed") + 16, F.col("n") - F.col("passing")))
             .union(unknown.select(*cell, "failed", "n")))
    return (cells.filter("n > 0").groupBy("part", "failed", "good", "toxic").agg(F.sum("n").alias("n")))


def order_effects() -> list[tuple]:
    """What each order's steps do to a document by its failed bits: (failed, filter_order, step, kept, removed,
    redundant, unique_fails, orders in which the step's filter removes it): 32 x 120 x 5 fixed rows."""
    out = []
    for failed in range(32):
        fails = [bool(failed >> i & 1) for i in range(5)]
        for order in itertools.permutations(range(5)):
            gone = False
            for step, f in enumerate(order, 1):
                removed, redundant = fails[f] and not gone, fails[f] and gone
                gone = gone or fails[f]
                out.append((failed, "".join(FILTERS[i] for i in order), step, int(not gone), int(removed), int(redundant),
                            int(failed == 1 << f), 120 // sum(fails) if fails[f] else 0))
    return out


def filter_audit(documents: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text",
                 part: str = "source", min_words: int = MIN_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per (part, filter_order, step): kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark = documents.sparkSession
    stage = Stage(spark, "audit")
    facts = document_facts(documents, stage, key=key, text=text, part=part, min_words=min_words, shard_bytes=shard_bytes)
    cells = stage.write(failure_counts(facts, labels, stage), "cells")
    effects = spark.createDataFrame(order_effects(), "failed int, filter_order string, step int, k int, r int, d int, "
                                                     "u int, s int")
    n = F.col("n")
    return (cells.join(F.broadcast(effects), "failed").groupBy("part", "filter_order", "step")
            .agg(F.sum(n * F.col("k")).alias("kept"), F.sum(n * F.col("r")).alias("removed"),
                 F.sum(n * F.col("d")).alias("redundant"), F.sum(n * F.col("u")).alias("unique_fails"),
                 F.sum(n * F.col("r") * F.col("good").cast("int")).alias("good_lost"),
                 F.sum(n * F.col("r") * F.col("toxic").cast("int")).alias("toxic_lost"),
                 F.sum(n * F.col("s")).alias("shapley")))
