"""SimHash near-duplicates by pivot distance tables.

A text's fingerprint takes one bit per position: set where over half of its shingles' XXH64 hashes have it set.  Two
fingerprints link if they differ in at most ``RADIUS`` bits.

* Pivot table: the Hamming distances of a fingerprint to ``PIVOTS`` fixed reference fingerprints.  By the triangle
  inequality two fingerprints within RADIUS differ by at most RADIUS in every coordinate, so a pair whose largest
  coordinate difference is greater is discarded unseen; survivors are verified on the fingerprints themselves.
* Which pairs are compared: bit positions are split into blocks and RADIUS differing bits leave all but RADIUS of them
  equal, so linked fingerprints share the key of some choice of ``blocks - RADIUS`` blocks.  The number of blocks
  follows the number of distinct fingerprints (a key has at least as many values), which keeps chance meetings rare at
  every size.  Fingerprints are posted under their keys; keys of at most ``COLD`` members compare their pairs.
* Keys with more members (a cloud of near copies) form no pairs.  Their members are posted under every reference within
  RADIUS / 2 of them, the entries of an unbounded pivot table that are small: two fingerprints are within RADIUS exactly
  if they share such a reference (a point half way between them), and all members of a reference are linked with each
  other.  This costs the same 2,081 entries a fingerprint however many members meet.  A fingerprint is first linked to
  the least one it meets; references whose members are then still apart link the components they span.

Copies collapse to one fingerprint first; links become components; every row then gets its fingerprint's component.

Edge cases: without words, or with a null text, the fingerprint is zero and links like any other; with fewer words than a
shingle the whole sequence is one shingle; rows with a null key take part, but their key is no component's name (a
component of null keys only is null); repeated rows and keys are each returned, judged by their own text; texts of any
length are read in pieces; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stage, components, lower_bytes, slices
from .op11_filter_audit import pieces

SHINGLE = 4
HASH_SEED = 42
RADIUS = 4              # bits
PIVOTS = 32
PIVOT_SEED = 12
COLD = 64               # members of a key whose pairs are compared
MAX_BLOCKS = 16


def shingles(data: bytes, size: int = SHINGLE) -> Iterator[list[bytes]]:
    """The space-joined shingles of a lower-cased text, repeats included, piece by piece."""
    carry, any_yet = [], False
    for piece in pieces(data):
        words = carry + piece.split()
        if len(words) >= size:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            begins = np.concatenate(([0], ends[:-1] + 1))
            any_yet = True
            yield [joined[a:b] for a, b in zip(begins[: len(words) - size + 1].tolist(), ends[size - 1:].tolist())]
            carry = words[len(words) - size + 1:] if size > 1 else []
        else:
            carry = words
    if carry and not any_yet:
        yield [b" ".join(carry)]


def fingerprint(data: bytes, size: int = SHINGLE) -> int:
    """The fingerprint of a lower-cased text as an unsigned number."""
    ones, n = np.zeros(64, np.int64), 0
    digest = xxhash.xxh64_intdigest
    for some in shingles(data, size):
        for at in range(0, len(some), 1 << 16):
            part = some[at: at + (1 << 16)]
            h = np.fromiter((digest(s, HASH_SEED) for s in part), np.uint64, len(part))
            ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
                0, dtype=np.int64)
            n += len(part)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc, fp (the fingerprint as a signed 64-bit number); one row per row."""
    schema = T.StructType([T.StructField("doc", documents.schema[key].dataType), T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in slices(batches, "text"):
            found = np.fromiter((fingerprint(lower_bytes(t or ""), size) for t in batch.column("text").to_pylist()),
                                np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(found.view(np.int64))], names=["doc", "fp"])

    return documents.select(F.col(key).alias("doc"), F.col(text).alias("text")).mapInArrow(run, schema)


def key_masks(blocks: int, radius: int = RADIUS) -> np.ndarray:
    """Bit masks of all choices of ``blocks - radius`` of the blocks: fingerprints within radius agree under one."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    return np.array([sum(c) for c in itertools.combinations(block, blocks - radius)], np.uint64)


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """The least number of blocks whose keys have at least ``n`` values."""
    return next((b for b in range(radius + 2, MAX_BLOCKS) if 64 * (b - radius) // b >= n.bit_length()), MAX_BLOCKS)


def pivots(count: int = PIVOTS) -> np.ndarray:
    """The fixed reference fingerprints."""
    return np.random.default_rng(PIVOT_SEED).integers(0, 2**64, count, dtype=np.uint64)


def pivot_table(fps: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Hamming distances, one row per fingerprint and one column per reference."""
    return np.bitwise_count(fps[:, None] ^ references[None, :]).astype(np.int8)


def posted(classes: DataFrame, blocks: int) -> DataFrame:
    """key, fp: each fingerprint under its keys."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches):
        masks = key_masks(blocks)
        salt = np.random.default_rng(PIVOT_SEED + 1).integers(0, 2**64, len(masks), dtype=np.uint64)
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            # an odd product mixes the agreeing bits; keys that happen to be equal only meet more members
            key = ((fp[:, None] & masks) ^ salt) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)),
                                              pa.array(np.repeat(fp, len(masks)).view(np.int64))], names=["key", "fp"])

    return classes.select("fp").mapInArrow(run, schema)


def linked_neighbours(keys: np.ndarray, fps: np.ndarray, references: np.ndarray, radius: int = RADIUS,
                      members: int = COLD) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of linked pairs with equal keys; ``keys`` is sorted and has runs of at most ``members``."""
    table = pivot_table(fps, references)
    left, right = [], []
    for step in range(1, members):
        if step >= len(keys):
            break
        i = np.flatnonzero(keys[step:] == keys[:-step])
        if not len(i):
            break
        i = i[(np.abs(table[i] - table[i + step]) <= radius).all(1)]        # largest coordinate difference
        i = i[np.bitwise_count(fps[i] ^ fps[i + step]) <= radius]           # survivors
        left.append(i)
        right.append(i + step)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def cold_links(postings: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) among the members of the same key; every key has at most COLD members."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches):
        references = pivots()
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.concatenate((keys, batch.column("key").to_numpy()))
            fps = np.concatenate((fps, batch.column("fp").to_numpy().view(np.uint64)))
            end = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last key may go on in the next batch
            i, j = linked_neighbours(keys[:end], fps[:end], references, radius)
            yield pa.RecordBatch.from_arrays([pa.array(fps[i].view(np.int64)), pa.array(fps[j].view(np.int64))],
                                             names=["a", "b"])
            keys, fps = keys[end:], fps[end:]
        i, j = linked_neighbours(keys, fps, references, radius)
        yield pa.RecordBatch.from_arrays([pa.array(fps[i].view(np.int64)), pa.array(fps[j].view(np.int64))],
                                         names=["a", "b"])

    return postings.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, schema)


def flips(radius: int = RADIUS) -> np.ndarray:
    """All bit patterns with at most half of ``radius`` bits set."""
    return np.array([sum(1 << b for b in bits) for k in range(radius // 2 + 1)
                     for bits in itertools.combinations(range(64), k)], np.uint64)


def hot_links(members: DataFrame, stage: Stage, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect all of ``members(fp)`` within the radius of each other, through shared references."""
    schema = T.StructType([T.StructField("reference", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches):
        near = flips(radius)
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(fps), 64):
                some = fps[at: at + 64]
                yield pa.RecordBatch.from_arrays([pa.array((some[:, None] ^ near).ravel().view(np.int64)),
                                                  pa.array(np.repeat(some, len(near)).view(np.int64))],
                                                 names=["reference", "fp"])

    # the members of a reference lie in a ball around it: 2,081 at most
    met = stage.write(members.repartition("fp").mapInArrow(run, schema).groupBy("reference")
                      .agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1), "references")
    # one link a fingerprint settles most references; only those that still span components give further links
    entries = met.select("reference", F.array_min("fps").alias("least"), F.explode("fps").alias("fp"))
    star = stage.write(entries.groupBy("fp").agg(F.min("least").alias("b")).filter("b <> fp")
                       .select(F.col("fp").alias("a"), "b"), "star-links")
    settled = components(star, stage, "star-components").withColumnRenamed("node", "fp")
    spans = (entries.join(settled, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
             .groupBy("reference").agg(F.collect_set("component").alias("found")).filter(F.size("found") > 1))
    rest = spans.select(F.array_min("found").alias("a"), F.explode("found").alias("b")).filter("a <> b").distinct()
    return star.union(stage.write(rest, "rest-links"))


def simhash_groups(documents: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SHINGLE,
                   cold: int = COLD) -> DataFrame:
    """One row per row of ``documents``: key, fingerprint (16 hexadecimal digits), component_id."""
    stage = Stage(documents.sparkSession, "simhash")
    signed = stage.write(fingerprints(documents, key=key, text=text, size=size), "signed")
    classes = stage.write(signed.groupBy("fp").agg(F.min("doc").alias("least")), "classes")
    postings = posted(classes, blocks_for(classes.count()))
    # counts are written before they are joined: with plain shuffles on both sides AQE can split a hot key
    shared = stage.write(postings.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"), "keys")
    met = stage.write(postings.join(shared, "key"), "met")
    links = stage.write(cold_links(met.filter(F.col("members") <= cold).select("key", "fp")), "cold-links")
    dense = hot_links(met.filter(F.col("members") > cold).select("fp").distinct(), stage)
    found = components(links.union(dense), stage, "components")
    grouped = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    named = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = stage.write(grouped.join(named, "component").select("fp", "component_id"), "named")
    return signed.join(answer, "fp").select(
        F.col("doc").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
