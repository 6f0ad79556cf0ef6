"""MinHash near-duplicates by a signature-coordinate inverted join.

A document's set is its distinct ``SHINGLE``-word shingles.  Every distinct set gets a MinHash signature of
``COORDINATES`` values and is posted under each (coordinate, value) pair.  Two sets of Jaccard similarity 0.8 agree on
about 0.8 of the coordinates; a pair is a candidate if it collides in at least ``MIN_MATCHES`` of them (a pair exactly
at 0.8 falls short with probability about 7e-6).  Collisions are not counted by emitting pairs:

* postings nobody shares are skipped at once, and a document with fewer than ``MIN_MATCHES`` shared postings is done;
* prefix: with s shared postings, a partner must be met in the s - MIN_MATCHES + 1 least frequent of them, so very
  common pairs (a passage that a third of all documents carry) are not joined at all;
* skip: each posting list is first compared with one member only, the one whose postings are the most frequent (the
  middle of a group of near copies).  Confirmed links give components, and lists whose members are all in one
  component need no more pairs: a group of m near copies costs m pairs, not m * m;
* what is left (lists that span components) is settled exactly on the sets: an inverted join on each set's rarest
  shingles with length and positional filters, only between different components, keeping pairs above the match
  threshold.  A shingle of more than ``HOT`` such sets emits no pairs: its sets lie in blocks of ``BLOCK_BYTES``, blocks
  that share such shingles meet once as arrays, and of the links found there a spanning forest is returned.

Every link is confirmed on the full sets, then components are taken.  Copies (equal sets) are one class from the start.

Edge cases: without words or with null text the set is empty and linked with nothing; with fewer words than a shingle
the whole sequence is the one shingle; rows with a null key take no part (their component is null and they are kept);
rows that repeat a key are one document with several texts: links through any of them count and each row is returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import Stage, components, lower_bytes, row_identity, texts_of, without

SHINGLE = 4
SHARE = 80              # percent: link if 100 * intersection >= SHARE * union
COORDINATES = 32
MIN_MATCHES = 15
HOT = 64                # sets under one rare shingle that may form pairs of rows; more meet in blocks
BLOCK_BYTES = 1 << 20    # of set hashes and signatures in a block; a task holds two blocks
SEED = 7

_M = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for i, b in enumerate((_BASE, _INVERSE)):
            p = np.full(size, np.uint64(b))
            p[0] = 1
            _POWERS[i] = np.cumprod(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word (run of bytes that are not ASCII white space)."""
    step, out, at = 1 << 20, [], 0
    while at < len(data):
        stop = min(len(data), at + step)
        while stop < len(data) and not _SPACE[data[stop]]:     # end the piece at white space
            stop += 1
        buf = np.frombuffer(data, np.uint8, stop - at, at)
        space = _SPACE[buf]
        edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
        begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(begin):
            power, inverse = _powers(len(buf))
            prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * power, dtype=np.uint64)))
            out.append(mix((prefix[end] - prefix[begin]) * inverse[begin] + (end - begin).astype(np.uint64)))
        at = stop
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = word_hashes(lower_bytes(text))
    n = len(words)
    if not n:
        return words
    size = min(n, shingle)
    h = words[: n - size + 1].copy()
    for k in range(1, size):
        h = h * _M + words[k: n - size + 1 + k]
    return np.unique(mix(h + np.uint64(size)))


def exact_set(text: str, shingle: int = SHINGLE) -> frozenset:
    """The set itself, for confirming links."""
    words = lower_bytes(text).split()
    if not words:
        return frozenset()
    size = min(len(words), shingle)
    return frozenset(zip(*(words[k:] for k in range(size))))


def linked(a: frozenset, b: frozenset, share: int = SHARE) -> bool:
    """The confirmed link: Jaccard similarity of at least ``share`` percent."""
    common = len(a & b)
    return bool(a) and bool(b) and 100 * common >= share * (len(a) + len(b) - common)


class _Hasher:
    def __init__(self, coordinates: int):
        rng = np.random.default_rng(SEED)
        self.a = rng.integers(1, 2**63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, coordinates, dtype=np.uint64)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """Signatures of non-empty sets: one row each, the high 32 bits of the least hash per coordinate."""
        return self.of_flat(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1])))

    def of_flat(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The same for sets that lie one after the other in ``flat``, each from its start on; repeats do no harm."""
        out = np.empty((len(starts), len(self.a)), dtype=np.uint32)
        for c in range(len(self.a)):
            out[:, c] = np.minimum.reduceat(flat * self.a[c] + self.b[c], starts) >> np.uint64(32)
        return out


def signatures(documents: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
               coordinates: int = COORDINATES) -> DataFrame:
    """doc, n_shingles, set_id (128-bit digest of the set; null if empty), signature (binary)."""
    schema = T.StructType([T.StructField("doc", documents.schema[key].dataType),
                           T.StructField("n_shingles", T.LongType()),
                           T.StructField("set_id", T.BinaryType()), T.StructField("signature", T.BinaryType())])

    def run(batches):
        hasher = _Hasher(coordinates)
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                sets = [shingle_hashes(t, shingle) for t in texts_of(part)]
                full = [s for s in sets if len(s)]
                rows = iter(hasher.signatures(full) if full else ())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                     pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary())],
                    names=["doc", "n_shingles", "set_id", "signature"])

    return documents.select(F.col(key).alias("doc"), F.col(text).alias("text")).mapInArrow(run, schema)


def postings(classes: DataFrame) -> DataFrame:
    """Each class under its coordinate-value pairs: rep, posting (64-bit)."""
    schema = T.StructType([T.StructField("rep", classes.schema["rep"].dataType),
                           T.StructField("posting", T.LongType())])

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                sig = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint32)
                sig = sig.reshape(part.num_rows, -1).astype(np.uint64)
                pair = mix(sig + (np.arange(1, sig.shape[1] + 1, dtype=np.uint64) << np.uint64(32)))
                reps = np.repeat(np.arange(part.num_rows), sig.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [part.column("rep").take(pa.array(reps)), pa.array(pair.ravel().view(np.int64))],
                    names=["rep", "posting"])

    return classes.select("rep", "signature").mapInArrow(run, schema)


def prefix_postings(classes: DataFrame, stage: Stage, min_matches: int = MIN_MATCHES) -> DataFrame:
    """Shared postings within each class's prefix: rep, posting, weight (sum of its postings' frequencies)."""
    every = postings(classes)
    # counts are written before they are joined: with plain shuffles on both sides AQE can split a hot posting
    shared = stage.write(every.groupBy("posting").agg(F.count("*").alias("freq")).filter("freq > 1"), "frequent")
    met = stage.write(every.join(shared, "posting"), "shared-postings")
    whole = W.partitionBy("rep")                       # at most COORDINATES rows
    ranked = (met.withColumn("n", F.count("*").over(whole)).withColumn("weight", F.sum("freq").over(whole))
              .filter(F.col("n") >= min_matches)
              .withColumn("at", F.row_number().over(whole.orderBy("freq", "posting")))
              .filter(F.col("at") <= F.col("n") - min_matches + 1))
    out = stage.write(ranked.select("rep", "posting", "weight"), "prefix-postings")
    stage.drop("shared-postings", "frequent")
    return out


def _confirm(pairs: DataFrame, texts: DataFrame, shingle: int, share: int) -> DataFrame:
    """The pairs (a, b) that the full sets link; ``texts`` has (rep, text)."""
    both = (pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b"))
    schema = pairs.select("a", "b").schema

    def run(batches):
        last_text, last_set = None, frozenset()
        for batch in batches:
            keep = []
            for ta, tb in zip(texts_of(batch, "text_a"), texts_of(batch, "text_b")):
                if tb != last_text:
                    last_text, last_set = tb, exact_set(tb, shingle)
                keep.append(linked(exact_set(ta, shingle), last_set, share))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(
                pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, schema)


def _agreeing(pairs: DataFrame, classes: DataFrame, min_matches: int) -> DataFrame:
    """The pairs whose signatures agree on at least ``min_matches`` coordinates."""
    both = (pairs.join(classes.select(F.col("rep").alias("a"), F.col("signature").alias("sa")), "a")
            .join(classes.select(F.col("rep").alias("b"), F.col("signature").alias("sb")), "b"))

    def run(batches):
        for batch in batches:
            sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1)
                      for c in ("sa", "sb"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(
                pa.array((sa == sb).sum(1) >= min_matches))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, pairs.select("a", "b").schema)


def star_pairs(prefix: DataFrame, stage: Stage) -> DataFrame:
    """For each class one pair (a = class, b = the centre that most of its posting lists name)."""
    centres = prefix.groupBy("posting").agg(
        F.max(F.struct("weight", (-F.col("rep")).alias("neg"))).alias("top"), F.count("*").alias("n")).filter("n > 1")
    centres = stage.write(centres, "centres")
    named = (prefix.select("rep", "posting")
             .join(centres.select("posting", (-F.col("top.neg")).alias("centre"), F.col("top.weight").alias("w")),
                   "posting")
             .filter(F.col("centre") != F.col("rep"))
             .groupBy("rep", "centre").agg(F.count("*").alias("lists"), F.max("w").alias("w")))
    best = named.groupBy("rep").agg(F.max(F.struct("lists", "w", (-F.col("centre")).alias("neg"))).alias("best"))
    return best.select(F.col("rep").alias("a"), (-F.col("best.neg")).alias("b"))


def residual_prefixes(prefix: DataFrame, comps: DataFrame, texts: DataFrame, stage: Stage, shingle: int,
                      share: int) -> DataFrame:
    """Rarest-shingle prefixes of the classes whose posting lists span components: rep, h, at, size, component."""
    with_comp = (prefix.select("rep", "posting").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
                 .select("rep", "posting", F.coalesce("component", "rep").alias("component")))
    with_comp = stage.write(with_comp, "posting-components")
    open_lists = (with_comp.groupBy("posting")
                  .agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi"))
    open_lists = stage.write(open_lists.select("posting"), "open-lists")
    open_reps = stage.write(
        with_comp.join(open_lists, "posting", "left_semi").select("rep", "component").distinct(),
        "open-classes")
    rep_kind = texts.schema["rep"].dataType

    def sets(batches):
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                found = [shingle_hashes(t, shingle) for t in texts_of(part)]
                at = np.repeat(np.arange(len(found)), [len(s) for s in found])
                flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
                size = np.repeat([len(s) for s in found], [len(s) for s in found])
                yield pa.RecordBatch.from_arrays(
                    [part.column("rep").take(pa.array(at)), part.column("set_id").take(pa.array(at)),
                     pa.array(size, pa.int64()), pa.array(flat.view(np.int64))], names=["rep", "set_id", "size", "h"])

    every = stage.write(
        texts.join(open_reps.select("rep").distinct(), "rep", "left_semi").select("rep", "set_id", "text").mapInArrow(
            sets, T.StructType([T.StructField("rep", rep_kind), T.StructField("set_id", T.BinaryType()),
                                T.StructField("size", T.LongType()), T.StructField("h", T.LongType())])),
        "open-shingles")
    # only shingles of two or more sets can be met; their order is by frequency, rarest first
    df = stage.write(every.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"), "open-frequencies")
    w = W.partitionBy("set_id")
    ranked = (every.join(df, "h")
              .withColumn("from_end", F.row_number().over(w.orderBy(F.desc("df"), F.desc("h"))))
              .withColumn("at", F.col("size") - F.col("from_end"))          # shingles before it in the global order
              .filter(F.col("at") <= F.col("size") - F.ceil(F.col("size") * share / 100)))
    return stage.write(ranked.select("rep", "h", "at", "size").join(open_reps, "rep"), "open-prefixes")


def _room_for(share: int, size_a: str, size_b: str, room_a: Column, room_b: Column) -> Column:
    """Whether sets of these sizes can still share enough in what is left of them."""
    return F.least(room_a, room_b) >= F.ceil(F.lit(share) * (F.col(size_a) + F.col(size_b)) / (100 + share))


def residual_pairs(keyed: DataFrame, heavy: DataFrame, share: int) -> DataFrame:
    """Pairs of different components that the prefixes, lengths and positions allow, but for the shingles in ``heavy``."""
    light = keyed.join(heavy.select("h"), "h", "left_anti")
    a, b = (light.select(F.col("h"), *[F.col(c).alias(c + s) for c in ("rep", "at", "size", "component")])
            for s in ("_a", "_b"))
    pairs = a.join(b, (a.h == b.h) & (F.col("rep_a") < F.col("rep_b")) & (F.col("component_a") != F.col("component_b"))
                   & _room_for(share, "size_a", "size_b", F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b")))
    return pairs.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()


def block_pairs(keyed: DataFrame, heavy: DataFrame, stage: Stage, share: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of the classes under the shingles in ``heavy``: (rep, component, block), and the pairs of blocks (p, q)
    that share such a shingle as prefixes, lengths and positions allow.

    A class lies with those of its largest list, so a group of near copies fills few blocks whatever the number of lists.
    """
    met = stage.write(keyed.join(heavy, "h"), "heavy-postings")
    home = stage.write(met.groupBy("rep", "component").agg(F.max(F.struct("n", "h")).alias("top"), F.max("size").alias("size"))
                       .select("rep", "component", F.col("top.h").alias("home"), "size"), "homes")
    parts = stage.write(home.groupBy("home").agg(
        F.ceil(F.sum(F.col("size") * 8 + 4 * COORDINATES) / BLOCK_BYTES).alias("parts")), "home-parts")
    blocks = stage.write(home.join(parts, "home").select(
        "rep", "component", F.xxhash64("home", F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("block")), "blocks")
    lists = stage.write(
        met.join(blocks.select("rep", "block"), "rep").groupBy("block", "h").agg(
            F.max(F.col("size") - F.col("at")).alias("room"), F.min("size").alias("size"),
            F.min("component").alias("lo"), F.max("component").alias("hi")), "block-lists")
    p, q = (lists.select("h", *[F.col(c).alias(c + s) for c in ("block", "room", "size", "lo", "hi")]) for s in ("_p", "_q"))
    one = (F.col("lo_p") == F.col("hi_q")) & (F.col("hi_p") == F.col("lo_q"))          # all of one component
    pairs = (p.join(q, (p.h == q.h) & (F.col("block_p") <= F.col("block_q")) & ~one
                    & _room_for(share, "size_p", "size_q", F.col("room_p"), F.col("room_q")))
             .select(F.col("block_p").alias("p"), F.col("block_q").alias("q")).distinct())
    return blocks, stage.write(pairs, "block-pairs")


def spanning_links(first: list[tuple], second: list[tuple], share: int, min_matches: int) -> list[tuple]:
    """Links (a, b) of a class in ``first`` with one in ``second`` that join components not joined yet.

    Classes are (rep, component, signature, sorted set hashes); signatures and sets both have to agree.
    """
    if not first or not second:
        return []
    number: dict = {}
    of_first, of_second = (np.array([number.setdefault(c[1], len(number)) for c in part]) for part in (first, second))
    signature = np.stack([c[2] for c in second])
    size = np.array([len(c[3]) for c in second])
    out = []
    for i, (rep, _, sig, hashes) in enumerate(first):
        n = len(hashes)
        near = ((signature == sig).sum(1) >= min_matches) & (100 * np.minimum(size, n) >= share * np.maximum(size, n))
        for j in np.flatnonzero(near & (of_second != of_first[i])).tolist():
            mine, other = of_first[i], of_second[j]
            if mine == other:
                continue
            common = len(np.intersect1d(hashes, second[j][3], assume_unique=True))
            if 100 * common >= share * (n + len(second[j][3]) - common):
                out.append((rep, second[j][0]))
                of_first[of_first == other] = mine
                of_second[of_second == other] = mine
    return out


def block_links(blocks: DataFrame, pairs: DataFrame, texts: DataFrame, stage: Stage, shingle: int, share: int,
                coordinates: int, min_matches: int) -> DataFrame:
    """Links (a, b) within the pairs of blocks: for each pair of blocks a spanning forest of its components."""
    fields = [texts.schema["rep"], blocks.schema["component"], blocks.schema["block"]]
    names = [f.name for f in fields]

    def sets(batches):
        hasher = _Hasher(coordinates)
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                found = [shingle_hashes(t, shingle) for t in texts_of(part)]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in names], pa.array([s.tobytes() for s in hasher.signatures(found)], pa.binary()),
                     pa.array([s.tobytes() for s in found], pa.binary())], names=[*names, "signature", "hashes"])

    members = stage.write(
        texts.join(blocks, "rep").select(*names, "text").mapInArrow(
            sets, T.StructType([*fields, T.StructField("signature", T.BinaryType()),
                                T.StructField("hashes", T.BinaryType())])), "block-members")
    sides = stage.write(
        pairs.select("p", "q", F.col("p").alias("block"), F.lit(0).alias("side"))
        .union(pairs.filter("p < q").select("p", "q", F.col("q").alias("block"), F.lit(1).alias("side"))), "block-sides")

    def sided(table: pa.Table) -> tuple[list, list]:
        """Row numbers of both sides; a block that meets itself is both."""
        side = np.array(table.column("side").to_pylist())
        first = np.flatnonzero(side == 0)
        one = table.column("p")[0].as_py() == table.column("q")[0].as_py()
        return first, first if one else np.flatnonzero(side == 1)

    def agreeing(table: pa.Table) -> pa.Table:
        first, second = sided(table)
        signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(table.num_rows, -1)
        component = np.unique(np.array(table.column("component").to_pylist()), return_inverse=True)[1]
        met = np.zeros(table.num_rows, dtype=bool)
        for i in first.tolist():
            near = second[((signature[second] == signature[i]).sum(1) >= min_matches) & (component[second] != component[i])]
            met[near] = True
            met[i] |= len(near) > 0
        return table.select(["p", "q", "side", "rep"]).filter(pa.array(met))

    def meet(table: pa.Table) -> pa.Table:
        classes = [(rep, component, np.frombuffer(signature, np.uint32), np.frombuffer(hashes, np.uint64))
                   for rep, component, signature, hashes in zip(*(table.column(c).to_pylist() for c in (
                       "rep", "component", "signature", "hashes")))]
        links = spanning_links(*([classes[i] for i in part] for part in sided(table)), share, min_matches)
        kind = table.schema.field("rep").type
        return pa.table([pa.array([x[0] for x in links], kind), pa.array([x[1] for x in links], kind)], names=["a", "b"])

    # signatures travel to every pair of blocks, sets only where they agree
    kind = fields[0].dataType
    met = (sides.join(members.select(*names, "signature"), "block").groupBy("p", "q")
           .applyInArrow(agreeing, T.StructType([*sides.select("p", "q", "side").schema, fields[0]])))
    met = stage.write(met.distinct(), "block-agreeing")
    return (met.join(members, "rep").groupBy("p", "q").applyInArrow(
        meet, T.StructType([T.StructField("a", kind), T.StructField("b", kind)])))


def residual_links(prefix: DataFrame, comps: DataFrame, texts: DataFrame, stage: Stage, shingle: int, share: int,
                   classes: DataFrame | None = None, coordinates: int = 1, min_matches: int = 0) -> DataFrame:
    """Confirmed links (a, b) between components whose posting lists meet, as many as the components need.

    With ``classes`` (rep, signature) the signatures have to agree on ``min_matches`` coordinates too.
    """
    keyed = residual_prefixes(prefix, comps, texts, stage, shingle, share)
    heavy = stage.write(keyed.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > HOT), "heavy-shingles")
    rest = residual_pairs(keyed, heavy, share)
    if classes is not None:
        rest = _agreeing(rest, classes, min_matches)
    if not heavy.isEmpty():
        blocks, meeting = block_pairs(keyed, heavy, stage, share)
        rest = rest.union(block_links(blocks, meeting, texts, stage, shingle, share, coordinates, min_matches)).distinct()
    return stage.write(_confirm(stage.write(rest, "residual"), texts, shingle, share), "residual-links")


def near_duplicates(documents: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    share: int = SHARE, coordinates: int = COORDINATES, min_matches: int = MIN_MATCHES) -> DataFrame:
    """One row per row of ``documents``: key, n_shingles, component_id, kept (key = component_id)."""
    stage = Stage(documents.sparkSession, "minhash")
    signed = stage.write(signatures(documents, key=key, text=text, shingle=shingle, coordinates=coordinates), "signed")
    part = signed.filter("set_id is not null and doc is not null")
    first = part.groupBy("set_id").agg(F.min("doc").alias("rep"), F.first("signature").alias("signature"))
    classes = stage.write(first, "classes")
    prefix = prefix_postings(classes, stage, min_matches)

    # the texts of classes that may have a partner, once; a class is found by its set, so a key that repeats is safe
    able = prefix.select("rep").distinct()
    wanted = (documents.select(F.col(key).alias("rep"), F.col(text).alias("text"))
              .join(able, "rep", "left_semi"))
    digest = classes.join(able, "rep", "left_semi").select("set_id", F.col("rep").alias("rep_of"))
    texts = stage.write(_class_texts(wanted, digest, shingle), "texts")

    links = stage.write(_confirm(_agreeing(star_pairs(prefix, stage), classes, min_matches), texts, shingle, share), "star")
    comps = components(links, stage, "star-components")
    more = residual_links(prefix, comps, texts, stage, shingle, share, classes, coordinates, min_matches)

    # classes hold all documents of one set; a document whose key repeats joins its sets
    member = part.select("doc", "set_id").join(classes.select("set_id", "rep"), "set_id")
    own = member.filter("doc <> rep").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    final = components(links.union(more).union(own).distinct(), stage, "components")
    out = (signed.join(final.withColumnRenamed("node", "doc"), "doc", "left")
           .select(F.col("doc").alias(key), "n_shingles", F.coalesce("component", "doc").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def _class_texts(wanted: DataFrame, digest: DataFrame, shingle: int) -> DataFrame:
    """(rep, text) with the text whose set is the class's own, one row per class."""
    schema = T.StructType([*wanted.schema, T.StructField("set_id", T.BinaryType())])

    def run(batches):
        for batch in batches:
            ids = [xxhash.xxh3_128_digest(shingle_hashes(t, shingle).tobytes()) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())],
                                             names=[*batch.schema.names, "set_id"])

    return (wanted.mapInArrow(run, schema).join(digest, "set_id").filter(F.col("rep") == F.col("rep_of"))
            .dropDuplicates(["rep", "set_id"]).select("rep", "set_id", "text"))


def deduplicated(documents: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each near-duplicate group, all its columns: the one of least key, null keys last.

    Rows are judged, not keys: rows that share a key, null included, are linked by their own texts only, and of rows
    equal in key and text one stays.  Rows without words are in no group and stay.
    """
    stage = Stage(documents.sparkSession, "deduplicated")
    row = row_identity(key, text)
    rows = documents.select(row.alias("row"), F.col(key).alias("id"), F.col(text).alias("text"))
    judged = near_duplicates(rows.select("row", "text"), key="row", **options).filter("n_shingles > 0")
    judged = stage.write(judged.groupBy("row").agg(F.min("component_id").alias("component"),
                                                   F.count("*").alias("copies")), "judged")
    groups = judged.groupBy("component").agg(F.sum("copies").alias("n")).filter("n > 1").select("component")
    members = stage.write(judged.join(stage.write(groups, "groups"), "component"), "members")
    first = (rows.select("row", "id").join(members.select("row", "component"), "row").groupBy("component")
             .agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first")))
    keepers = stage.write(members.join(first.select(F.col("first.row").alias("row")), "row", "left_semi"), "keepers")
    single = without(documents, row, members.join(keepers.filter("copies = 1"), "row", "left_anti").select("row"))
    # written first, so that a row with many copies is counted per task before it is shuffled
    equal = stage.write(documents.select(row.alias("row"), F.struct(*[F.col(f"`{c}`") for c in documents.columns])
                                         .alias("record"))
                        .join(keepers.filter("copies > 1").select("row"), "row", "left_semi"), "equal")
    return single.union(equal.groupBy("row").agg(F.min("record").alias("record")).select("record.*"))
