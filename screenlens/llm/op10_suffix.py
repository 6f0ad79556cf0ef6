"""Removal of long repeated byte strings with a run-length (r-)index.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else is removed; strings are judged on the input
and never cross documents.  No single index can hold a large corpus, so the index is built in pieces that together see
every match:

1. Every ``LENGTH``-byte window has an *anchor*: the q-gram of least hash in it (the leftmost on ties).  Equal windows
   have equal anchors.  Maximal runs of windows with one anchor form a segment, about 600 bytes each, named by a digest;
   one scan writes (anchor, segment, place) and no text.
2. An anchor seen once holds no match.  Segments seen more than once are covered whole, whatever their number: copies
   and the inside of common passages are settled by counting.
3. Left are segments seen once whose anchor has others: the rims of matches.  Their bytes are fetched and dealt by
   anchor into buckets of ``BUCKET_BYTES``.  Segments that share too little about their anchor to match are left out; the
   others of a bucket get a run-length Burrows-Wheeler transform with suffix
   positions sampled at the ends of its runs.  Matching statistics are streamed in text order: at a sampled position the
   match with the neighbouring suffix is measured, in between it shrinks by one byte a step (the property that makes
   run-end samples sufficient).  Positions that match ``LENGTH`` bytes or more start a covered string.
4. An anchor with more than ``HOT`` different segments (the rim of a very common passage, whose segments stay different
   by the text before or after it) is never indexed, so a bucket has no unbounded group: its windows are settled by
   counting digests at equal distances from the anchor, in groups of ``STEPS``, the finer ones at the edges of matches only.
5. The covered ranges are gathered per document and cut out.

``repeats`` measures two lengths.  It first finds the runs covered by shared strings of ``PASSAGE`` bytes, a passage of a
little over 50 words, which it counts and does not remove.  A shared string of ``LENGTH`` bytes is made of shared strings of
``PASSAGE`` bytes, so it and its partner lie inside such runs: steps 1 to 5 then look for it in the runs alone.

A window belongs to one segment only, so overlapping segments of a document never match themselves.

Edge cases: null text is empty; texts shorter than ``LENGTH`` bytes lose nothing; repeated rows are copies of each other
and lose everything they share; null keys and keys that repeat are told apart by their texts; extra columns are ignored
by ``repeats`` and kept by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stage, slices

LENGTH = 400
PASSAGE = 250           # a passage of over 50 words is at least about this long
GRAM = 64               # long enough that unrelated texts seldom share one
HOT = 64
STEPS = (20, 4, 1)       # each divides the one before
BUCKET_BYTES = 512 << 10
PIECE = 1 << 20          # bytes hashed at a time, with work arrays of about 80 times as many (below 2 ** 24, see _anchors)
SEPARATOR = 0xFF         # never part of UTF-8

_BYTES = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64((1 << 24) - 1)


def _gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes (a power of two) from each position, by doubling."""
    h, size = _BYTES[buf], 1
    while size < gram:
        mult = np.uint64(0x9E3779B97F4A7C15 + 2 * size)
        h = h[:-size] * mult + h[size:]
        h ^= h >> np.uint64(31)
        size *= 2
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _anchors(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the least hash (upper 40 bits, leftmost on ties) among ``width`` from each position."""
    n = len(h)
    key = (h & ~_LOW) | np.arange(n, dtype=np.uint64)
    pad = -n % width
    blocks = np.concatenate((key, np.full(pad, np.uint64(2**64 - 1)))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[: n - width + 1], ahead[width - 1: n]) & _LOW).astype(np.int64)


def segments(data: bytes, bounds: list[tuple[int, int]], length: int, gram: int) -> tuple:
    """Segments of the texts ``data[a:b]`` for (a, b) in bounds: arrays text, anchor, digest, start, size, at.

    ``start`` is relative to the text, ``at`` is the anchor's place in the segment.
    """
    empty = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(data) < length:
        return empty
    buf = np.frombuffer(data, np.uint8)
    h = _gram_hashes(buf, gram)
    place = _anchors(h, length - gram + 1)
    owner = np.full(len(place), -1, dtype=np.int64)
    for t, (a, b) in enumerate(bounds):
        if b - a >= length:
            owner[a: b - length + 1] = t
    change = np.flatnonzero((np.diff(place) != 0) | (np.diff(owner) != 0)) + 1
    first = np.concatenate(([0], change))
    last = np.concatenate((change, [len(place)])) - 1
    real = owner[first] >= 0
    first, last = first[real], last[real]
    if not len(first):
        return empty
    stop = last + length
    view = memoryview(data)
    digest = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), stop.tolist())),
                         dtype=np.uint64, count=len(first))
    text = owner[first]
    begin = np.array([a for a, _ in bounds], dtype=np.int64)
    return (text, h[place[first]].view(np.int64), digest.view(np.int64), first - begin[text], stop - first,
            place[first] - first)


def occurrences(parts: DataFrame, length: int, gram: int) -> DataFrame:
    """Places of the segments: v (anchor), s (segment digest), doc, k, start, size, at.

    ``parts`` has (doc, k, first, part): the bytes of a text from ``first`` on.
    """
    schema = T.StructType([T.StructField("v", T.LongType()), T.StructField("s", T.LongType()),
                           parts.schema["doc"], T.StructField("k", T.LongType()),
                           *[T.StructField(c, T.LongType()) for c in ("start", "size", "at")]])

    def emit(batch, found, offset=0):
        text, v, s, start, size, at = found
        take = pa.array(text)
        first = batch.column("first").to_numpy()
        return pa.RecordBatch.from_arrays(
            [pa.array(v), pa.array(s), batch.column("doc").take(take), batch.column("k").take(take),
             pa.array(start + first[text] + offset), pa.array(size), pa.array(at)], names=schema.names)

    def run(batches):
        for batch in slices(batches, "part", PIECE):
            texts = batch.column("part").to_pylist()
            if len(texts) == 1 and len(texts[0]) > PIECE:       # a very long text, a piece at a time
                for a in range(0, len(texts[0]) - length + 1, PIECE):
                    piece = texts[0][a: a + PIECE + length - 1]
                    yield emit(batch, segments(piece, [(0, len(piece))], length, gram), a)
                continue
            ends = np.cumsum([len(t) for t in texts]).tolist()
            bounds = list(zip([0, *ends[:-1]], ends))
            yield emit(batch, segments(b"".join(texts), bounds, length, gram))

    return parts.mapInArrow(run, schema)


class RunIndex:
    """Run-length BWT of some byte strings, with suffix positions sampled at both ends of its runs."""

    def __init__(self, parts: list[bytes], depth: int):
        text = bytes([SEPARATOR]).join(parts) + bytes([SEPARATOR])
        self.text = np.frombuffer(text, np.uint8)
        n = len(self.text)
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        self.begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        stop = np.repeat(self.begin + sizes, sizes + 1)
        self.left = stop - np.arange(n)                       # bytes until the end of the string
        padded = np.concatenate((self.text, np.zeros(8, np.uint8))).astype(np.uint64)
        words = np.zeros(n, np.uint64)
        for j in range(8):
            words = (words << np.uint64(8)) | padded[j: j + n]
        self.words = words
        self.ranks: list[tuple[int, np.ndarray]] = []
        order = np.argsort(words)
        rank = self._rank(order, words)
        size = 8
        while True:
            self.ranks.append((size, rank))
            if size >= depth or int(rank.max()) == n - 1:
                break
            ahead = np.full(n, -1, dtype=np.int64)
            ahead[: max(0, n - size)] = rank[size:]
            key = rank.astype(np.int64) * (n + 1) + ahead + 1
            order = np.argsort(key)
            rank = self._rank(order, key)
            size *= 2
        bwt = self.text[order - 1]
        # a match never extends over a string's start, so the separator never makes a run
        head = np.concatenate(([True], (bwt[1:] != bwt[:-1]) | (bwt[1:] == SEPARATOR)))
        tail = np.concatenate((head[1:], [True]))
        self.runs = int(head.sum())
        # samples: a run's first suffix with the one before it, its last suffix with the one after it
        h = np.flatnonzero(head)[1:]
        t = np.flatnonzero(tail)[:-1]
        self.samples = np.concatenate((order[h], order[t]))
        self.partners = np.concatenate((order[h - 1], order[t + 1]))

    @staticmethod
    def _rank(order: np.ndarray, key: np.ndarray) -> np.ndarray:
        sorted_key = key[order]
        rank = np.empty(len(order), dtype=np.int32)
        rank[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        return rank

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, at most to the end of their strings."""
        a0, n = a, len(self.text)
        limit = np.minimum(self.left[a], self.left[b])
        a, b = a.copy(), b.copy()
        for size, rank in reversed(self.ranks):
            while True:
                ok = (a < n) & (b < n)
                same = np.zeros(len(a), dtype=bool)
                same[ok] = rank[a[ok]] == rank[b[ok]]
                same &= a - a0 < limit
                if not same.any():
                    break
                a[same] += size
                b[same] += size
                if size != self.ranks[-1][0]:
                    break                                     # below the largest size one step is enough
        ok = (a < n) & (b < n) & (a - a0 < limit)
        differ = self.words[np.minimum(a, n - 1)] ^ self.words[np.minimum(b, n - 1)]
        tail = np.zeros(len(a), dtype=np.int64)
        for j in range(1, 8):
            tail += (differ >> np.uint64(64 - 8 * j)) == 0
        return np.minimum(a - a0 + np.where(ok, tail, 0), limit)

    def statistics(self) -> np.ndarray:
        """Matching statistics: for each position the longest string from it that occurs at another position too."""
        n = len(self.text)
        value = np.zeros(n, dtype=np.int64)
        np.maximum.at(value, self.samples, self.common(self.samples, self.partners))
        at = np.arange(n)
        return np.minimum(np.maximum(np.maximum.accumulate(value + at) - at, 0), np.maximum(self.left, 0))


def matched(parts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each string the (start, size) ranges covered by ``length``-byte strings that occur elsewhere in ``parts``."""
    if not parts:
        return []
    index = RunIndex(parts, max(map(len, parts)))
    long = index.statistics() >= length
    edge = np.diff(np.concatenate(([0], long.astype(np.int8), [0])))
    first, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out: list[list[tuple[int, int]]] = [[] for _ in parts]
    which = np.searchsorted(index.begin, first, side="right") - 1
    for p, a, b in zip(which.tolist(), first.tolist(), stop.tolist()):
        out[p].append((a - int(index.begin[p]), b - a - 1 + length))
    return out


def _windows(size: int, at: int, length: int, step: int) -> list[tuple[int, int, int]]:
    """The windows of a segment in groups of ``step``: (group, least, greatest bytes before the anchor)."""
    least = at - (size - length)
    return [(g, max(least, g * step), min(at, g * step + step - 1)) for g in range(least // step, at // step + 1)]


def _inner(data: bytes, g: int, at: int, length: int, step: int) -> bytes:
    """Bytes that all windows of a group have."""
    first = at - g * step
    return data[first: first + length - step + 1]


def _digest(data: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(data, seed) - 2**63


def _may_match(frame: pd.DataFrame, length: int) -> np.ndarray:
    """Whether a segment shares the inner bytes of some group of windows with another one of its anchor.

    Equal windows lie at the same distance from their anchor, hence in the same group, so the others match nowhere.
    """
    met: dict[tuple[int, int, int], int] = {}
    keep = np.zeros(len(frame), dtype=bool)
    for i, (v, at, data) in enumerate(zip(frame["v"].tolist(), frame["at"].tolist(), frame["data"].tolist())):
        for g, _, _ in _windows(len(data), at, length, STEPS[0]):
            other = met.setdefault((v, g, _digest(_inner(data, g, at, length, STEPS[0]), 0)), i)
            if other != i:
                keep[i] = keep[other] = True
    return keep


def _by_counts(rim: DataFrame, stage: Stage, length: int) -> DataFrame:
    """Covered ranges (doc, k, start, size) of the segments of hot anchors, settled by counting alone.

    Equal windows lie at the same distance from their anchor, so a window is covered if its digest is counted twice at
    that distance.  Not every window is counted: for each group of neighbours, the bytes that all of them have (inner)
    and the bytes that any of them has (outer).  A shared outer covers the whole group, an inner that is not shared covers
    nothing; only in between, at the edges of matches, smaller groups are counted, single windows at last.  There the
    segments of one outer are counted once, since their windows in the group are equal.
    """
    names = ["v", "s", "g", "outer", "h"]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in names])

    def batch_of(rows):
        columns = list(zip(*rows)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=names)

    def groups(step, above):
        def run(batches):
            for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
                rows = []
                for row in batch.to_pylist():
                    v, s, at, data = row["v"], row["s"], row["at"], row["data"]
                    wanted = set(row["gs"]) if above else None
                    for g, lo, hi in _windows(len(data), at, length, step):
                        if above and g * step // above not in wanted:
                            continue
                        if step > 1:
                            rows.append((v, s, g, 0, _digest(_inner(data, g, at, length, step), 2 * g)))
                        if hi - lo == step - 1:
                            rows.append((v, s, g, 1, _digest(data[at - hi: at - lo + length], 2 * g + 1)))
                yield batch_of(rows)
        return run

    rim = rim.filter("hot")
    asked, spans, above = rim.select("v", "s", "at", "data"), None, 0
    for step in STEPS:
        named = stage.write(asked.mapInArrow(groups(step, above), schema), f"windows-{step}")
        # written first, so that the join has plain shuffles on both sides and a hot window's partition can be split
        shared = stage.write(named.groupBy("v", "h").agg(F.count("*").alias("c"), F.min("s").alias("one"))
                             .filter("c > 1").drop("c"), f"shared-windows-{step}")
        met = stage.write(named.join(shared, ["v", "h"]).groupBy("v", "s", "g").agg(
            F.max("outer").alias("outer"),
            F.max((F.col("outer") == 1) & (F.col("one") == F.col("s"))).alias("stands")), f"met-windows-{step}")
        stage.drop(f"windows-{step}", f"shared-windows-{step}")
        # spans of bytes before the anchor: (least, greatest)
        covers = met.filter("outer = 1").select("v", "s", (F.col("g") * step).alias("lo"),
                                                (F.col("g") * step + step - 1).alias("hi"))
        spans = spans.union(covers) if spans else covers
        edges = met.filter("outer = 0 or stands").groupBy("v", "s").agg(F.collect_list("g").alias("gs"))
        asked, above = rim.select("v", "s", "at", "data").join(edges, ["v", "s"]), step
    spans = spans.groupBy("v", "s").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))    # LENGTH at most
    found = rim.filter("c = 1").select("v", "s", "doc", "k", "start", "at").join(spans, ["v", "s"])
    schema = T.StructType([rim.schema["doc"], *[T.StructField(c, T.LongType()) for c in ("k", "start", "size")]])

    def ranges(batches):
        for batch in batches:
            owner, start, size = [], [], []
            for i, (first, at, spans_of) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("start", "at", "spans")))):
                for a, b in merge([at - x["hi"] for x in spans_of], [x["hi"] - x["lo"] + length for x in spans_of]):
                    owner.append(i)
                    start.append(first + a)
                    size.append(b - a)
            take = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(take), batch.column("k").take(take), pa.array(start, pa.int64()),
                 pa.array(size, pa.int64())], names=schema.names)

    return found.select("doc", "k", "start", "at", "spans").mapInArrow(ranges, schema)


def covered(documents: DataFrame, stage: Stage, *, key: str = "doc_id", text: str = "text", length: int = LENGTH,
            gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Covered ranges: doc, k, start, size (several per document, may overlap)."""
    rows = documents.select(F.col(key).alias("doc"), F.xxhash64(key, text).alias("k"), F.col(text).alias("text"))
    parts = rows.filter("text is not null").select("doc", "k", F.lit(0).cast("long").alias("first"),
                                                   F.col("text").cast("binary").alias("part"))
    return _covered(rows, parts, stage, length, gram, hot)


def _covered(rows: DataFrame, parts: DataFrame, stage: Stage, length: int, gram: int, hot: int) -> DataFrame:
    """Ranges as of ``covered``, of strings inside ``parts`` (doc, k, first, part) of the texts ``rows`` (doc, k, text)."""
    places = stage.write(occurrences(parts, length, gram), "places")
    shared = (places.groupBy("v").agg(F.count("*").alias("c"), F.min("s").alias("lo"), F.max("s").alias("hi"))
              .filter("c > 1").select("v", (F.col("lo") < F.col("hi")).alias("mixed")))
    # written first, so that the join has plain shuffles on both sides and a hot anchor's partition can be split
    shared = stage.write(shared, "shared")
    met = stage.write(places.join(shared, "v"), "met")
    stage.drop("places", "shared")
    kinds = stage.write(
        met.groupBy("v", "s").agg(F.count("*").alias("c"), F.max("mixed").alias("mixed"),
                                  F.min(F.struct("k", "doc", "start", "size", "at")).alias("p")), "segments")
    whole = met.join(kinds.filter("c > 1").select("v", "s"), ["v", "s"], "left_semi").select("doc", "k", "start", "size")

    # rims: anchors with different segments, at least one of them seen once
    anchors = (kinds.filter("mixed").groupBy("v").agg(F.min("c").alias("least"), F.count("*").alias("kinds"))
               .filter("least = 1").select("v", (F.col("kinds") > hot).alias("hot")))
    wanted = kinds.join(anchors, "v").select("v", "s", "c", "hot", "p.*")
    fetched = (rows.withColumnRenamed("doc", "doc_t").join(wanted, "k").filter(F.col("doc").eqNullSafe(F.col("doc_t")))
               .select("v", "s", "c", "hot", "doc", "k", "start", "at",
                       F.expr("substring(cast(text as binary), cast(start + 1 as int), cast(size as int))")
                       .alias("data")))
    rim = stage.write(
        fetched.groupBy("v", "s").agg(*[F.first(c).alias(c) for c in ("c", "hot", "doc", "k", "start", "at", "data")]),
        "rim")

    counted = _by_counts(rim, stage, length)
    # at most ``hot`` segments an anchor
    left = rim.filter("not hot").select("v", "s", "doc", "k", "start", "at", "data", (F.col("c") == 1).alias("ask"))
    left = stage.write(left, "index")
    total = left.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    schema = T.StructType([left.schema["doc"], *[T.StructField(c, T.LongType()) for c in ("k", "start", "size")]])

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[_may_match(frame, length)].sort_values(["v", "s"])
        found = matched(frame["data"].tolist(), length)
        out = [(r.doc, r.k, r.start + a, n) for r, spans in zip(frame.itertuples(), found) if r.ask for a, n in spans]
        out = pd.DataFrame(out, columns=["doc", "k", "start", "size"])
        out["doc"] = pd.Series([None if pd.isna(d) else d for d in out["doc"]], dtype=object)
        return out

    rims = (left.withColumn("bucket", F.pmod(F.xxhash64("v"), F.lit(buckets)))
            .groupBy("bucket").applyInPandas(search, schema))
    return whole.union(counted).union(rims)


def merge(starts: list[int], sizes: list[int]) -> list[tuple[int, int]]:
    """Maximal runs (start, stop) of the union of ranges; ranges that touch are one run."""
    out: list[list[int]] = []
    for a, n in sorted(zip(starts, sizes)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n])
    return [(a, b) for a, b in out]


def cut(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The bytes outside the runs."""
    edges = [0, *[e for run in runs for e in run], len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _gathered(documents: DataFrame, ranges: DataFrame, key: str, text: str) -> DataFrame:
    """Each row as ``record`` with its ``ranges_of`` (null where nothing is covered)."""
    per_doc = ranges.groupBy("doc", "k").agg(F.collect_list(F.struct("start", "size")).alias("ranges_of"))
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("record"),
                              F.col(key).alias("record_key"), F.xxhash64(key, text).alias("record_k"))
    return (packed.join(per_doc, (F.col("record_k") == F.col("k")) & F.col("record_key").eqNullSafe(F.col("doc")),
                        "left").select("record", "ranges_of"))


def _runs(ranges_of: list | None) -> list[tuple[int, int]]:
    """Maximal runs (start, stop) of gathered ranges."""
    return merge([r["start"] for r in ranges_of], [r["size"] for r in ranges_of]) if ranges_of else []


def _passages(documents: DataFrame, key: str, text: str, length: int, passage: int) -> DataFrame:
    """One row per row of ``documents``: doc, n (bytes), n_passage_bytes and n_passages; with runs of ``length`` bytes or
    more these (start, size) and the text's bytes, else the digest ``whole`` of the text.
    """
    stage = Stage(documents.sparkSession, "passages")
    ranges = stage.write(covered(documents, stage, key=key, text=text, length=passage), "ranges")
    stage.drop("met", "segments", "rim", "index")
    source = documents.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    body = F.coalesce("record.text", F.lit(""))
    gathered = _gathered(source, ranges, "doc", "text").select(
        "record.doc", "ranges_of", F.octet_length(body).cast("long").alias("n"),
        F.when(F.col("ranges_of").isNull(), F.sha2(body, 256)).alias("whole"),
        F.when(F.col("ranges_of").isNotNull(), F.col("record.text")).alias("text"))
    span = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "size")])
    schema = T.StructType([source.schema["doc"],
                           *[T.StructField(c, T.LongType()) for c in ("n", "n_passage_bytes", "n_passages")],
                           T.StructField("whole", T.StringType()), T.StructField("text", T.BinaryType()),
                           T.StructField("runs", T.ArrayType(span))])
    spans = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))

    def run(batches):
        for batch in batches:
            size, count, sha, texts, long = [], [], [], [], []
            for t, ranges_of, whole in zip(batch.column("text").to_pylist(), batch.column("ranges_of").to_pylist(),
                                           batch.column("whole").to_pylist()):
                runs = _runs(ranges_of)
                size.append(sum(b - a for a, b in runs))
                count.append(len(runs))
                long.append([{"start": a, "size": b - a} for a, b in runs if b - a >= length] or None)
                data = None if t is None else t.encode("utf-8")
                texts.append(data if long[-1] else None)
                sha.append(None if long[-1] else whole or hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("n"), pa.array(size, pa.int64()), pa.array(count, pa.int64()),
                 pa.array(sha, pa.string()), pa.array(texts, pa.binary()), pa.array(long, spans)], names=schema.names)

    found = stage.write(gathered.mapInArrow(run, schema), "passages")
    stage.drop("ranges")
    return found


def repeats(documents: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH,
            passage: int = PASSAGE) -> DataFrame:
    """One row per row of ``documents``: key, n_bytes, n_removed, n_spans, kept_sha256, n_passage_bytes, n_passages.

    The last two count the bytes and maximal runs covered by a string of ``passage`` bytes (``length`` at most) that also
    starts anywhere else; they include what is removed.
    """
    if not GRAM <= passage <= length:
        raise ValueError(f"passage must be {GRAM} to length ({length}) bytes, not {passage}")
    found = _passages(documents, key, text, length, passage)
    stage = Stage(documents.sparkSession, "repeats")
    rows = found.filter("text is not null").select("doc", F.xxhash64("doc", "text").alias("k"), "text", "runs")
    parts = rows.select("doc", "k", F.explode(F.expr(
        "transform(runs, r -> struct(r.start as first, substring(text, cast(r.start + 1 as int), cast(r.size as int)) as part))"
    )).alias("p")).select("doc", "k", "p.first", "p.part")
    ranges = stage.write(_covered(rows.drop("runs"), parts, stage, length, GRAM, HOT), "ranges")
    stage.drop("met", "segments", "rim", "index")
    gathered = _gathered(found.drop("runs"), ranges, "doc", "text").select("record.*", "ranges_of")
    schema = T.StructType([T.StructField(key, documents.schema[key].dataType),
                           *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")],
                           T.StructField("kept_sha256", T.StringType()),
                           *[T.StructField(c, T.LongType()) for c in ("n_passage_bytes", "n_passages")]])

    def run(batches):
        for batch in batches:
            removed, spans, sha = [], [], []
            for t, ranges_of, whole in zip(batch.column("text").to_pylist(), batch.column("ranges_of").to_pylist(),
                                           batch.column("whole").to_pylist()):
                runs = _runs(ranges_of)
                removed.append(sum(b - a for a, b in runs))
                spans.append(len(runs))
                sha.append(whole or hashlib.sha256(cut(t, runs)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("n"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                 pa.array(sha, pa.string()), batch.column("n_passage_bytes"), batch.column("n_passages")],
                names=schema.names)

    return gathered.mapInArrow(run, schema)


def whole_characters(text: str, runs: list[tuple[int, int]]) -> str:
    """The text without the characters whose bytes are all covered; a character cut by a run's edge stays whole."""
    data, inner = text.encode("utf-8"), []
    for a, b in runs:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            inner.append((a, b))
    return cut(data, inner).decode("utf-8")


def remove_repeats(documents: DataFrame, *, key: str = "doc_id", text: str = "text",
                   length: int = LENGTH) -> DataFrame:
    """``documents`` with the covered bytes cut from ``text`` (at whole characters), all columns kept."""
    stage = Stage(documents.sparkSession, "repeats")
    ranges = stage.write(covered(documents, stage, key=key, text=text, length=length), "ranges")
    gathered = _gathered(documents, ranges, key, text)
    names = documents.columns
    cuts = F.col("ranges_of").alias("ranges_of_record")

    def run(batches):
        for batch in batches:
            texts = []
            for t, ranges_of in zip(batch.column(text).to_pylist(), batch.column("ranges_of_record").to_pylist()):
                if ranges_of and t is not None:
                    t = whole_characters(t, _runs(ranges_of))
                texts.append(t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if n == text else batch.column(n) for n in names], names=names)

    return gathered.select("record.*", cuts).mapInArrow(run, documents.schema)
