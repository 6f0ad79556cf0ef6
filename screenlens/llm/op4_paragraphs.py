"""Substring dedup by paragraph MinHash banding.

Two kinds of units cover the whole text:

* paragraphs: lines of at least ``MIN_WORDS`` words; shorter lines are joined with the following short ones until they
  have as many.  Equal paragraphs (after lower-casing A-Z and joining words with single spaces) are one class from the
  start.  Each class has a MinHash signature over its five-word shingles, cut into bands of ``rows`` coordinates;
  ``tune`` chooses the number of bands so that a pair at the similarity threshold collides in one band at least with
  probability ``RECALL``.  Colliding paragraphs are compared with one centre per list first; confirmed links (exact
  Jaccard on the shingle sets) give components; lists that still span components are settled by the exact
  rarest-shingle join of the MinHash operator.
* windows: passages inside longer, otherwise different paragraphs or across lines.  The word sequence is sampled where a
  three-word hash is the least of ``SAMPLE`` successive ones, so equal passages are sampled at the same words wherever
  they stand, and the ``WINDOW`` words from there are a window.  Any two places that share ``WINDOW + SAMPLE - 1`` words
  (51) share a window.  Windows are compared for similarity 1: a window's class is the 128-bit digest of its words,
  so no pairs are formed, and a changed passage is met by its windows between the changes.

Every occurrence of a component but the first is marked for removal.

Edge cases: null and empty texts and those under ``MIN_WORDS`` words have no units, under ``WINDOW`` words no window; repeated rows and keys are further
occurrences, windows that overlap in one text too; ties in "first" go to the least (key, word position); rows without a
key are marked only if the component has an occurrence with a key; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stage, components, lower_bytes, slices, texts_of
from .op3_minhash import _M, _confirm, _Hasher, mix, residual_links, star_pairs, word_hashes

MIN_WORDS = 25
SHINGLE = 5
SHARE = 80
ROWS = 4
RECALL = 0.9995
WINDOW = 32
SAMPLE = 20             # starts of which one is a window's: passages of WINDOW + SAMPLE - 1 = 51 words share one


def tune(rows: int = ROWS, share: int = SHARE, recall: float = RECALL) -> int:
    """Least number of bands with which a pair at the threshold collides with probability ``recall``."""
    bands = 1
    while (1 - (share / 100) ** rows) ** bands > 1 - recall:
        bands += 1
    return bands


def paragraphs(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int, str]]:
    """(first line, words, normalised text) of the lines with enough words and of short lines joined."""
    return [(number, n, unit.decode("utf-8", "surrogatepass")) for number, n, unit in _units(text, min_words)]


def _units(text: str, min_words: int) -> list[tuple[int, int, bytes]]:
    """The same with the normalised text as UTF-8 bytes."""
    out = []
    start, short = 0, []
    for number, line in enumerate(lower_bytes(text).split(b"\n")):
        words = line.split()
        if len(words) >= min_words:
            short = []
            out.append((number, len(words), b" ".join(words)))
            continue
        start = start if short else number
        short += words
        if len(short) >= min_words:
            out.append((start, len(short), b" ".join(short)))
            short = []
    return out


def _polynomial(words: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """A hash of every ``size`` successive words."""
    n = len(words) - size + 1
    h = words[:n].copy()
    for k in range(1, size):
        h = h * base + words[k: n + k]
    return mix(h)


def window_starts(words: np.ndarray, window: int = WINDOW, sample: int = SAMPLE) -> np.ndarray:
    """Sorted word positions at which windows begin; ``words`` are the word hashes of one text.

    Of each ``sample`` successive starts the one with the least three-word hash (the first of equals) is taken; a text
    with fewer starts has one.
    """
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    order = _polynomial(words, 3, _M)[:n]
    if n <= sample:
        return np.array([int(order.argmin())])
    picks = []
    for at in range(0, n - sample + 1, 1 << 14):
        stop = min(n - sample + 1, at + (1 << 14))
        least = np.lib.stride_tricks.sliding_window_view(order[at: stop + sample - 1], sample).argmin(1)
        picks.append(np.unique(least + np.arange(at, stop)))
    return np.unique(np.concatenate(picks))


def signatures(units: list[bytes], n_words: list[int], shingle: int, hasher: _Hasher) -> np.ndarray:
    """MinHash signatures of normalised paragraphs of ``shingle`` words or more, all in one sweep.

    The word hashes of all paragraphs lie in one array; windows that cross from one into the next are left out.
    """
    hashes = word_hashes(b"\n".join(units))
    sizes = np.array(n_words, dtype=np.int64)
    windows = sizes - shingle + 1
    flat = hashes[: len(hashes) - shingle + 1].copy()
    for k in range(1, shingle):
        flat = flat * _M + hashes[k: len(hashes) - shingle + 1 + k]
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    starts = np.concatenate(([0], np.cumsum(windows)[:-1]))
    inside = np.arange(windows.sum()) + np.repeat(first - starts, windows)
    return hasher.of_flat(mix(flat[inside] + np.uint64(shingle)), starts)


_BASES = (_M, np.uint64(0xD6E8FEB86659FD93))    # of the two halves of a window's digest


def _rep(unit: bytes) -> int:
    return xxhash.xxh3_64_intdigest(unit) - 2**63


def occurrences(documents: DataFrame, key: str, text: str, min_words: int, shingle: int, n_bands: int,
                rows: int) -> DataFrame:
    """doc, paragraph, n_words, rep (64-bit digest of the normalised paragraph), keys (its 64-bit band keys, binary)."""
    if min_words < shingle:
        raise ValueError("paragraphs must have a shingle's words at least")
    schema = T.StructType([T.StructField("doc", documents.schema[key].dataType),
                           *[T.StructField(c, T.LongType()) for c in ("paragraph", "n_words", "rep")],
                           T.StructField("keys", T.BinaryType())])

    def run(batches):
        hasher = _Hasher(n_bands * rows)
        for batch in slices(batches, "text"):
            found = [_units(t, min_words) for t in texts_of(batch)]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            flat = [p for f in found for p in f]
            if not flat:
                continue
            reps = [_rep(p[2]) for p in flat]
            one = {r: (p[2], p[1]) for r, p in zip(reps, flat)}          # equal paragraphs are hashed once
            sig = signatures([u for u, _ in one.values()], [n for _, n in one.values()], shingle, hasher)
            sig = sig.astype(np.uint64).reshape(len(one), n_bands, rows)
            keys = np.repeat(np.arange(1, n_bands + 1, dtype=np.uint64)[None], len(one), 0)
            for r in range(rows):
                keys = mix(keys * _M + sig[:, :, r])
            packed = dict(zip(one, (k.tobytes() for k in keys)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(at), pa.array([p[0] for p in flat], pa.int64()),
                 pa.array([p[1] for p in flat], pa.int64()), pa.array(reps, pa.int64()),
                 pa.array([packed[r] for r in reps], pa.binary())], names=schema.names)

    return documents.select(F.col(key).alias("doc"), F.col(text).alias("text")).mapInArrow(run, schema)


def bands(places: DataFrame) -> DataFrame:
    """Each distinct paragraph under its band keys: rep, posting."""
    schema = T.StructType([T.StructField("rep", T.LongType()), T.StructField("posting", T.LongType())])

    def run(batches):
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.int64)
            at = pa.array(np.repeat(np.arange(batch.num_rows), len(keys) // max(1, batch.num_rows)))
            yield pa.RecordBatch.from_arrays([batch.column("rep").take(at), pa.array(keys)], names=schema.names)

    return places.groupBy("rep").agg(F.first("keys").alias("keys")).mapInArrow(run, schema)


def texts_of_reps(documents: DataFrame, text: str, wanted: DataFrame, min_words: int) -> DataFrame:
    """rep, text of the wanted paragraphs, one row each; ``wanted`` has (rep)."""
    schema = T.StructType([T.StructField("rep", T.LongType()), T.StructField("text", T.StringType())])

    def run(batches):
        for batch in slices(batches, "text"):
            one = {_rep(u): u for t in texts_of(batch) for _, _, u in _units(t, min_words)}
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(one), pa.int64()),
                 pa.array([u.decode("utf-8", "surrogatepass") for u in one.values()], pa.string())], names=schema.names)

    every = documents.select(F.col(text).alias("text")).mapInArrow(run, schema)
    return every.join(wanted, "rep", "left_semi").groupBy("rep").agg(F.first("text").alias("text"))


def windows(documents: DataFrame, key: str, text: str, window: int, sample: int) -> DataFrame:
    """doc, paragraph (line of the first word), first_word, and the window's digest (d1, d2); one scan."""
    if window < 3:
        raise ValueError("windows must have three words at least")
    schema = T.StructType([T.StructField("doc", documents.schema[key].dataType),
                           *[T.StructField(c, T.LongType()) for c in ("paragraph", "first_word", "d1", "d2")]])

    def run(batches):
        for batch in slices(batches, "text"):
            found = []
            for t in texts_of(batch):
                data = lower_bytes(t)
                words = word_hashes(data)
                starts = window_starts(words, window, sample)
                ends = np.cumsum([len(line.split()) for line in data.split(b"\n")])
                inside = starts[:, None] + np.arange(window)
                digest = [np.zeros(len(starts), np.uint64) for _ in range(2)]
                for k in range(window):
                    for d, base in zip(digest, _BASES):
                        d *= base
                        d += words[inside[:, k]]
                found.append((np.searchsorted(ends, starts, "right"), starts, *[mix(d).view(np.int64) for d in digest]))
            if not found:
                continue
            at = np.repeat(np.arange(len(found)), [len(f[1]) for f in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(pa.array(at)),
                 *[pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found)]], names=schema.names)

    return documents.select(F.col(key).alias("doc"), F.col(text).alias("text")).mapInArrow(run, schema)


def repeated_windows(documents: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                     sample: int = SAMPLE) -> DataFrame:
    """Occurrences of windows that repeat: key, paragraph, first_word, n_words, component_id, kept.

    Digests are counted with a map-side combine before they meet their places, whose join AQE can split by place.
    """
    stage = Stage(documents.sparkSession, "windows")
    places = stage.write(windows(documents, key, text, window, sample), "places")
    first = F.min(F.when(F.col("doc").isNotNull(), F.struct("doc", "first_word")))
    again = places.groupBy("d1", "d2").agg(F.count("*").alias("n"), first.alias("first")).filter("n > 1")
    found = places.join(stage.write(again, "repeated"), ["d1", "d2"])
    kept = (F.col("doc").eqNullSafe(F.col("first.doc")) & F.col("first_word").eqNullSafe(F.col("first.first_word"))
            ) | F.col("first").isNull()
    return found.select(F.col("doc").alias(key), "paragraph", "first_word", F.lit(window).cast("long").alias("n_words"),
                        F.col("d1").alias("component_id"), kept.alias("kept"))


def repeated_passages(documents: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                      sample: int = SAMPLE, **options) -> DataFrame:
    """Occurrences of repeated paragraphs and of repeated windows: key, unit (``paragraph`` or ``window``), paragraph,
    first_word (of a window; null for a paragraph, which begins its line), n_words, component_id, kept."""
    near = repeated_paragraphs(documents, key=key, text=text, **options)
    near = near.withColumns({"unit": F.lit("paragraph"), "first_word": F.lit(None).cast("long")})
    equal = repeated_windows(documents, key=key, text=text, window=window, sample=sample)
    order = [key, "unit", "paragraph", "first_word", "n_words", "component_id", "kept"]
    return near.select(order).union(equal.withColumn("unit", F.lit("window")).select(order))


def repeated_paragraphs(documents: DataFrame, *, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
                        shingle: int = SHINGLE, share: int = SHARE, rows: int = ROWS,
                        recall: float = RECALL) -> DataFrame:
    """Occurrences of paragraphs that repeat, exactly or nearly: key, paragraph, n_words, component_id, kept.

    Paragraphs without a partner are not returned; ``component_id`` is the least digest in the component.
    """
    stage = Stage(documents.sparkSession, "paragraphs")
    n_bands = tune(rows, share, recall)
    places = stage.write(occurrences(documents, key, text, min_words, shingle, n_bands, rows), "places")

    # band keys counted per distinct paragraph; lists of one paragraph are skipped
    every = stage.write(bands(places), "bands")
    shared = stage.write(every.groupBy("posting").agg(F.count("*").alias("freq")).filter("freq > 1"), "frequent")
    met = stage.write(every.join(shared, "posting"), "met")
    prefix = stage.write(met.join(met.groupBy("rep").agg(F.sum("freq").alias("weight")), "rep")
                         .select("rep", "posting", "weight"), "postings")
    stage.drop("bands", "met", "frequent")
    texts = texts_of_reps(documents, text, prefix.select("rep").distinct(), min_words)
    texts = stage.write(texts.withColumn("set_id", F.col("rep").cast("string").cast("binary")), "texts")

    links = stage.write(_confirm(star_pairs(prefix, stage), texts, shingle, share), "star")
    comps = components(links, stage, "star-components")
    more = residual_links(prefix, comps, texts, stage, shingle, share)
    final = components(links.union(more).distinct(), stage, "components")

    labelled = (places.join(final.withColumnRenamed("node", "rep"), "rep", "left")
                .select("doc", "paragraph", "n_words", F.coalesce("component", "rep").alias("component_id")))
    labelled = stage.write(labelled, "labelled")
    groups = labelled.groupBy("component_id").agg(
        F.count("*").alias("n"), F.min(F.when(F.col("doc").isNotNull(), F.struct("doc", "paragraph"))).alias("first"))
    out = labelled.join(groups.filter("n > 1"), "component_id")
    kept = (F.col("doc").eqNullSafe(F.col("first.doc")) & F.col("paragraph").eqNullSafe(F.col("first.paragraph"))
            ) | F.col("first").isNull()
    return out.select(F.col("doc").alias(key), "paragraph", "n_words", "component_id", kept.alias("kept"))
