"""Byte-level BPE encoding and decoding by overlapping chunks.

Texts are cut into overlapping chunks, each chunk is pre-tokenised on its own (a Spark row each, spread over the
cluster), neighbouring chunks are stitched at the first place where both have a pre-token boundary, and only then are
the pieces between boundaries encoded.  Decoding concatenates the raw bytes of the ids.

Why a common boundary is enough: the pattern never looks behind, so from a true boundary on, the pre-tokens depend only
on the text that follows.  Near a chunk's end the pattern may lack the text it looks at, so pre-tokens that start within
``LOOKAHEAD`` characters of the end, or touch it, are not trusted.  If an overlap holds no common boundary (a word longer
than the overlap, say), the unsettled range is scanned again together with the next chunks.

Edge cases: null or empty text encodes to no ids and decodes to no bytes; rows are independent, so repeated or null keys
and repeated rows each give their own row; a text of one chunk never leaves its task; any other columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, texts_of

CHUNK_CHARS = 65_536
OVERLAP_CHARS = 1_024
LOOKAHEAD = 3       # a pre-token's kind is settled by its first three characters
CACHE_PIECES = 200_000

_CODECS: dict[tuple, "Codec"] = {}


class Codec:
    """Ranks and pattern of one vocabulary: pre-tokenise, encode a piece, decode ids.  One per Python worker."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self._bpe = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._pieces: dict[str, bytes] = {}
        self._tokens = {rank: token for token, rank in ranks.items()}

    @classmethod
    def get(cls, path: str, pattern: str) -> "Codec":
        key = (path, pattern)
        if key not in _CODECS:
            _CODECS[key] = cls(path, pattern)
        return _CODECS[key]

    def piece(self, piece: str) -> bytes:
        found = self._pieces.get(piece)
        if found is None:
            if len(self._pieces) >= CACHE_PIECES:
                self._pieces.clear()
            found = np.array(self._bpe._encode_single_piece(piece), dtype="<u4").tobytes()
            if len(piece) < 64:
                self._pieces[piece] = found
        return found

    def encode_pieces(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.piece, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self._tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def ends(self, text: str, final: bool) -> np.ndarray:
        """Ends of the pre-tokens of ``text``; unless it is final, only those that more text cannot change."""
        ends = np.fromiter((m.end() for m in self.pattern.finditer(text)), dtype=np.int64)
        if final or not len(ends):
            return ends
        starts = np.concatenate(([0], ends[:-1]))
        unsure = np.flatnonzero((starts + LOOKAHEAD > len(text)) | (ends >= len(text)))
        return ends[: unsure[0]] if len(unsure) else ends


class _Range:
    """Consecutive chunks of one text, addressed by character positions of the whole text."""

    def __init__(self, starts: list[int], texts: list[str]):
        self.starts, self.texts = starts, texts

    def text(self, a: int, b: int) -> str:
        k = max(0, int(np.searchsorted(self.starts, a, side="right")) - 1)
        out = []
        while a < b:
            stop = self.starts[k + 1] if k + 1 < len(self.starts) else self.starts[k] + len(self.texts[k])
            stop = min(b, stop)
            out.append(self.texts[k][a - self.starts[k]: stop - self.starts[k]])
            a, k = stop, k + 1
        return "".join(out)


def stitch(codec: Codec, starts: list[int], texts: list[str], ends: list[np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """Segments (start, absolute ends of its pre-tokens) that cover the text, from per-chunk ends (relative)."""
    whole, last = _Range(starts, texts), len(starts) - 1
    total = starts[-1] + len(texts[-1])
    segments: list[tuple[int, np.ndarray]] = []
    begin, true = 0, ends[0]
    scanned = 0                                   # length of the last range that gave no common boundary
    for k in range(1, last + 1):
        right = np.concatenate(([0], ends[k])) + starts[k]
        common = np.intersect1d(true[np.searchsorted(true, starts[k]):], right, assume_unique=True)
        if len(common):
            cut = int(common[0])
            segments.append((begin, true[: np.searchsorted(true, cut, side="right")]))
            begin, true, scanned = cut, right[np.searchsorted(right, cut, side="right"):], 0
            continue
        sure = int(true[-1]) if len(true) else begin
        stop = starts[k] + len(texts[k])
        if k == last or stop - sure >= 2 * scanned:
            more = codec.ends(whole.text(sure, stop), final=stop == total) + sure
            true, scanned = np.concatenate((true, more)), stop - sure
    segments.append((begin, true))
    return [s for s in segments if len(s[1])]


def _pack(ends: np.ndarray) -> bytes:
    """Ends as 32-bit lengths: mostly zero bytes, which the shuffle's codec squeezes."""
    return np.diff(ends, prepend=0).astype(np.int32).tobytes()


def _unpack(lengths: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(lengths, np.int32), dtype=np.int64)


def _pieces(text: str, ends: np.ndarray) -> list[str]:
    cuts = ends.tolist()
    return [text[a:b] for a, b in zip([0, *cuts[:-1]], cuts)]


def _key(frame: pd.DataFrame):
    """The group's key; pandas shows a null as NaN."""
    value = frame["k"].iloc[0]
    return None if pd.isna(value) else value


def encode(df: DataFrame, path: str, pattern: str, *, key: str = "doc_id", text: str = "text",
           chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """One row per row of ``df``: key, ids (little-endian unsigned 32-bit integers as binary), n_tokens, n_chunks."""
    key_type = df.schema[key].dataType
    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                     F.monotonically_increasing_id().alias("row"))

    def field(name, kind):
        return T.StructField(name, kind)

    out = T.StructType([field("k", key_type), field("n_tokens", T.LongType()), field("n_chunks", T.LongType()),
                        field("ids", T.BinaryType())])

    def one_chunk(batches):
        codec = Codec.get(path, pattern)
        for batch in slices(batches, "text"):
            ids = [codec.encode_pieces(codec.pattern.findall(t)) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), pa.array([len(i) // 4 for i in ids], pa.int64()),
                 pa.array([1] * len(ids), pa.int64()), pa.array(ids, pa.binary())],
                names=["k", "n_tokens", "n_chunks", "ids"])

    chunk_schema = T.StructType([field("k", key_type), field("row", T.LongType()), field("start", T.LongType()),
                                 field("final", T.BooleanType()), field("text", T.StringType())])

    def split(batches):
        for batch in batches:
            for k, t, row in zip(batch.column("k"), texts_of(batch), batch.column("row").to_pylist()):
                starts = list(range(0, len(t), chunk_chars))
                for s0 in range(0, len(starts), 64):      # bounded output batches for very long texts
                    part = starts[s0: s0 + 64]
                    stops = [min(len(t), s + chunk_chars + overlap_chars) for s in part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k.as_py()] * len(part), batch.schema.field("k").type),
                         pa.array([row] * len(part), pa.int64()), pa.array(part, pa.int64()),
                         pa.array([e == len(t) for e in stops]), pa.array([t[s:e] for s, e in zip(part, stops)])],
                        names=["k", "row", "start", "final", "text"])

    scanned_schema = T.StructType([*chunk_schema, field("ends", T.BinaryType())])

    def scan(batches):
        codec = Codec.get(path, pattern)
        for batch in batches:
            ends = [_pack(codec.ends(t, f)) for t, f in zip(texts_of(batch), batch.column("final").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.binary())],
                                             names=[*batch.schema.names, "ends"])

    def join_chunks(frame: pd.DataFrame) -> pd.DataFrame:
        codec = Codec.get(path, pattern)
        frame = frame.sort_values("start")
        # a chunk that already reaches the end makes the ones after it superfluous
        n = int(np.argmax(frame["final"].to_numpy())) + 1
        starts, texts = frame["start"].tolist()[:n], frame["text"].tolist()[:n]
        segments = stitch(codec, starts, texts, [_unpack(e) for e in frame["ends"][:n]])
        whole = _Range(starts, texts)
        return pd.DataFrame({"k": [_key(frame)] * len(segments), "row": frame["row"].iloc[0],
                             "start": [s for s, _ in segments], "n_chunks": n,
                             "text": [whole.text(s, int(e[-1])) for s, e in segments],
                             "ends": [_pack(e - s) for s, e in segments]}).astype({"k": object})

    segment_schema = T.StructType([field("k", key_type), field("row", T.LongType()), field("start", T.LongType()),
                                   field("n_chunks", T.LongType()), field("text", T.StringType()),
                                   field("ends", T.BinaryType())])
    coded_schema = T.StructType([*[f for f in segment_schema if f.name not in ("text", "ends")],
                                 field("ids", T.BinaryType())])

    def encode_segments(batches):
        codec = Codec.get(path, pattern)
        for batch in batches:
            ids = [codec.encode_pieces(_pieces(t, _unpack(e)))
                   for t, e in zip(texts_of(batch), batch.column("ends").to_pylist())]
            kept = [batch.column(n) for n in ("k", "row", "start", "n_chunks")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(ids, pa.binary())],
                                             names=["k", "row", "start", "n_chunks", "ids"])

    def concatenate(frame: pd.DataFrame) -> pd.DataFrame:
        ids = b"".join(frame.sort_values("start")["ids"])
        return pd.DataFrame({"k": [_key(frame)], "n_tokens": [len(ids) // 4],
                             "n_chunks": [int(frame["n_chunks"].iloc[0])], "ids": [ids]}).astype({"k": object})

    whole = rows.filter(F.length("text") <= chunk_chars).select("k", "text").mapInArrow(one_chunk, out)
    chunks = rows.filter(F.length("text") > chunk_chars).mapInArrow(split, chunk_schema)
    segments = (chunks.repartition("row", "start").mapInArrow(scan, scanned_schema)
                .groupBy("row").applyInPandas(join_chunks, segment_schema))
    coded = segments.repartition("row", "start").mapInArrow(encode_segments, coded_schema)
    return whole.unionByName(coded.groupBy("row").applyInPandas(concatenate, out)).withColumnRenamed("k", key)


def decode(df: DataFrame, path: str, pattern: str, *, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add ``into``: the concatenated raw bytes of the ids (binary)."""
    schema = T.StructType([*[f for f in df.schema if f.name != into], T.StructField(into, T.BinaryType())])

    def run(batches):
        codec = Codec.get(path, pattern)
        for batch in slices(batches, ids):
            raw = [codec.decode(i or b"") for i in batch.column(ids).to_pylist()]
            names = [n for n in batch.schema.names if n != into]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(raw, pa.binary())],
                                             names=[*names, into])

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, path: str, pattern: str, **options) -> DataFrame:
    """Encode, decode and digest: key, n_tokens, ids_sha256, decoded_sha256, n_chunks."""
    coded = decode(encode(df, path, pattern, **options), path, pattern)
    return coded.select(options.get("key", "doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"), "n_chunks")
