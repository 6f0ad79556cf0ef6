"""Benchmark decontamination by pigeonhole edit matching.

An item counts as leaked into a document if some stretch of the document is within ``budget(item)`` edits of the item,
both normalised to lower-case word characters with single spaces.  The item is split into budget + 1 pieces: whatever
the edits, one piece survives unchanged, so exact piece hits (an Aho-Corasick automaton over all pieces) give every
candidate place.  Around each place, Myers' bit-parallel recurrence computes the least edit distance of the item to any
stretch, and places within the budget are kept.

The items are the stated query set: they are read in blocks of at most ``BLOCK_CHARS`` characters, one scan of the
documents per block, so what is broadcast has a fixed bound whatever the size of the benchmark.  Documents are never
shuffled: every task runs its texts through the automaton, and hits leave it only after verification.

Every item with a letter or digit is matched.  One that is too short for edits (a budget of 0) and has fewer than
``MIN_WORDS`` words must stand in the text exactly, from word boundary to word boundary; scripts written without spaces
have one beside each character.

Edge cases: null items and items without a letter or digit match nothing; null or empty texts contain nothing; repeated
rows each report their own hits; items with equal text are matched once and reported under each id; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_identity, texts_of, without

EDIT_SHARE = 0.06        # edits allowed per character of the normalised item
MIN_WORDS = 8
MIN_PIECE = 12           # shortest piece; the budget of a short item is lowered to keep pieces at least this long
BLOCK_CHARS = 8_000_000  # characters of items per broadcast block

_NOT_WORD = re.compile(r"[\W_]+")
#: Thai, Lao, Tibetan, Burmese, Khmer, kana, Chinese characters
_UNSPACED = re.compile("[\u0e00-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
                       "\U00020000-\U0003ffff]")
_AUTOMATA: dict[str, tuple] = {}


def normalise(text: str) -> str:
    """Lower case, runs of anything but letters and digits to one space."""
    return _NOT_WORD.sub(" ", text.lower()).strip()


def budget(item: str, share: float = EDIT_SHARE) -> int:
    """Edits allowed for a normalised item."""
    return max(0, min(int(len(item) * share), len(item) // MIN_PIECE - 1))


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """The item cut into edits + 1 pieces of about equal length: (offset, piece)."""
    cuts = [round(i * len(item) / (edits + 1)) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def boundary(text: str, at: int) -> bool:
    """Whether a word may begin or end at a place of a normalised text."""
    beside = text[max(0, at - 1): at + 1]
    return at in (0, len(text)) or " " in beside or bool(_UNSPACED.search(beside))


def masks(pattern: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, c in enumerate(pattern):
        found[c] = found.get(c, 0) | 1 << i
    return found


def myers(pattern_masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any stretch of ``text`` and the end of the first such stretch."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, distance = full, 0, m
    best, at = m, 0
    for j, c in enumerate(text, 1):
        eq = pattern_masks.get(c, 0)
        x = eq | down
        diagonal = (((eq & up) + up) ^ up) | eq
        plus = down | (full & ~(diagonal | up))
        minus = up & diagonal
        if plus & high:
            distance += 1
        elif minus & high:
            distance -= 1
        plus <<= 1                      # a match may start anywhere: no cost enters from the left
        minus <<= 1
        up = full & (minus | ~(x | plus))
        down = full & plus & x
        if distance < best:
            best, at = distance, j
    return best, at


def automaton(items: dict[str, list[int]], share: float, min_words: int = MIN_WORDS) -> tuple:
    """Automaton over the pieces of normalised items: piece -> [(item number, offset)]; items as (text, budget, masks,
    ids, whether only whole words match)."""
    table, found = [], {}
    for text in sorted(items):
        k = budget(text, share)
        table.append((text, k, masks(text), items[text], not k and len(text.split()) < min_words))
        for offset, piece in pieces(text, k):
            found.setdefault(piece, []).append((len(table) - 1, offset))
    machine = ahocorasick.Automaton()
    for piece, places in found.items():
        machine.add_word(piece, (len(piece), places))
    if found:
        machine.make_automaton()
    return machine, table


def matches(text: str, machine, table) -> list[tuple[int, int, int]]:
    """(item number, least distance, places) of the items found in a normalised text, given their piece hits."""
    if not table or not text:
        return []
    spans: dict[int, list[list[int]]] = {}
    for end, (length, places) in machine.iter(text):
        for number, offset in places:
            item, k = table[number][0], table[number][1]
            begin = end + 1 - length - offset           # where the item would start without edits
            if table[number][4] and not (boundary(text, begin) and boundary(text, end + 1)):
                continue
            a, b = max(0, begin - k), min(len(text), begin + len(item) + k)
            runs = spans.setdefault(number, [])
            if runs and a <= runs[-1][1] and runs[-1][0] <= b:
                runs[-1] = [min(a, runs[-1][0]), max(b, runs[-1][1])]
            else:
                runs.append([a, b])
    out = []
    for number, runs in spans.items():
        item, k, pattern = table[number][:3]
        best, places = len(item) + 1, 0
        for a, b in runs:
            if b - a < len(item) - k:
                continue
            stretch = text[a:b]
            d = 0 if item in stretch else myers(pattern, len(item), stretch)[0]
            if d <= k:
                best, places = min(best, d), places + 1
        if places:
            out.append((number, best, places))
    return out


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text", share: float = EDIT_SHARE,
                  min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per (row of documents, item found in it): key, item, distance, places.

    ``places`` counts separate stretches within the budget, ``distance`` is the least of theirs.
    """
    spark = documents.sparkSession
    kind, item_kind = documents.schema[key].dataType, benchmark.schema[item].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField(item, item_kind),
                           T.StructField("distance", T.LongType()), T.StructField("places", T.LongType())])
    source = documents.select(F.col(key).alias("k"), F.col(text).alias("text"))
    given = benchmark.select(F.col(item).alias("i"), F.col(item_text).alias("t")).filter("t is not null")
    total = given.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-total * 2 // block_chars))
    given = given.withColumn("block", F.pmod(F.xxhash64("t"), F.lit(blocks)).cast("int"))
    out = None
    for block in range(blocks):                        # the stated query set, a bounded block at a time
        items: dict[str, list] = {}
        for row in given.filter(F.col("block") == block).select("i", "t").toLocalIterator():
            clean = normalise(row["t"])
            if clean:
                items.setdefault(clean, []).append(row["i"])
        if not items and out is not None:
            continue
        shared = spark.sparkContext.broadcast(items)

        name = hashlib.sha256(repr((sorted(items.items()), share, min_words)).encode()).hexdigest()

        def run(batches, shared=shared, name=name):
            machine, table = _machine(shared, name, share, min_words)
            for batch in batches:
                hits = [(k, i, d, n) for k, t in zip(batch.column("k").to_pylist(), texts_of(batch))
                        for number, d, n in matches(normalise(t), machine, table) for i in table[number][3]]
                columns = list(zip(*hits)) or [(), (), (), ()]
                kinds = [batch.schema.field("k").type, None, pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) if t is not None else pa.array(list(c), _arrow(item_kind))
                     for c, t in zip(columns, kinds)], names=[key, item, "distance", "places"])

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def _arrow(kind: T.DataType) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32()}.get(kind.simpleString(), pa.int64())


def _machine(shared, name: str, share: float, min_words: int) -> tuple:
    """The block's automaton, built once per Python worker."""
    if name not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[name] = automaton(shared.value, share, min_words)
    return _AUTOMATA[name]


def clean_documents(documents: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``documents`` whose key has no leaked item; rows that share a key, null included, go together."""
    return without(documents, key, decontaminate(documents, benchmark, key=key, **options).select(key))


def clean_rows(documents: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text",
               **options) -> DataFrame:
    """The rows of ``documents`` without a leaked item, each judged by its own text whatever its key."""
    rows = documents.select(row_identity(key, text).alias("row"), F.col(text).alias("text"))
    return without(documents, row_identity(key, text),
                   decontaminate(rows, benchmark, key="row", **options).select("row"))
