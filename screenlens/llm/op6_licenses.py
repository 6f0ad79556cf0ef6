"""License scan by an exact set-similarity join of text blocks with license templates.

Blocks are the windows of ``BLOCK_WORDS`` words over the whole text, whatever its line ends, that overlap by half and at
least by the longest template, and the lines of the text (long ones cut in the same way).  A template is met by a block
that contains at least ``CONTAINMENT`` of its distinct words.  The join finds every such pair exactly without comparing
all: words are put in one global order, rarest in the corpus first; at least one of a template's |T| - need + 1 rarest
words (its prefix) must be in the block; the block must have at least ``need`` template words (length); and from the
first common word on, both sides must have enough words left (position).  Survivors are verified.

The order comes from document frequencies over the whole corpus (one scan with counts summed per task).  The templates
are the fixed side: their number is a constant of the module or the caller's list, checked against ``MAX_TEMPLATES``.
Besides, the base places (exact phrases) are found on the words of the whole text.

Edge cases: null text is empty; ties in the global order are broken by the word itself; a template without words is
refused; repeated rows and null keys each give their row; extra columns are ignored.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import texts_of

CONTAINMENT = 0.8
BLOCK_WORDS = 64
MAX_TEMPLATES = 10_000

# The base phrases with their labels.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
# License sentences as they appear in documents, with their labels.
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("all rights reserved", "all-rights-reserved"),
]

#: keeps digits, a-z and bytes from 0x80 on, lowers A-Z, keeps line ends, turns the rest into spaces
_TABLE = bytes(c if c == 10 or 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32
               for c in range(256))


def clean(text: str) -> bytes:
    """Lower-cased words with everything else as spaces, line ends kept."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE)


def base_places(words: list[bytes], phrases: list[tuple[bytes, str]]) -> tuple[list[int], set[str]]:
    """Starts (word numbers) of all places where a phrase's words stand consecutively, and their labels."""
    line = b" " + b" ".join(words) + b" "
    starts, labels = [], set()
    for phrase, label in phrases:
        at, counted, number = line.find(phrase), 0, 0
        while at >= 0:
            number, counted = number + line.count(b" ", counted, at), at
            starts.append(number)
            labels.add(label)
            at = line.find(phrase, at + 1)
    return starts, labels


class TemplateIndex:
    """Templates as word sequences in the global order, posted under the words of their prefixes."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], containment: float):
        if len(templates) > MAX_TEMPLATES:
            raise ValueError(f"more than {MAX_TEMPLATES} templates: split the list into several scans")
        self.templates = []
        vocabulary = sorted({w for t, _ in templates for w in clean(t).split()},
                            key=lambda w: (frequency.get(w, 0), w))
        self.order = {w: i for i, w in enumerate(vocabulary)}
        self.posted: dict[bytes, list[tuple[int, int]]] = {}
        for number, (template, label) in enumerate(templates):
            words = sorted(set(clean(template).split()), key=self.order.__getitem__)
            if not words:
                raise ValueError("a template without words")
            need = max(1, math.ceil(containment * len(words) - 1e-9))
            self.templates.append((frozenset(words), need, label))
            for j, word in enumerate(words[: len(words) - need + 1]):
                self.posted.setdefault(word, []).append((number, j))
        self.prefix_words = frozenset(self.posted)
        self.vocabulary = frozenset(vocabulary)

    def met(self, block: list[bytes]) -> dict[str, float]:
        """Labels of the templates the block meets, with the best containment."""
        known = sorted(self.vocabulary.intersection(block), key=self.order.__getitem__)
        found: dict[str, float] = {}
        seen: set[int] = set()
        for i, word in enumerate(known):
            for number, j in self.posted.get(word, ()):
                words, need, label = self.templates[number]
                if number in seen or len(known) < need:
                    continue
                seen.add(number)            # the first common word bounds what can still follow on both sides
                if 1 + min(len(known) - i - 1, len(words) - j - 1) < need:
                    continue
                common = len(words.intersection(known))
                if common >= need:
                    found[label] = max(found.get(label, 0.0), common / len(words))
        return found


def blocks(words: list[bytes], size: int = BLOCK_WORDS) -> list[list[bytes]]:
    """A sequence of words as one block, or as windows of ``size`` words that overlap by half."""
    if len(words) <= size:
        return [words]
    step = size // 2
    return [words[a: a + size] for a in range(0, len(words) - step, step)]


def frequencies(df: DataFrame, templates: list[tuple[str, str]], text: str = "text") -> dict[bytes, int]:
    """Document frequency, over all rows, of the words that occur in templates (a bounded set)."""
    vocabulary = frozenset(w for t, _ in templates for w in clean(t).split())

    def run(batches):
        counts = dict.fromkeys(vocabulary, 0)
        for batch in batches:
            for t in texts_of(batch):
                for word in vocabulary.intersection(clean(t).split()):
                    counts[word] += 1
        yield pa.RecordBatch.from_pydict({"word": list(counts), "n": list(counts.values())},
                                         schema=pa.schema([("word", pa.binary()), ("n", pa.int64())]))

    schema = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())])
    rows = df.select(F.col(text).alias("text")).mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in rows.collect()}


def license_scan(df: DataFrame, *, key: str = "doc_id", text: str = "text", phrases=None, templates=None,
                 containment: float = CONTAINMENT) -> DataFrame:
    """One row per row of ``df``: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the best containment of a met template, 0 without one.
    """
    phrases = [(b" " + b" ".join(clean(p).split()) + b" ", label) for p, label in (phrases or PHRASES)]
    templates = templates or TEMPLATES
    index = TemplateIndex(templates, frequencies(df, templates, text), containment)
    size = max(BLOCK_WORDS, 2 * max(len(clean(t).split()) for t, _ in templates))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType),
                           *[T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")],
                           T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def scan(text_of: str) -> tuple:
        data = clean(text_of)
        words = data.split()
        starts, base = base_places(words, phrases)
        found: dict[str, float] = {}
        if not index.prefix_words.isdisjoint(words):
            found_blocks = blocks(words, size)
            for line in data.split(b"\n"):
                found_blocks += blocks(line.split())
            for block in found_blocks:
                if not index.prefix_words.isdisjoint(block):
                    for label, share in index.met(block).items():
                        found[label] = max(found.get(label, 0.0), share)
        return (len(words), len(starts), min(starts, default=None), max(starts, default=None),
                ",".join(sorted(base)), ",".join(sorted(base | set(found))), max(found.values(), default=0.0))

    def run(batches):
        for batch in batches:
            columns = list(zip(*map(scan, texts_of(batch)))) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), *[pa.array(list(c), t) for c, t in zip(columns, kinds)]], names=schema.names)

    return df.select(F.col(key).alias("k"), F.col(text).alias("text")).mapInArrow(run, schema)
