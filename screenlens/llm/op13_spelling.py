"""Spelling variants grouped by bidirectional FM-index search schemes.

Words are counted over all texts; two words are near if they differ by one inserted, deleted or replaced code point; a
word's form is its most frequent near word, if that is ``RATIO`` times as frequent as the word; its root is where the
chain of forms ends.

Near pairs.  One edit leaves the first half or the second half of the shorter word intact, so the search has two schemes:
match the first half (with the delimiter before it) exactly and extend right with one error, or match the second half
(with the delimiter after it) exactly and extend left with one error.  Both run on an index of the delimited vocabulary
that can be extended in either direction: a Burrows-Wheeler transform of the text and one of its reverse, each as a
wavelet matrix, with a pair of suffix-rank intervals kept in step.  All words of a shard are searched at once, one
extension step for all of them.

The vocabulary is dealt into shards by exact half: words that share the half, and a length or one less, meet in one
shard (four postings a word), so a word is searched only in the two shards of its own halves.  A half with more than
``GROUP_WORDS`` words is dealt into several shards that are each searched by all of the half's words.

Edge cases: null and empty texts have no words; a null key counts as an empty string where occurrences are thinned;
letters are A-Z, a-z and the code points C0 to FF, lower-cased only from A to Z; words of any length take part; ties
between near words go to the smallest in code-point order; repeated rows count each time; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stage, slices

MIN_LENGTH = 7          # code points
MIN_COUNT = 2
RATIO = 10
THIN = 31               # an occurrence whose hash this divides loses one letter
GROUP_WORDS = 20_000
SHARD_POSTINGS = 40_000
END, DELIMITER = 0, 1   # symbols; letters follow
_LOWER = {c: c + 32 for c in range(65, 91)}


def occurrence(key: str, run: str, thin: int = THIN) -> str:
    """The word that a lower-cased run counts as in the document ``key``."""
    h = zlib.crc32(f"{key}:{run}".encode())
    if h % thin:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def words_of(key: str, text: str, min_length: int = MIN_LENGTH, thin: int = THIN) -> Counter:
    """Words of at least ``min_length`` code points and their occurrences in one text."""
    runs = Counter(re.findall("[A-Za-zÀ-ÿ]{%d,}" % min_length, text))
    found: Counter = Counter()
    for run, n in runs.items():
        word = occurrence(key, run.lower() if run.isascii() else run.translate(_LOWER), thin)
        if len(word) >= min_length:
            found[word] += n
    return found


def vocabulary(documents: DataFrame, *, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH,
               min_count: int = MIN_COUNT, thin: int = THIN) -> DataFrame:
    """word, n: the words of all texts that occur at least ``min_count`` times."""
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches):
        for batch in slices(batches, "text"):
            found: Counter = Counter()
            for k, t in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                if t:
                    found.update(words_of(k, t, min_length, thin))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(found.values(), pa.int64())],
                                             names=["word", "n"])

    occurrences = documents.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("doc"),
                                   F.col(text).alias("text")).mapInArrow(run, schema)
    return occurrences.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


class WaveletMatrix:
    """Ranks and counts of smaller symbols over a sequence, for many ranges at once."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.depth = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        at = sequence
        for level in range(self.depth - 1, -1, -1):
            bit = (at >> level & 1).astype(bool)
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(int(len(at) - bit.sum()))
            at = np.concatenate((at[~bit], at[bit]))
        self.first = np.zeros(1 << self.depth, np.int64)      # where each symbol's run begins at the last level
        everything = np.arange(1 << self.depth)
        begin, _, _ = self.child(np.zeros(len(everything), np.int64), np.zeros(len(everything), np.int64), everything)
        self.first[everything] = begin

    def child(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray):
        """For each range the positions (from ``first``) of the symbol's occurrences, and how many are smaller."""
        less = np.zeros(len(lo), np.int64)
        for level in range(self.depth):
            ones, zeros = self.ones[level], self.zeros[level]
            a, b = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            up = (symbol >> (self.depth - 1 - level) & 1).astype(bool)
            less += np.where(up, (hi - lo) - (b - a), 0)
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + b, hi - b)
        return lo, hi, less

    def children(self, lo: np.ndarray, hi: np.ndarray):
        """All symbols that occur in each range: (range, symbol, lo, hi, smaller), as ``child`` would give."""
        which, symbol, less = np.arange(len(lo)), np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        for level in range(self.depth):
            ones, zeros = self.ones[level], self.zeros[level]
            a, b = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            down, up = (hi - lo) > (b - a), b > a
            which, symbol, less, lo, hi = (
                np.concatenate((which[down], which[up])),
                np.concatenate((symbol[down] << 1, symbol[up] << 1 | 1)),
                np.concatenate((less[down], (less + (hi - lo) - (b - a))[up])),
                np.concatenate(((lo - a)[down], (zeros + a)[up])),
                np.concatenate(((hi - b)[down], (zeros + b)[up])))
        return which, symbol, lo, hi, less


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes in order, by prefix doubling; the last symbol must be smaller than all others."""
    n = len(text)
    rank, width = text.astype(np.int64), 1
    while True:
        second = np.append(rank[width:] + 1, np.zeros(min(width, n), np.int64))
        pair = rank * (rank.max() + 2) + second
        order = np.argsort(pair, kind="stable")
        ordered = pair[order]
        step = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = step
        if step[-1] == n - 1:
            return order
        width *= 2


class BidirectionalIndex:
    """Suffix-rank intervals over the delimited words, extensible to the left and to the right."""

    def __init__(self, words: list[str]):
        text = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le"), np.uint32)
        self.letters = np.unique(text)                          # the delimiter sorts before all letters
        codes = np.searchsorted(self.letters, text) + DELIMITER
        self.symbols = len(self.letters) + DELIMITER
        self.n = len(codes) + 1
        self.delimiters = np.flatnonzero(codes == DELIMITER)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(np.append(codes, END), minlength=self.symbols))))
        self.suffixes, self.left = self._transform(codes)
        _, self.right = self._transform(codes[::-1])

    def _transform(self, codes: np.ndarray) -> tuple[np.ndarray, WaveletMatrix]:
        text = np.append(codes, END)
        order = suffix_array(text)
        return order, WaveletMatrix(text[order - 1], self.symbols)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the delimited words and each word's start; letters that the index lacks get a symbol of their own."""
        text = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.letters, text), len(self.letters) - 1)
        return (np.where(self.letters[at] == text, at + DELIMITER, -1),
                np.concatenate(([1], np.flatnonzero(text == 10)[1:-1] + 1)).astype(np.int64))

    def extend(self, to_right: bool, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """States (rows: lo, lo in the reverse, size) after one more symbol; size 0 where there is none."""
        matrix = self.right if to_right else self.left
        own, other = (1, 0) if to_right else (0, 1)
        known = symbol >= 0
        c = np.where(known, symbol, 0)
        lo, hi, less = matrix.child(state[own], state[own] + state[2], c)
        out = np.empty_like(state)
        out[own] = self.first[c] + lo - matrix.first[c]
        out[other] = state[other] + less
        out[2] = np.where(known, hi - lo, 0)
        return out

    def branch(self, to_right: bool, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All one-symbol extensions: (index of the state, symbol, new states)."""
        matrix = self.right if to_right else self.left
        own, other = (1, 0) if to_right else (0, 1)
        which, symbol, lo, hi, less = matrix.children(state[own], state[own] + state[2])
        out = np.empty((3, len(which)), np.int64)
        out[own] = self.first[symbol] + lo - matrix.first[symbol]
        out[other] = state[other][which] + less
        out[2] = hi - lo
        return which, symbol, out

    def whole(self, n: int) -> np.ndarray:
        return np.repeat(np.array([[0], [0], [self.n]], np.int64), n, axis=1)

    def word_at(self, lo: np.ndarray) -> np.ndarray:
        """The word that begins after the delimiter at these suffix ranks."""
        return np.searchsorted(self.delimiters, self.suffixes[lo])


def search(index: BidirectionalIndex, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray,
           to_right: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, word found, inserted): words with one letter replaced, or one more, in the half that ``to_right`` names.

    ``codes`` holds the delimited query words, ``starts`` and ``lengths`` their places.
    """
    half = lengths // 2
    step = 1 if to_right else -1
    # the exact half: from the middle outwards, up to and with the delimiter
    state, query = index.whole(len(starts)), np.arange(len(starts))
    at = np.where(to_right, half - 1, half)
    while True:
        going = (at >= -1) if to_right else (at <= lengths[query])
        going &= state[2] > 0
        if not going.any():
            break
        grown = index.extend(not to_right, state[:, going], codes[starts[query[going]] + at[going]])
        state[:, going] = grown
        at = at - step * going
    alive = state[2] > 0
    query, state = query[alive], state[:, alive]
    at = (half if to_right else half - 1)[query]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    # one error in the other half; ``late`` states have had it and go on exactly
    late_q, late_at, late, late_more = query[:0], at[:0], state[:, :0], np.zeros(0, bool)
    first = True
    while len(query) or len(late_q):
        last = lengths[late_q] if to_right else np.full(len(late_q), -1)
        late = index.extend(to_right, late, codes[starts[late_q] + late_at])
        done, on = (late[2] > 0) & (late_at == last), (late[2] > 0) & (late_at != last)
        found.append((late_q[done], index.word_at(late[0][done]), late_more[done]))
        late_q, late_at, late, late_more = late_q[on], late_at[on] + step, late[:, on], late_more[on]
        which, symbol, grown = index.branch(to_right, state)
        wanted = codes[starts[query] + at][which]
        q, p = query[which], at[which]
        other = (symbol != wanted) & (symbol > DELIMITER)
        end = p == (lengths[q] if to_right else -1)
        swap = other & ~end
        more = other if to_right or not first else np.zeros(len(other), bool)
        late_q = np.concatenate((late_q, q[swap], q[more]))
        late_at = np.concatenate((late_at, p[swap] + step, p[more]))
        late = np.concatenate((late, grown[:, swap], grown[:, more]), axis=1)
        late_more = np.concatenate((late_more, np.zeros(swap.sum(), bool), np.ones(more.sum(), bool)))
        same = (symbol == wanted) & ~end
        query, at, state, first = q[same], p[same] + step, grown[:, same], False
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))


def near_in_shard(indexed: list[str], asked: list[str], to_right: list[bool]) -> list[tuple[int, int, bool]]:
    """(asked, indexed, inserted) positions of near words, by the scheme that ``to_right`` names for each asked word."""
    index = BidirectionalIndex(indexed)
    out = []
    for side in (True, False):
        at = [i for i, r in enumerate(to_right) if r == side]
        for some in (at[i: i + 5_000] for i in range(0, len(at), 5_000)):
            words = [asked[i] for i in some]
            codes, starts = index.encode(words)
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            q, w, more = search(index, codes, starts, lengths, side)
            out.extend(zip(np.array(some)[q.astype(np.int64)].tolist(), w.tolist(), more.tolist()))
    return out


def postings(words: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """word, n, right (the exact half is the first one), size (length of the shorter word), half, asked."""
    length = F.length("word")
    half = lambda size: F.floor(size / 2).cast("int")
    forms = []
    for size, asked in ((length, True), (length - 1, False)):
        rest = size - half(size)
        forms += [F.struct(F.lit(True).alias("right"), size.alias("size"),
                           F.substring("word", F.lit(1), half(size)).alias("half"), F.lit(asked).alias("asked")),
                  F.struct(F.lit(False).alias("right"), size.alias("size"),
                           F.substring("word", length - rest + 1, rest).alias("half"), F.lit(asked).alias("asked"))]
    return (words.select("word", "n", F.explode(F.array(*forms)).alias("p")).select("word", "n", "p.*")
            .filter(F.col("size") >= min_length))


def near_words(words: DataFrame, stage: Stage, min_length: int = MIN_LENGTH, group_words: int = GROUP_WORDS,
               shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """word, near, n_of_near: all pairs of near words of ``words(word, n)``, in both directions."""
    posted = postings(words, min_length)
    half = ["right", "size", "half"]
    groups = stage.write(posted.groupBy(*half).agg(F.count("*").alias("members"), F.max("asked").alias("any"))
                         .filter("members > 1 and any").drop("any"), "halves")
    total = groups.agg(F.sum("members")).first()[0] or 0
    shards = max(1, -(-total // shard_postings))
    met = (posted.join(groups, half)
           .withColumn("parts", F.ceil(F.col("members") / group_words).cast("int"))
           .withColumn("own", F.pmod(F.xxhash64("word"), "parts").cast("int"))
           # indexed in its own part of the half, asked in all of them
           .withColumn("part", F.explode(F.when(F.col("asked"), F.sequence(F.lit(0), F.col("parts") - 1))
                                         .otherwise(F.array("own"))))
           .select(F.pmod(F.xxhash64(*half, "part"), F.lit(shards)).alias("shard"), "word", "n", "right", "asked",
                   (F.col("part") == F.col("own")).alias("indexed")))
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("near", T.StringType()),
                           T.StructField("n_of_near", T.LongType())])

    def run(rows: pa.Table) -> pa.Table:
        word, n, right, asked, indexed = (rows.column(c).to_pylist() for c in ("word", "n", "right", "asked", "indexed"))
        count = dict(zip(word, n))
        held = sorted({w for w, i in zip(word, indexed) if i})
        ask = [(w, r) for w, r, a in zip(word, right, asked) if a]
        names = [w for w, _ in ask]
        pairs = near_in_shard(held, names, [r for _, r in ask]) if held and ask else []
        both = [(names[q], held[w]) for q, w, _ in pairs] + [(held[w], names[q]) for q, w, more in pairs if more]
        return pa.table([pa.array([a for a, _ in both], pa.string()), pa.array([b for _, b in both], pa.string()),
                         pa.array([count[b] for _, b in both], pa.int64())], names=schema.names)

    return met.groupBy("shard").applyInArrow(run, schema).distinct()


def variant_groups(documents: DataFrame, *, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH,
                   min_count: int = MIN_COUNT, ratio: int = RATIO, thin: int = THIN, group_words: int = GROUP_WORDS,
                   shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    stage = Stage(documents.sparkSession, "spelling")
    words = stage.write(vocabulary(documents, key=key, text=text, min_length=min_length, min_count=min_count, thin=thin),
                        "vocabulary")
    near = near_words(words, stage, min_length, group_words, shard_postings)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"),
                                    F.min(F.struct((-F.col("n_of_near")).alias("less"), "near")).alias("best"))
    found = stage.write(
        words.join(best, "word", "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.near").alias("near"),
                (-F.col("best.less")).alias("near_n"))
        .withColumn("frequent", F.coalesce(F.col("near_n") >= ratio * F.col("n"), F.lit(False)))
        .select("word", "n", "n_near", F.when(F.col("frequent"), F.col("near")).alias("form"),
                F.when(F.col("frequent"), F.col("near_n")).alias("form_n")), "forms")
    roots = stage.write(found.filter("form is not null").select("word", F.col("form").alias("root")), "roots-0")
    number = 0
    while True:     # a form is ``ratio`` times as frequent, so chains are short; each round doubles what is followed
        number += 1
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        roots = stage.write(roots.join(ahead, "root", "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")),
            f"roots-{number}")
        if not roots.filter("moved").limit(1).count():
            break
        roots = roots.drop("moved")
    return found.join(roots.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
