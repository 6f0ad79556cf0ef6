"""Token counts by a linear longest-match automaton.

Greedy word-piece tokenisation takes, again and again, the longest vocabulary entry that starts the rest of a word.  The
automaton does it in one pass over the bytes: a trie of the vocabulary whose nodes carry a failure link (where to go on
when the next byte has no edge) and the number of pieces that following it pops.  Counting needs no piece to be built:
the count is the sum of the popped numbers.

A vocabulary has pieces that start a word and pieces that continue one; both may be the same set.  Words are runs of
bytes that are not ASCII white space, each preceded by ``lead`` (for byte-level vocabularies whose word starts carry a
space).  A word that no sequence of greedy pieces spells is one unknown token, as usual.

Edge cases: null or empty text has no words and no tokens; a very long word is a single linear pass; rows are
independent, so repeated rows and null keys each give their row; extra columns are ignored.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import texts_of

CACHE_WORDS = 400_000
UNKNOWN = 1 << 40       # added to the token count of an unknown word, so one sum counts both

_COUNTERS: dict[tuple, "WordCounts"] = {}


class Automaton:
    """Trie, failure links and popped-piece counts; node 0 starts a word, node 1 continues one."""

    def __init__(self, initial: set[bytes], continuing: set[bytes]):
        self.edge: dict[int, int] = {}          # node << 8 | byte -> node
        parent, byte, end = [-1, -1], [0, 0], [False, False]
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                node = root
                for b in piece:
                    child = self.edge.get(node << 8 | b)
                    if child is None:
                        child = self.edge[node << 8 | b] = len(parent)
                        parent.append(node)
                        byte.append(b)
                        end.append(False)
                    node = child
                if node != root:
                    end[node] = True
        depth = [0, 0]
        for v in range(2, len(parent)):
            depth.append(depth[parent[v]] + 1)
        self.fail = [-1] * len(parent)          # -1: the word cannot be spelled from here
        self.popped = [0] * len(parent)
        for v in sorted(range(2, len(parent)), key=depth.__getitem__):
            if end[v]:
                self.fail[v], self.popped[v] = 1, 1
                continue
            z, popped = self.fail[parent[v]], self.popped[parent[v]]
            while z >= 0 and (z << 8 | byte[v]) not in self.edge:
                popped += self.popped[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[v], self.popped[v] = self.edge[z << 8 | byte[v]], popped

    def count(self, word: bytes) -> int:
        """Pieces of a non-empty word, or -1 if greedy matching cannot spell it."""
        edge, fail, popped = self.edge, self.fail, self.popped
        node = total = 0
        for b in word:
            while True:
                nxt = edge.get(node << 8 | b)
                if nxt is not None:
                    node = nxt
                    break
                if fail[node] < 0:
                    return -1
                total += popped[node]
                node = fail[node]
        while node != 1:
            if fail[node] < 0:
                return -1
            total += popped[node]
            node = fail[node]
        return total


class WordCounts(dict):
    """Remembered counts of words, bounded; unknown words are 1 + UNKNOWN."""

    def __init__(self, automaton: Automaton, lead: bytes):
        super().__init__()
        self.automaton, self.lead = automaton, lead

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(self.lead + word)
        n = n if n >= 0 else 1 + UNKNOWN
        if len(word) < 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n


def read_ranks(path: str) -> set[bytes]:
    """The pieces of a rank file (base64 piece, rank per line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(line.split()[0]) for line in f if line.strip()}


def _counter(path: str, lead: bytes) -> WordCounts:
    if (path, lead) not in _COUNTERS:
        pieces = read_ranks(path)
        _COUNTERS[path, lead] = WordCounts(Automaton(pieces, pieces), lead)
    return _COUNTERS[path, lead]


def token_counts(df: DataFrame, path: str, *, key: str = "doc_id", text: str = "text",
                 lead: bytes = b" ") -> DataFrame:
    """key, n_words, n_tokens, n_unknown of every row: one scan, no shuffle, no pieces."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType),
                           *[T.StructField(c, T.LongType()) for c in ("n_words", "n_tokens", "n_unknown")]])

    def run(batches):
        counts = _counter(path, lead)
        for batch in batches:
            words = [t.encode("utf-8", "surrogatepass").split() for t in texts_of(batch)]
            sums = [sum(map(counts.__getitem__, w)) for w in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), pa.array([len(w) for w in words], pa.int64()),
                 pa.array([s % UNKNOWN for s in sums], pa.int64()),
                 pa.array([s // UNKNOWN for s in sums], pa.int64())], names=schema.names)

    return df.select(F.col(key).alias("k"), F.col(text).alias("text")).mapInArrow(run, schema)
