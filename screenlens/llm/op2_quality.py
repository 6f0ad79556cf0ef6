"""Quality rules by an isolation forest on rule statistics.

Every document gets rule statistics (word counts, symbols, repeated lines and words, ...).  An isolation forest is grown
on a bounded, seeded sample of labelled rows (``fit_rows``, a documented parameter), and a document's mean path length
over the trees says how soon random splits single it out.  A document that passes the base rules is rejected if its
anomaly score reaches the threshold; nothing else decides.

* What the trees see: each statistic counts from the good rows' median on, towards the side where the bad rows lie, in
  units of the good rows' spread (0.99 quantile less median).  Being unusually clean is no anomaly.
* Each tree splits a subsample of good rows with a few bad ones among them.  The column of a split is drawn in proportion
  to its extent, the value uniformly: rows far out on any statistic are cut off within a few splits, while a column in
  which the good rows differ little is seldom chosen.
* The threshold is calibrated on all labelled rows, which Spark scores and counts by score in steps of 1 / ``GRID``: of
  the thresholds that cost at most ``max_good_loss`` of the good rows, the one with the best balance of bad rows caught
  against good rows lost, and the middle of a range of equals.

Edge cases: null text has no words (base_failed by n_words < 50); without labelled rows of both kinds there is nothing to
calibrate on and only the base rules decide; ties in scores fall on the same side; rows are independent, so repeated
rows and null ids each keep their own row; columns other than the key and the text are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, Stage, slices, texts_of

MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
FIT_ROWS = 20_000       # labelled rows used to grow and calibrate, at most
TREES = 100
SUBSAMPLE = 256
SEED = 20240601
MAX_GOOD_LOSS = 0.002   # share of rows labelled good that calibration may reject
GOOD_PER_BAD = 64       # in a tree's subsample: bad rows must be few there, or they hide one another
SPREAD = 0.99           # quantile of the good rows that is one unit from their median
GRID = 10_000           # steps of the score in calibration
GOOD_WEIGHT = 20.0      # calibration: a good row lost counts as much as this many bad rows caught (as shares)

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: what the forest sees, all shares or means, so that length alone does not isolate a document
FEATURES = ["symbol_share", "dup_line_share", "repeat_share", "mean_word", "upper_share", "digit_share",
            "distinct_share", "punct_share"]


def statistics(text: str) -> tuple:
    """Base counts and feature values of one whole text."""
    words = text.encode("utf-8", "surrogatepass").split()    # bytes.split() splits at exactly 0x20, 0x09-0x0D
    n = len(words)
    word_chars = len(text) - sum(map(text.count, ASCII_SPACE))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(ASCII_SPACE)]
    n_dup = len(lines) - len(set(lines))
    n_repeat = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:]))
        seen: set = set()
        again: set = set()
        if len(set(windows)) < len(windows):
            for w in windows:
                (again if w in seen else seen).add(w)
            covered = np.zeros(n + 2, dtype=bool)
            at = np.fromiter((w in again for w in windows), dtype=bool, count=len(windows))
            for shift in range(3):
                covered[shift: shift + len(at)] |= at
            n_repeat = int(covered.sum())
    chars = max(1, word_chars)
    ascii_view = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(ascii_view, minlength=256)
    upper, digit = int(counts[65:91].sum()), int(counts[48:58].sum())
    punct = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()) - n_symbols
    features = (n_symbols / chars, n_dup / max(1, len(lines)), n_repeat / max(1, n), word_chars / max(1, n),
                upper / chars, digit / chars, len(set(words)) / max(1.0, n ** 0.8), punct / chars)
    return (n, word_chars, n_symbols, n_dup, n_repeat, *map(float, features))


def rule_statistics(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the five base counts and the feature columns, one row per row of ``df``; no shuffle."""
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *[T.StructField(c, T.LongType()) for c in BASE],
                           *[T.StructField(c, T.DoubleType()) for c in FEATURES]])

    def run(batches):
        for batch in slices(batches, "text"):
            rows = list(zip(*map(statistics, texts_of(batch)))) or [()] * (len(BASE) + len(FEATURES))
            kinds = [pa.int64()] * len(BASE) + [pa.float64()] * len(FEATURES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), *[pa.array(list(v), k) for v, k in zip(rows, kinds)]],
                names=[key, *BASE, *FEATURES])

    return df.select(key, F.col(text).alias("text")).mapInArrow(run, schema)


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary search tree of ``n`` rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(rows: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """One tree as an array of nodes (column, value, left, right, path length at a leaf).

    A split's column is drawn in proportion to its extent among the node's rows, its value uniformly over the extent.
    """
    nodes: list[tuple] = []

    def split(at: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append(())
        low, high = at.min(0), at.max(0)
        extent = high - low
        if depth >= limit or len(at) <= 1 or not extent.any():
            nodes[me] = (-1, 0.0, 0, 0, depth + average_path(len(at)))
            return me
        column = int(rng.choice(len(extent), p=extent / extent.sum()))
        value = float(rng.uniform(low[column], high[column]))
        value = value if value > low[column] else float(high[column])    # neither side is empty
        left = at[:, column] < value
        nodes[me] = (column, value, split(at[left], depth + 1), split(at[~left], depth + 1), 0.0)
        return me

    split(rows, 0)
    return nodes


class Forest:
    """Trees as flat arrays, what turns statistics into their columns, and the calibrated threshold."""

    def __init__(self, trees: list[list[tuple]], subsample: int, middle: np.ndarray, unit: np.ndarray, side: np.ndarray):
        self.trees = [tuple(np.array(c) for c in zip(*t)) for t in trees]
        self.scale = max(average_path(subsample), 1e-9)
        self.middle, self.unit, self.side = middle, unit, side
        self.threshold = math.inf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1] of rule statistics: 2 ** -(mean path / expected path)."""
        x = excess(x, self.middle, self.unit, self.side)
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for column, value, left, right, length in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                c = column[node]
                inner = c >= 0
                if not inner.any():
                    break
                go_left = x[every, np.maximum(c, 0)] < value[node]
                node = np.where(inner, np.where(go_left, left[node], right[node]), node)
            total += length[node]
        return 2.0 ** (-(total / max(1, len(self.trees))) / self.scale)

    def rejects(self, x: np.ndarray) -> np.ndarray:
        return self.score(x) >= self.threshold


def excess(x: np.ndarray, middle: np.ndarray, unit: np.ndarray, side: np.ndarray) -> np.ndarray:
    """How far the statistics lie from the good rows' median on the bad rows' side, in the good rows' units."""
    return np.maximum(0.0, x * side - middle) / unit


def threshold_of(good: np.ndarray, bad: np.ndarray, max_good_loss: float = MAX_GOOD_LOSS,
                 good_weight: float = GOOD_WEIGHT) -> float:
    """The calibrated threshold; ``good`` and ``bad`` count the labelled rows by ``floor(score * GRID)``."""
    lost, caught = (np.cumsum(c[::-1])[::-1] / max(1, c.sum()) for c in (good, bad))
    gain = np.where(lost <= max_good_loss, caught - good_weight * lost, -1.0)
    best = int(gain.argmax())
    if gain[best] <= 0:
        return math.inf
    last = best
    while last + 1 < len(gain) and gain[last + 1] == gain[best]:
        last += 1
    return (best + last) // 2 / GRID


def steps(score: np.ndarray) -> np.ndarray:
    return np.floor(score * GRID).astype(np.int64)


def fit(x: np.ndarray, good: np.ndarray, *, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> Forest | None:
    """Grow on labelled rows and calibrate on them; None if either kind is missing."""
    if not good.any() or good.all():
        return None
    rng = np.random.default_rng(seed)
    reference, bad = x[good], x[~good]
    # the side of each statistic on which bad rows lie
    gap = np.median(bad, 0) - np.median(reference, 0)
    tail = np.quantile(bad, 0.75, 0) - np.quantile(reference, 0.75, 0)
    side = np.where(gap != 0, np.sign(gap), np.sign(tail))
    middle = np.median(reference * side, 0)
    unit = np.maximum(np.quantile(reference * side, SPREAD, 0) - middle, 1e-3)
    reference, bad = (excess(r, middle, unit, side) for r in (reference, bad))
    few = min(len(bad), max(1, min(subsample, len(reference)) // GOOD_PER_BAD))
    many = min(subsample - few, len(reference))
    limit = max(1, math.ceil(math.log2(max(2, many + few))))

    def rows() -> np.ndarray:
        return np.concatenate((reference[rng.choice(len(reference), many, replace=False)],
                               bad[rng.choice(len(bad), few, replace=False)]))

    forest = Forest([grow(rows(), rng, limit) for _ in range(trees)], many + few, middle, unit, side)
    at = steps(forest.score(x))
    forest.threshold = threshold_of(*(np.bincount(at[k], minlength=GRID + 1) for k in (good, ~good)))
    return forest


def labelled(stats: DataFrame, labels: DataFrame, *, key: str = "doc_id", quality: str = "quality") -> DataFrame:
    """k, good (0 or 1) and the statistics of the labelled rows that pass the base rules."""
    label = labels.groupBy(F.col(key).alias("k")).agg(F.max(F.col(quality).cast("int")).alias("good"))
    return (stats.withColumnRenamed(key, "k").join(label.filter("good in (0, 1) and k is not null"), "k")
            .filter(~base_failed()).select("k", "good", *FEATURES))


def labelled_sample(found: DataFrame, rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and goodness of at most ``rows`` labelled rows, half of each kind, chosen by a seeded hash of the key."""
    found = found.withColumn("h", F.xxhash64(F.lit(SEED), "k"))
    counts = {r["good"]: r["count"] for r in found.groupBy("good").count().collect()}
    parts = []
    for g in (0, 1):
        share = min(1.0, 1.25 * (rows // 2) / max(1, counts.get(g, 0)))   # thin by hash before the bounded top-n
        thin = found.filter((F.col("good") == g) & (F.pmod("h", F.lit(1_000_000)) < math.ceil(share * 1_000_000)))
        parts.append(thin.orderBy("h", *FEATURES).limit(rows // 2).select("good", *FEATURES).toPandas())
    good = np.concatenate([p["good"].to_numpy() for p in parts]) == 1
    return np.concatenate([p[FEATURES].to_numpy(dtype=float) for p in parts]), good


def calibrated(found: DataFrame, forest: Forest | None) -> Forest | None:
    """The forest with its threshold from all labelled rows: Spark scores them, the driver gets 2 * GRID counts at most."""
    if forest is None:
        return None

    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in FEATURES])
            at = steps(forest.score(x)) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(at)], names=["good", "step"])

    counts = np.zeros((2, GRID + 1), np.int64)
    for r in found.mapInArrow(run, "good int, step long").groupBy("good", "step").count().collect():
        counts[r["good"], r["step"]] = r["count"]
    forest.threshold = threshold_of(counts[1], counts[0])
    return forest


def fitted(stats: DataFrame, labels: DataFrame, *, key: str = "doc_id", fit_rows: int = FIT_ROWS) -> Forest | None:
    found = Stage(stats.sparkSession, "quality-fit").write(labelled(stats, labels, key=key), "labelled")
    return calibrated(found, fit(*labelled_sample(found, fit_rows)))


def judge(stats: DataFrame, forest: Forest | None) -> DataFrame:
    """Add base_failed, score (null without a forest) and kept to the rule statistics."""
    failed = stats.withColumn("base_failed", base_failed())
    if forest is None:
        return failed.withColumn("score", F.lit(None).cast("double")).withColumn("kept", ~F.col("base_failed"))
    schema = T.StructType([*failed.schema, T.StructField("score", T.DoubleType()),
                           T.StructField("kept", T.BooleanType())])

    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in FEATURES])
            score = forest.score(x) if len(x) else np.zeros(0)
            anomalous = score >= forest.threshold
            failed_rows = batch.column("base_failed").to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score), pa.array(~failed_rows & ~anomalous)],
                names=[*batch.schema.names, "score", "kept"])

    return failed.mapInArrow(run, schema)


def quality_rules(documents: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS, key: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """Statistics, base rules, score and verdict of every document.

    One scan of the texts writes the narrow statistics table; the fit joins it with the labels and the scoring reads
    it again, so no text is ever shuffled.
    """
    stats = Stage(documents.sparkSession, "quality").write(rule_statistics(documents, key=key, text=text), "statistics")
    return judge(stats, fitted(stats, labels, key=key, fit_rows=fit_rows))


def accepted(documents: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS, key: str = "doc_id",
             text: str = "text") -> DataFrame:
    """The rows of ``documents`` that are kept, all their columns; one scan to fit, one to filter, no shuffle of texts."""
    stats = Stage(documents.sparkSession, "quality").write(rule_statistics(documents, key=key, text=text), "statistics")
    forest = fitted(stats, labels, key=key, fit_rows=fit_rows)
    names = documents.columns

    def run(batches):
        for batch in slices(batches, text):
            rows = [statistics(t) for t in texts_of(batch, text)]
            if not rows:
                continue
            x = np.array([r[len(BASE):] for r in rows])
            n, repeat = np.array([r[0] for r in rows]), np.array([r[4] for r in rows])
            keep = ~((n < MIN_WORDS) | (100 * repeat > 50 * n))
            if forest is not None:
                keep &= ~forest.rejects(x)
            yield pa.RecordBatch.from_arrays(batch.columns, names=names).filter(pa.array(keep))

    return documents.mapInArrow(run, documents.schema)
