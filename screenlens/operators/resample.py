"""Replicate weights and one-pass aggregates for interval estimates.

A replicate gives row ``i`` a Poisson(1) weight drawn from a portable integer hash of (replicate, row key).  The weights
of a batch of rows are one matrix (rows x replicates), made inside the task and reduced there:

* ``replicate_cells``: the matrix is summed per (group, true class, predicted class), so a task hands on one array per
  cell, never a row per (row, replicate);
* ``auc_segments``: the rows are range-partitioned by score and each partition reduces its stretch of scores to array
  sums.  A Mann-Whitney sum over all scores is the sum within each stretch plus, for every stretch, its positives times
  the negatives of the stretches below, so only these per-stretch arrays are put in order, never the scores of a pair.

Rows of one score may be dealt to several partitions (a frequent score is no hot key): the lowest and the highest score
of each stretch are kept apart from its inside and are merged with the same score of other stretches before ordering.

Only NumPy and Arrow names are used inside the tasks' functions, so they travel by value.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import spread

BATCH = 2_048           # rows reduced at once; an eighth of them where each has its replicates' weights
WORK = 32_768           # draws made at once


def weight_maker(replicates: int, seed: int, thresholds: Sequence[float]) -> Callable[[np.ndarray], np.ndarray]:
    """Integer keys -> weights (keys x replicates), equal to ``metrics.with_mix_uniform`` and ``poisson_weight``."""
    prime, bits = (1 << 31) - 1, 31

    def least(t: float) -> int:                 # the least whole number n with n / prime >= t
        n = math.ceil(t * prime)
        while (n - 1) / prime >= t:
            n -= 1
        while n / prime < t:
            n += 1
        return n

    # a draw is a whole number over the prime, so it is compared as a whole number
    limits = [n for n in map(least, sorted(thresholds)) if n < prime]
    draws = (((np.arange(replicates, dtype=np.int64) + 1) * 16807 + seed) % prime).astype(np.uint64)
    piece = max(1, WORK // max(1, replicates))
    shift, low, add = np.uint64(bits), np.uint64(prime), np.uint64(1)

    def fold(x: np.ndarray, work: np.ndarray) -> None:      # congruent modulo the Mersenne prime, not yet below it
        np.right_shift(x, shift, out=work)
        np.bitwise_and(x, low, out=x)
        np.add(x, work, out=x)

    def mix(x: np.ndarray, y: np.ndarray, work: np.ndarray, square: int, linear: int, plus: int) -> None:
        """x becomes congruent to square * x * x + linear * x + plus, for x below 2^32: nothing passes 2^64."""
        np.multiply(x, x, out=y)
        fold(y, work)
        np.multiply(y, np.uint64(square), out=y)
        np.multiply(x, np.uint64(linear), out=x)
        np.add(x, y, out=x)
        np.add(x, np.uint64(plus), out=x)
        fold(x, work)

    def weights(keys: np.ndarray) -> np.ndarray:
        out = np.empty((len(keys), replicates))
        start = (np.mod(keys, prime) * 48271 % prime).astype(np.uint64)
        for i in range(0, len(keys), piece):                # few enough numbers at once to stay in the cache
            x = start[i: i + piece, None] + draws
            y, work = np.empty_like(x), np.empty_like(x)
            mix(x, y, work, 69621, 40692, 1)
            mix(x, y, work, 48271, 16807, 7)
            np.add(x, add, out=work)                        # x is below twice the prime: one more than the prime's
            np.right_shift(work, shift, out=work)           # multiple carries into bit 31
            np.add(x, work, out=x)
            u = np.bitwise_and(x, low, out=x).astype(np.uint32)
            count, most = np.zeros(u.shape, np.uint8), int(u.max()) if u.size else 0
            for n in limits:
                if n > most:
                    break
                count += u >= np.uint32(n)
            out[i: i + piece] = count
        return out

    return weights


def replicate_cells(pred: DataFrame, group: Sequence[str], y: str, p: str, value: Column, row_key: str,
                    weights: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """group..., y, p, rep, n (sum of weights), bw (sum of weight times ``value``); one row per cell and replicate."""
    keys = [*group, "y", "p"]
    rows = pred.select(*group, F.col(y).alias("y"), F.col(p).alias("p"),
                       F.col(row_key).cast("bigint").alias("row_key"), value.cast("double").alias("value"))
    names = [f"k{i}" for i in range(len(keys))]
    # the work per row is hundreds of draws: a table that arrives in few files is dealt to all tasks first
    rows = spread(rows.toDF(*names, "row_key", "value"), "row_key")
    schema = T.StructType([*rows.schema.fields[:len(keys)], T.StructField("n", T.ArrayType(T.DoubleType())),
                           T.StructField("bw", T.ArrayType(T.DoubleType()))])
    step, part = BATCH, max(1, BATCH // 8)

    def run(batches):
        cells: dict[tuple, list[np.ndarray]] = {}
        kinds = None
        for whole in batches:
            kinds = kinds or [whole.schema.field(c).type for c in names]
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                cell = np.zeros(batch.num_rows, np.int64)
                for c in names:
                    codes = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()
                    cell = np.unique(cell * (int(codes.max()) + 1) + codes, return_inverse=True)[1]
                of_cell = np.unique(cell, return_index=True)[1]
                # a row's weights are the same in every group, so they are drawn once for rows of one key that lie together
                keys, row = np.unique(batch.column("row_key").fill_null(0).to_numpy(), return_inverse=True)
                shape, spot = (of_cell.size, keys.size), cell * keys.size + row
                ones = np.bincount(spot, minlength=of_cell.size * keys.size).reshape(shape).astype(np.float64)
                value = np.bincount(spot, weights=batch.column("value").fill_null(0.0).to_numpy(),
                                    minlength=of_cell.size * keys.size).reshape(shape)
                found = [tuple(batch.column(c)[i].as_py() for c in names) for i in of_cell.tolist()]
                sums = [cells.setdefault(k, None) for k in found]
                each = np.concatenate((ones, value))
                total = 0
                for i in range(0, keys.size, part):
                    total = total + each[:, i: i + part] @ weights(keys[i: i + part])
                for j, k in enumerate(found):
                    new = total[[j, j + of_cell.size]]
                    cells[k] = new if sums[j] is None else sums[j] + new
        if cells:
            columns = [pa.array([k[i] for k in cells], kinds[i]) for i in range(len(names))]
            arrays = [pa.array([list(s[i]) for s in cells.values()], pa.list_(pa.float64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, *arrays], names=[*names, "n", "bw"])

    summed = rows.mapInArrow(run, schema).toDF(*keys, "n", "bw")
    each = summed.select(*keys, F.posexplode(F.arrays_zip("n", "bw")).alias("rep", "s")).select(*keys, "rep", "s.*")
    return each.groupBy(*keys, "rep").agg(F.sum("n").alias("n"), F.sum("bw").alias("bw"))


def auc_segments(pred: DataFrame, probs: Sequence[str], group: Sequence[str], y: str, row_key: str | None,
                 weights: Callable[[np.ndarray], np.ndarray] | None) -> DataFrame:
    """Per (group, a, b): ordered segments of scores with arrays p (weight of class a), n (of class b) and u (the
    Mann-Whitney sum within the segment).  ``inside`` is 0 for a single score, 1 for what lies between two.

    Without ``weights`` every row counts once, and rows of one score are counted before they are shuffled.
    """
    k, names = len(probs), [f"g{i}" for i in range(len(group))]
    score = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.col(c).cast("double").alias("score"))
                                for a, c in enumerate(probs)]))
    base = [*[F.col(g).alias(n) for g, n in zip(group, names)], F.col(y).cast("int").alias("y")]
    if weights is None:
        long = (pred.select(*base, score.alias("s")).select(*names, "y", "s.*")
                .groupBy(*names, "a", "score", "y").agg(F.count("*").alias("row_key")))
    else:
        long = pred.select(*base, F.col(row_key).cast("bigint").alias("row_key"), score.alias("s")).select(
            *names, "y", "row_key", "s.*")
    long = long.select(*names, "a", "score", "y", "row_key").filter(
        F.col("score").isNotNull() & F.col("y").between(0, k - 1))
    parts = int(pred.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*names, "a", "score"]
    # the row key among the bounds lets a frequent score span partitions
    ordered = long.repartitionByRange(parts, *order, "row_key").sortWithinPartitions(*order)
    vector = T.ArrayType(T.DoubleType())
    schema = T.StructType([*[long.schema[n] for n in names], T.StructField("a", T.IntegerType()),
                           T.StructField("b", T.IntegerType()), T.StructField("score", T.DoubleType()),
                           T.StructField("inside", T.IntegerType()),
                           *[T.StructField(c, vector) for c in ("p", "n", "u")]])
    step = BATCH if weights is None else max(1, BATCH // 8)

    def by_score(score, cls, row_key) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (score, class), in order, and the sum of their weights (one line each)."""
        order = np.lexsort((cls, score))
        score, cls, row_key = score[order], cls[order], row_key[order]
        w = row_key.astype(np.float64)[:, None] if weights is None else weights(row_key)
        first = np.flatnonzero(np.concatenate(([True], (score[1:] != score[:-1]) | (cls[1:] != cls[:-1]))))
        if len(first) == len(score):
            return score, cls, w
        return score[first], cls[first], np.add.reduceat(w, first, axis=0)

    class Stretch:
        """The scores of one (group, a) in this partition, in order: the lowest and the highest so far, each with its
        weights per class, and the sums of those between them."""

        def __init__(self, key):
            self.key, self.low, self.high, self.total, self.u = key, None, None, None, None

        def add(self, score, cls, w):
            if self.low is None:
                zero = np.zeros((k, w.shape[1]))
                self.low, self.total, self.u = (score[0], zero), zero.copy(), zero.copy()
            last = self.high or self.low
            known = np.searchsorted(score, last[0], side="right")       # rows of the last score
            last[1][cls[:known]] += w[:known]
            if known == len(score):
                return
            if self.high is not None:
                self.between(*self.high)
            top = np.searchsorted(score, score[-1], side="left")
            if known < top:
                self.inner(score[known:top], cls[known:top], w[known:top])
            self.high = (score[-1], np.zeros_like(self.total))
            self.high[1][cls[top:]] = w[top:]

        def between(self, score, each):
            """One score's weights join the sums."""
            self.u += each[self.key[-1]] * (self.total + 0.5 * each)
            self.total += each

        def inner(self, score, cls, w):
            """So do those of ascending scores."""
            mine = cls == self.key[-1]
            own, score_own = w[mine], score[mine]
            for b in range(k):
                if b == self.key[-1]:
                    continue
                at = np.flatnonzero(cls == b)
                if not len(at):
                    self.u[b] += own.sum(0) * self.total[b]
                    continue
                sums = np.concatenate((self.total[[b]], w[at]))
                np.cumsum(sums, axis=0, out=sums)
                if len(own):
                    below = np.searchsorted(score[at], score_own, side="left")
                    upto = np.searchsorted(score[at], score_own, side="right")
                    if np.array_equal(below, upto):
                        self.u[b] += np.einsum("ij,ij->j", own, sums[below])
                    else:
                        self.u[b] += 0.5 * np.einsum("ij,ij->j", own, sums[below] + sums[upto])
                self.total[b] = sums[-1]
            self.total[self.key[-1]] += own.sum(0)

        def rows(self):
            a, zero = self.key[-1], np.zeros_like(self.total)
            found = [(self.low, 0, zero)]
            if self.high is not None:
                found += [((self.low[0], self.total), 1, self.u), (self.high, 0, zero)]
            for (s, w), inside, u in found:
                for b in range(k):
                    if b != a:
                        yield (*self.key, b, float(s), inside, w[a].tolist(), w[b].tolist(), u[b].tolist())

    def run(batches):
        def block(stretch):
            return pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*stretch.rows()), fields)],
                                              names=schema.names)

        now, fields = None, None
        for whole in batches:
            if fields is None:
                fields = [*[whole.schema.field(n).type for n in names], pa.int32(), pa.int32(), pa.float64(), pa.int32(),
                          *[pa.list_(pa.float64())] * 3]
            codes = [whole.column(n).dictionary_encode(null_encoding="encode").indices.to_numpy() for n in names]
            codes.append(whole.column("a").to_numpy())
            score, cls = whole.column("score").to_numpy(), whole.column("y").to_numpy()
            row_key = whole.column("row_key").fill_null(0).to_numpy()
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1
            for i, j in zip([0, *cut], [*cut, whole.num_rows]):
                if i == j:
                    continue
                key = tuple(whole.column(n)[int(i)].as_py() for n in (*names, "a"))
                if now is None or now.key != key:
                    if now is not None:
                        yield block(now)
                    now = Stretch(key)
                for at in range(i, j, step):
                    to = min(j, at + step)
                    now.add(*by_score(score[at:to], cls[at:to], row_key[at:to]))
        if now is not None:
            yield block(now)

    out = ordered.mapInArrow(run, schema)
    return out.toDF(*group, "a", "b", "score", "inside", "p", "n", "u")


def auc_pairs(segments: DataFrame, group: Sequence[str]) -> DataFrame:
    """group..., a, b, rep, auc (null where a class has no weight) from segments; one row per replicate."""
    pair = [*group, "a", "b", "rep"]
    each = segments.select(*group, "a", "b", "score", "inside", F.posexplode(F.arrays_zip("p", "n", "u")).alias("rep", "s"))
    merged = (each.select(*pair, "score", "inside", "s.*").groupBy(*pair, "score", "inside")
              .agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum("u").alias("u"))
              .withColumn("u", F.when(F.col("inside") == 1, F.col("u")).otherwise(0.5 * F.col("p") * F.col("n"))))
    below = Window.partitionBy(*pair).orderBy("score", "inside").rowsBetween(Window.unboundedPreceding, -1)
    sums = (merged.withColumn("below", F.coalesce(F.sum("n").over(below), F.lit(0.0))).groupBy(*pair)
            .agg(F.sum(F.col("u") + F.col("p") * F.col("below")).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n")))
    whole = F.col("p") * F.col("n")
    return sums.select(*pair, F.when(whole > 0, F.col("u") / whole).alias("auc"))


def auc_replicates(pred: DataFrame, probs: Sequence[str], group: Sequence[str], y: str, row_key: str,
                   weights: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """group..., rep, auc_ovo_macro: the mean over class pairs; null (a failed resample) where a pair lost a class that
    other replicates have."""
    pairs = auc_pairs(auc_segments(pred, probs, group, y, row_key, weights), group)
    per = pairs.groupBy(*group, "rep").agg(F.avg("auc").alias("auc"), F.count("auc").alias("defined"))
    most = Window.partitionBy(*group)           # one row per replicate
    return (per.withColumn("pairs", F.max("defined").over(most))
            .select(*group, "rep", F.when(F.col("defined") == F.col("pairs"), F.col("auc")).alias("auc_ovo_macro")))
