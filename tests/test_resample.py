"""Interval estimates: replicate weights, distributed Mann-Whitney sums and their replicates against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenlens.operators import metrics as M
from screenlens.operators import resample as R

PROBS = ["p0", "p1", "p2"]


def table(spark, n, seed, hot=0.0):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        p = [0.25, 0.25, 0.5] if r.random() < hot else [r.randint(0, 12) / 16 for _ in range(3)]
        rows.append((r.choice(["m", "k", None]), r.choice([i, i * 2_654_435_761, -i]), r.choice([0, 0, 1, 2]),
                     r.randint(0, 2), *p))
    rows += [("m", 1, 5, 0, 0.5, 0.5, 0.0), ("m", 2, None, 0, 0.5, 0.5, 0.0), ("m", 3, 1, 0, None, None, None)]
    return rows, spark.createDataFrame(rows, "model string, row_id long, y int, p int, p0 double, p1 double, p2 double")


def auc_brute(rows, weight):
    out = []
    for a in range(3):
        for b in range(3):
            pos = [(r[4 + a], weight(r)) for r in rows if r[2] == a and r[4 + a] is not None]
            neg = [(r[4 + a], weight(r)) for r in rows if r[2] == b and r[4 + a] is not None]
            total = sum(w for _, w in pos) * sum(w for _, w in neg)
            if a != b:
                out.append(sum(v * w * ((s > t) + 0.5 * (s == t)) for s, v in pos for t, w in neg) / total
                           if total else None)
    return out


def weights_of(spark, keys, replicates, seed=42):
    df = spark.createDataFrame([(int(k),) for k in keys], "k long").select(
        "k", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    df = M.with_mix_uniform(df, F.col("k"), F.col("rep"), "u", seed)
    return {(r["k"], r["rep"]): r["w"] for r in df.withColumn("w", M.poisson_weight(F.col("u"))).collect()}


def test_weights_equal_the_column_form(spark):
    keys = [0, 1, -1, 2**31 - 2, 2**31 - 1, 2**31, -2**31, 2**62, -2**62, 123456789012]
    expected = weights_of(spark, keys, 40)
    found = R.weight_maker(40, 42, M.poisson_thresholds())(np.array(keys, np.int64))
    assert all(found[i, j] == expected[k, j] for i, k in enumerate(keys) for j in range(40))


@pytest.mark.parametrize("partitions,hot", [(1, 0.0), (3, 0.5), (40, 0.9)])
def test_auc_over_any_partitions(spark, partitions, hot):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        rows, df = table(spark, 300, partitions, hot)
        found = {r["model"]: r["auc_ovo_macro"] for r in M.auc_ovo(df, PROBS).collect()}
        replicates = 5
        weights = R.weight_maker(replicates, 42, M.poisson_thresholds())
        pairs = R.auc_pairs(R.auc_segments(df, PROBS, ["model"], "y", "row_id", weights), ["model"]).collect()
        each = {(r["model"], r["rep"], r["a"], r["b"]): r["auc"] for r in pairs}
        w = weights_of(spark, {r[1] for r in rows}, replicates)
        for model in ("m", "k", None):
            mine = [r for r in rows if r[0] == model]
            values = auc_brute(mine, lambda r: 1)
            assert found[model] == pytest.approx(sum(values) / 6, abs=1e-12)
            for rep in range(replicates):
                expected = auc_brute(mine, lambda r: w[r[1], rep])
                got = [each[model, rep, a, b] for a in range(3) for b in range(3) if a != b]
                assert got == pytest.approx(expected, abs=1e-12)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_scores_longer_than_a_batch(spark, monkeypatch):
    """Stretches that go on over many batches, with ties across their borders."""
    monkeypatch.setattr(R, "BATCH", 7)
    rows, df = table(spark, 200, 9, 0.3)
    found = {r["model"]: r["auc_ovo_macro"] for r in M.auc_ovo(df, PROBS).collect()}
    for model in ("m", "k", None):
        values = auc_brute([r for r in rows if r[0] == model], lambda r: 1)
        assert found[model] == pytest.approx(sum(values) / 6, abs=1e-12)


def test_replicate_cells(spark):
    rows, df = table(spark, 120, 3)
    weights = R.weight_maker(6, 42, M.poisson_thresholds())
    w = weights_of(spark, {r[1] for r in rows}, 6)
    found = {(r["model"], r["y"], r["p"], r["rep"]): (r["n"], r["bw"]) for r in R.replicate_cells(
        df, ["model"], "y", "p", F.coalesce(F.col("p0"), F.lit(0.0)), "row_id", weights).collect()}
    expected = {}
    for r in rows:
        for rep in range(6):
            n, v = expected.get((r[0], r[2], r[3], rep), (0, 0.0))
            expected[r[0], r[2], r[3], rep] = n + w[r[1], rep], v + w[r[1], rep] * (r[4] or 0.0)
    assert found.keys() == expected.keys()
    assert all(found[k] == pytest.approx(expected[k], abs=1e-12) for k in expected)


def test_all_ten_metrics_have_bounds(spark):
    _, df = table(spark, 400, 4)
    df = df.filter("model is not null and y between 0 and 2 and p0 is not null")
    out = M.bootstrap_ci(df, PROBS, replicates=60).collect()
    assert {r["metric"] for r in out} == set(M.ALL_METRICS) and len(out) == 20
    for r in out:
        assert r["lo"] < r["boot_mean"] < r["hi"] and r["n_replicates"] == 60


def test_failed_resamples_are_skipped(spark):
    """One row of a class: replicates that give it no weight have no AUC and are not counted."""
    rows = [("m", i, i % 2, i % 2, 0.1 * (i % 7), 0.05 * (i % 11), 0.2) for i in range(30)] + [("m", 99, 2, 2, 0.1, 0.1, 0.8)]
    df = spark.createDataFrame(rows, "model string, row_id long, y int, p int, p0 double, p1 double, p2 double")
    w = weights_of(spark, [99], 50)
    out = {r["metric"]: r["n_replicates"] for r in M.bootstrap_ci(df, PROBS, replicates=50).collect()}
    assert out["auc_ovo_macro"] == sum(w[99, rep] > 0 for rep in range(50)) < out["accuracy"] == 50


def test_no_window_over_the_scores_of_a_pair(spark):
    """Scores are range-partitioned and sorted; the only window orders segments of one replicate."""
    _, df = table(spark, 50, 1)
    plan = M.auc_ovo(df, PROBS)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and plan.index("MapInArrow") > plan.index("Window ")


def test_empty(spark):
    _, df = table(spark, 1, 1)
    assert M.auc_ovo(df.limit(0), PROBS).count() == 0
    assert M.bootstrap_ci(df.limit(0), PROBS, replicates=3).count() == 0
