"""Weights are drawn once for a key that several groups share; a card is computed once for its scaled form."""

import numpy as np
from pyspark.sql import functions as F

from screenlens.operators import features as FE
from screenlens.operators import metrics as M
from screenlens.operators import resample as R


def test_one_draw_for_a_key_in_all_groups(spark):
    rows = [(m, i, i % 3, (i + j) % 3, 0.1 * j) for i in range(300) for j, m in enumerate("abc")]
    df = spark.createDataFrame(rows, "model string, row_id long, y int, p int, v double").coalesce(1)
    drawn = R.weight_maker(4, 42, M.poisson_thresholds())

    def single(keys):
        assert len(np.unique(keys)) == len(keys)
        return drawn(keys)

    found = {(r["model"], r["y"], r["p"], r["rep"]): r["n"] for r in R.replicate_cells(
        df, ["model"], "y", "p", F.col("v"), "row_id", single).collect()}
    w = drawn(np.arange(300))
    for j, m in enumerate("abc"):
        for rep in range(4):
            assert found[m, 1, (1 + j) % 3, rep] == w[1::3, rep].sum()


def test_weights_at_the_ends_of_the_draws():
    """Thresholds met exactly, and none met."""
    keys = np.arange(5000) * 104_729
    u = R.weight_maker(3, 7, [0.0])(keys)
    assert u.min() == u.max() == 1 and R.weight_maker(3, 7, [1.0])(keys).max() == 0 and len(R.weight_maker(3, 7, [0.5])(keys[:0])) == 0


def test_the_card_is_read_once(spark):
    columns = {m: 0.1 for m in FE.C.RADAR_METRICS}
    rows = [("a", 1.0, *columns.values(), *columns.values(), *columns.values()), ("b", 2.0, *(v + 0.2 for v in columns.values()),
            *columns.values(), *columns.values())]
    names = ["model", "train_seconds", *columns, *[f"{m}_lo" for m in columns], *[f"{m}_hi" for m in columns]]
    card = spark.createDataFrame(rows, names).repartition(2)
    for made in (FE.radar(card), FE.ranking(card)):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert {(r["model"], r["value_scaled"]) for r in FE.radar(card).collect()} == {("a", 0.0), ("b", 1.0)}
    assert {r["model"]: r["time_share"] for r in FE.ranking(card).collect()} == {"a": 1 / 3, "b": 2 / 3}
