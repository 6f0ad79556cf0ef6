"""Draws that top classes up: literal sizes, and no array per class in the plan."""

import pytest

from screenlens.operators import features as FE


@pytest.mark.parametrize("sizes", [{1: 5, 2: 2, 3: 5, 4: 1}, {0: 3}, {}, {7: 1, -1: 40_000}])
def test_every_class_reaches_the_largest(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "label long, n long")
    found = sorted(tuple(r) for r in FE.oversampling_draws(df).collect())
    most = max(sizes.values(), default=0)
    assert found == sorted((c, n, j) for c, n in sizes.items() for j in range(most - n))


def test_no_array_per_class(spark):
    df = spark.createDataFrame([(1, 10), (2, 3)], "label long, n long")
    plan = FE.oversampling_draws(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (0, 7" in plan and "sequence" not in plan and "Generate" not in plan
