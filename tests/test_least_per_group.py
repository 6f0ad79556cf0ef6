"""The first rows of a large group are picked in parts before they meet in one task."""

from screenlens.operators import profile as PR


def test_exact_and_dealt(spark):
    rows = [("ab"[i % 10 == 0], i * 7919 % 10007 % 500, i) for i in range(5000)] + [(None, 1, None)] * 3
    df = spark.createDataFrame(rows, "model string, h long, row_id long")
    out = PR.least_per_group(df, ["model"], ["h", "row_id"], 1200)
    found = [tuple(r) for r in out.collect()]
    for m in ("a", "b"):
        first = sorted((r for r in rows if r[0] == m), key=lambda r: r[1:])[:1200]
        assert sorted(r for r in found if r[0] == m) == sorted(first)
    assert found.count((None, 1, None)) == 3
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2 and "__part" in plan
