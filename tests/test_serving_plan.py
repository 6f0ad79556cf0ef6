"""The frozen feature plan: literal rows, storage, wide schemas, and one projection in the physical plan."""

import uuid

import pytest

from screenlens.operators import serving as SV
from screenlens.sources.tables import ensure_checkpoint_dir

TRAIN = [("1", "b", "正常", "x y"), ("2", "a", None, "x  y"), ("3", "b", "无", "z"), ("4", "é", "q", "w"), ("5", None, "Z", "")]
SCHEMA = "id string, c1 string, c2 string, c3 string"


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(TRAIN, SCHEMA)


def test_vocabulary_is_sorted_and_dense(spark, train):
    found = {(r["column_name"], r["value"]): r["code"] for r in SV.fit_vocabulary(train, ["c1", "c2", "c3"]).collect()}
    assert found == {("c1", "a"): 0, ("c1", "b"): 1, ("c1", "é"): 2, ("c2", "Z"): 0, ("c2", "q"): 1, ("c2", "无"): 2,
                     ("c2", "正常"): 3, ("c3", ""): 0, ("c3", "w"): 1, ("c3", "x y"): 2, ("c3", "z"): 3}


@pytest.mark.parametrize("inline", [0, 3, 64])
def test_transform(spark, train, inline):
    """Exact code, first fallback (无 before 正常, '' for c3), 0 without fallback; the same by projection or by join."""
    plan, vocabulary = SV.fit_plan(train, ["n"], ["c1", "c2", "c3", "raw", "gone"], encoded=["c1", "c2", "c3"],
                                   fills={"n": "7", "c1": "b"}, hazard_column="h", hazard_tokens=["p", "q"],
                                   inline_values=inline)
    assert plan.joined == {0: ["c1", "c2", "c3"], 3: ["c2", "c3"], 64: []}[inline]
    rows = [("r1", " 1.5 ", "a", "q", "x\t y", "2.5", "p, q"), ("r2", None, None, None, None, None, None),
            ("r3", "abc", "new", "new", "new", "abc", "pq,"), ("r4", "1e2", "é", "无", "", "-3", "q")]
    arriving = spark.createDataFrame(rows, "id string, n string, c1 string, c2 string, c3 string, raw string, h string")
    out = SV.transform(arriving, SV.FeaturePlan.from_json(plan.to_json()), ["id"], vocabulary)
    assert out.columns == ["id", *plan.features]
    assert sorted(map(tuple, out.collect())) == [
        ("r1", 1.5, 0.0, 1.0, 2.0, 2.5, 0.0, 1.0, 1.0), ("r2", 7.0, 1.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0),
        ("r3", 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0), ("r4", 100.0, 2.0, 2.0, 0.0, -3.0, 0.0, 0.0, 1.0)]
    # a table without any of the columns gets the defaults
    bare = SV.transform(arriving.select("id"), plan, ["id"], vocabulary).first()
    assert tuple(bare)[1:] == (0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    assert SV.transform(arriving.limit(0), plan, ["id"], vocabulary).count() == 0


def test_projection_only(spark, train):
    plan, _ = SV.fit_plan(train, [], ["c1", "c2"])
    text = SV.transform(train, plan, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert not any(x in text for x in ("Exchange", "Expand", "Generate", "Join", "Aggregate"))


def test_wide_schema(spark):
    wide = spark.range(20).selectExpr("id", *[f"cast(id % {2 + i % 5} as string) as c{i}" for i in range(1500)])
    numeric, categorical = [f"c{i}" for i in range(0, 1500, 2)], [f"c{i}" for i in range(1, 1500, 2)]
    plan, vocabulary = SV.fit_plan(wide, numeric, categorical)
    rows = SV.transform(wide, plan, ["id"], vocabulary).collect()
    assert len(rows) == 20 and plan.features == [*numeric, *categorical]
    assert all(r[f"c{i}"] == r["id"] % (2 + i % 5) for r in rows for i in range(0, 1500, 77))


def test_stored_bundle(spark, train):
    folder = f"{ensure_checkpoint_dir(spark)}/bundle-{uuid.uuid4().hex}"
    assert SV.load_artefacts(spark, folder) is None
    plan, vocabulary = SV.fit_plan(train, ["n"], ["c1"], inline_values=1)
    split = train.selectExpr("id", "0 as y", "if(id < 4, 'train', 'test') as split")
    SV.save_artefacts(spark, folder, plan, vocabulary, split, {"n": (3.0, 1.5)})
    kept = SV.load_artefacts(spark, folder)
    assert kept.plan == plan and sorted(map(tuple, kept.vocabulary.collect())) == sorted(map(tuple, vocabulary.collect()))
    assert {(r["id"], r["split"]) for r in kept.split.collect()} == {(r[0], "train" if r[0] < "4" else "test") for r in TRAIN}
    assert [tuple(r) for r in kept.scaler.collect()] == [("n", 3.0, 1.5)]
    assert [tuple(r) for r in kept.features.collect()] == [(0, "n", "numeric"), (1, "c1", "categorical")]
    assert sorted(map(tuple, kept.transform(train, ["id"]).select("c1").collect())) == [(0.0,), (0.0,), (1.0,), (1.0,), (2.0,)]
