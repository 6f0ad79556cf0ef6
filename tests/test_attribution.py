"""Tree attributions against the Shapley definition: all subsets, walked through the tree."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from screenlens.operators import attribution
from screenlens.operators.attribution import (
    AdditiveTrees,
    additive_trees,
    mean_abs_contributions,
    tree_contributions,
)

FEATURES = 4


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(240, FEATURES)).round(2)
    x[:, 3] = rng.integers(0, 3, 240)
    y = (x[:, 0] * x[:, 1] > 0).astype(int) + ((x[:, 2] > 0.4) & (x[:, 3] > 0)).astype(int)
    data = [(i, float(c), Vectors.dense(v.tolist())) for i, (c, v) in enumerate(zip(y, x))]
    return spark.createDataFrame(data, ["id", "y", "features"]).cache()


def walked(tree, x, known):
    """The tree's answer with the features ``known``; a split on another feature takes both sides by weight."""
    leaves = {}

    def visit(i):
        node = tree.nodes[i]
        if node.left is None:
            return leaves[i]
        if node.feature in known:
            return visit(node.left if node.goes_left(x[None, :])[0] else node.right)
        left, right = tree.nodes[node.left].cover, tree.nodes[node.right].cover
        return (left * visit(node.left) + right * visit(node.right)) / (left + right)

    order = []
    stack = [0]
    while stack:                       # the leaves in the order in which the operator lists them
        i = stack.pop()
        node = tree.nodes[i]
        if node.left is None:
            order.append(i)
        else:
            stack += [node.left, node.right]
    for i, leaf in zip(order, tree.leaves):
        leaves[i] = leaf.answer
    return visit(0)


def by_subsets(ensemble, x):
    out = np.zeros((ensemble.outputs, FEATURES))
    for i in range(FEATURES):
        others = [f for f in range(FEATURES) if f != i]
        for size in range(FEATURES):
            weight = math.factorial(size) * math.factorial(FEATURES - size - 1) / math.factorial(FEATURES)
            for known in itertools.combinations(others, size):
                for tree in ensemble.trees:
                    out[:, i] += weight * (walked(tree, x, {*known, i}) - walked(tree, x, set(known)))
    return out


def classifier_models():
    return {
        "tree": DecisionTreeClassifier(labelCol="y", maxDepth=5, seed=1),
        "forest": RandomForestClassifier(labelCol="y", maxDepth=4, numTrees=5, seed=1),
    }


@pytest.mark.parametrize("name", ["tree", "forest"])
def test_classifiers_equal_the_definition_and_sum_to_the_probability(spark, rows, name):
    model = classifier_models()[name].fit(rows)
    ensemble = additive_trees(spark, model)
    got = tree_contributions(rows, ensemble, ["id"]).collect()
    truth = {r["id"]: r["p"] for r in model.transform(rows).select("id", vector_to_array("probability").alias("p")).collect()}
    x = {r["id"]: r["features"].toArray() for r in rows.collect()}
    assert len(got) == 240 * ensemble.outputs
    for r in got:
        assert r["output"] == pytest.approx(truth[r["id"]][r["cls"]], abs=1e-9)
        assert r["base"] + sum(r["contributions"]) == pytest.approx(r["output"], abs=1e-9)
    for i in range(0, 240, 17):
        expected = by_subsets(ensemble, x[i])
        for r in got:
            if r["id"] == i:
                assert np.allclose(r["contributions"], expected[r["cls"]], atol=1e-9)


def test_a_feature_met_twice_on_a_path_counts_once(spark, rows):
    model = DecisionTreeClassifier(labelCol="y", maxDepth=6, seed=1).fit(rows)
    ensemble = additive_trees(spark, model)
    assert any(len(edges) > 1 for leaf in ensemble.trees[0].leaves for _, edges in leaf.edges)


@pytest.mark.parametrize("make", [DecisionTreeRegressor, RandomForestRegressor])
def test_regressors_sum_to_the_prediction(spark, rows, make):
    model = make(labelCol="y", maxDepth=4, seed=2).fit(rows)
    ensemble = additive_trees(spark, model)
    truth = {r["id"]: r["prediction"] for r in model.transform(rows).collect()}
    for r in tree_contributions(rows, ensemble, ["id"]).collect():
        assert r["output"] == pytest.approx(truth[r["id"]], abs=1e-9)


def test_boosted_margins(spark, rows):
    binary = rows.where("y < 2")
    model = GBTClassifier(labelCol="y", maxDepth=3, maxIter=4, seed=3).fit(binary)
    ensemble = additive_trees(spark, model)
    truth = {r["id"]: r["m"][1] for r in model.transform(binary).select(
        "id", vector_to_array("rawPrediction").alias("m")).collect()}
    got = tree_contributions(binary, ensemble, ["id"]).collect()
    for r in got:
        assert r["output"] == pytest.approx(truth[r["id"]], abs=1e-9)
    x = {r["id"]: r["features"].toArray() for r in binary.collect()}
    for r in got[::40]:
        assert np.allclose(r["contributions"], by_subsets(ensemble, x[r["id"]])[0], atol=1e-9)


def test_one_against_the_rest_has_a_margin_per_class(spark, rows):
    model = OneVsRest(labelCol="y", classifier=GBTClassifier(labelCol="y", maxDepth=2, maxIter=2, seed=3)).fit(rows)
    ensemble = additive_trees(spark, model)
    assert ensemble.outputs == 3
    truth = {r["id"]: r["m"] for r in model.transform(rows).select("id", vector_to_array("rawPrediction").alias("m")).collect()}
    for r in tree_contributions(rows, ensemble, ["id"]).collect():
        assert r["output"] == pytest.approx(truth[r["id"]][r["cls"]], abs=1e-9)


def test_a_tree_of_one_leaf_and_null_features(spark, rows):
    model = DecisionTreeClassifier(labelCol="y", maxDepth=0).fit(rows)
    ensemble = additive_trees(spark, model)
    some = rows.limit(3).select("id", "features")
    some = some.unionByName(some.select((F.col("id") + 1000).alias("id"), F.lit(None).cast(
        some.schema["features"].dataType).alias("features")))
    got = tree_contributions(some, ensemble, ["id"]).collect()
    assert {tuple(r["contributions"]) for r in got if r["id"] < 1000} == {(0.0,) * FEATURES}
    empty = [r for r in got if r["id"] >= 1000]
    assert len(empty) == 3 and all(r["contributions"] is None and r["output"] is None for r in empty)


def test_no_shuffle_and_no_rows(spark, rows):
    ensemble = additive_trees(spark, classifier_models()["tree"].fit(rows))
    out = tree_contributions(rows, ensemble, ["id"])
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert tree_contributions(rows.where("id < 0"), ensemble, ["id"]).count() == 0


def test_mean_of_absolute_values(spark, rows):
    ensemble = additive_trees(spark, classifier_models()["tree"].fit(rows))
    parts = tree_contributions(rows, ensemble, ["id"])
    names = [f"f{i}" for i in range(FEATURES)]
    got = {(r["feature"], r["cls"]): r["mean_abs"] for r in mean_abs_contributions(parts, names).collect()}
    assert len(got) == FEATURES * ensemble.outputs
    one = [abs(r["contributions"][2]) for r in parts.where("cls = 1").collect()]
    assert got["f2", 1] == pytest.approx(sum(one) / len(one))


def test_other_models_are_refused(spark):
    with pytest.raises((TypeError, AttributeError)):
        additive_trees(spark, AdditiveTrees((), 1))


@pytest.mark.parametrize("bits", [0, 3, 11])
def test_leaves_scored_together_equal_leaves_scored_alone(spark, rows, monkeypatch, bits):
    monkeypatch.setattr(attribution, "GROUP_BITS", bits)
    x = np.array([r["features"].toArray() for r in rows.collect()])
    for model in (DecisionTreeClassifier(labelCol="y", maxDepth=0), *classifier_models().values(),
                  OneVsRest(labelCol="y", classifier=GBTClassifier(labelCol="y", maxDepth=3, maxIter=2, seed=3))):
        ensemble = additive_trees(spark, model.fit(rows))
        alone = ensemble.contributions(x)
        assert np.allclose(ensemble.answers(x), ensemble.base() + alone.sum(axis=2), atol=1e-12)
        own = ensemble.answers(x).argmax(axis=1)
        assert np.allclose(ensemble.contributions_to(x, own), alone[np.arange(len(x)), own], atol=1e-12)
        assert ensemble.contributions_to(x[:0], own[:0]).shape == (0, FEATURES)


def test_a_table_is_made_for_many_leaves(spark, rows, monkeypatch):
    """Work that is done for each row does not grow with the leaves of a small tree."""
    model = DecisionTreeClassifier(labelCol="y", maxDepth=3, seed=1).fit(rows)
    ensemble = additive_trees(spark, model)
    groups = [g for t in ensemble.trees for g in attribution._groups(t)]
    assert len(groups) == 1 and len(groups[0].leaves) == len(ensemble.trees[0].leaves) > 4


def test_top_features_of_rows_with_and_without_features(spark, rows):
    class Given:
        name, pipeline = "tree", type("P", (), {"stages": [classifier_models()["forest"].fit(rows)]})

        def transform(self, df, keep_features):
            return df

        def feature_names(self):
            return ["d", "c", "b", "a"]

    some = rows.select("id", F.when(F.col("id") % 7 > 0, F.col("features")).alias("features"))
    got = {r["id"]: r for r in attribution.tree_top_features(some, Given(), "id", 3).collect()}
    parts = {}
    for r in tree_contributions(rows, additive_trees(spark, Given.pipeline.stages[0]), ["id"]).collect():
        parts.setdefault(r["id"], []).append(r)
    assert set(got) == set(parts)
    for i, r in got.items():
        if i % 7 == 0:
            assert r["predicted"] is r["base"] is r["output"] is r["top"] is None
            continue
        best = max(parts[i], key=lambda p: (round(p["output"], 12), -p["cls"]))
        named = sorted(zip([-round(abs(c), 12) for c in best["contributions"]], "dcba", best["contributions"]))[:3]
        assert r["predicted"] == best["cls"] and r["output"] == pytest.approx(best["output"])
        assert r["base"] == pytest.approx(best["base"])
        assert [t["feature"] for t in r["top"]] == [f for _, f, _ in named]
        assert [t["contribution"] for t in r["top"]] == pytest.approx([c for _, _, c in named])
