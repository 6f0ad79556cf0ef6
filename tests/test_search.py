"""Population search (folds, ranges, resuming) and the two boosting loops, checked by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from screenlens.operators import boosting as B
from screenlens.operators import models as MD
from screenlens.operators import search as SE

SPACE = {"x": SE.Range(0.001, 10.0, log=True), "n": SE.Range(1, 9, whole=True), "k": SE.Choice(("a", "b"))}


def test_draws_stay_in_their_ranges():
    rng = random.Random(3)
    members = SE.first_members(SPACE, 50, rng)
    for _ in range(5):
        members = SE.children(members, 50, SPACE, rng)
        assert all(0.001 <= m["x"] <= 10.0 and m["n"] in range(1, 10) and m["k"] in "ab" for m in members)
    assert {m["k"] for m in members} <= {"a", "b"} and SE.first_members({}, 5, rng) == [{}]
    assert set(MD.candidates()["logistic"].space["elasticNetParam"].values) == {0.0, 1.0}     # L2 and L1


class Counter:
    """A stand-in for fitting: counts fits, and stops the search after ``stop`` of them."""

    def __init__(self, stop=None):
        self.fits, self.stop, self.folds = 0, stop, set()

    def fit(self, rows, params):
        self.fits += 1
        if self.stop is not None and self.fits > self.stop:
            raise KeyboardInterrupt
        held = {r["fold"] for r in rows.select("fold").distinct().collect()}
        self.folds.add(frozenset(held))
        return lambda valid: (params, valid)

    @staticmethod
    def score(predicted):
        params, valid = predicted
        return -abs(math.log10(params["x"])) + (params["k"] == "b") + valid.count() / 1000


def run(spark, counter, trials=None):
    data = spark.range(40).withColumn("fold", SE.fold_column(["id"])).cache()
    return SE.search("m", SPACE, data, counter.fit, counter.score, trials, population=4, generations=3, seed=7)


def test_five_folds_and_a_better_score_each_generation(spark):
    counter = Counter()
    best, value, trials = run(spark, counter)
    assert counter.fits == 5 * len(trials) and len(trials) >= 4
    assert counter.folds == {frozenset(range(5)) - {i} for i in range(5)}
    assert value == max(sum(s) / 5 if isinstance(s, list) else s for _, s, _ in trials) and best["k"] == "b"


def test_a_stopped_search_goes_on(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SE, "PARALLEL", 1)
    whole = Counter()
    expected = run(spark, whole)[:2]
    stopped = Counter(stop=whole.fits - 3)          # within the last generation
    with pytest.raises(KeyboardInterrupt):
        run(spark, stopped, SE.TrialTable(spark, str(tmp_path / "trials")))
    kept = len(SE.TrialTable(spark, str(tmp_path / "trials")).finished("m"))
    assert kept >= 4
    resumed = Counter()
    assert run(spark, resumed, SE.TrialTable(spark, str(tmp_path / "trials")))[:2] == expected
    assert resumed.fits == whole.fits - 5 * kept    # finished members came from the table
    again = Counter()
    assert run(spark, again, SE.TrialTable(spark, str(tmp_path / "trials")))[:2] == expected and again.fits == 0


@pytest.fixture(scope="module")
def points(spark):
    r = random.Random(2)
    rows = [(float(i % 3 if r.random() < 0.7 else r.randint(0, 2)), Vectors.dense([float(i % 3), r.random()]))
            for i in range(90)]
    return spark.createDataFrame(rows, ["y", "features"]).coalesce(2)


def test_samme_rounds_by_hand(spark, points):
    stages, weights = B.samme(points, 3, rounds=2, max_depth=1)
    rows = PipelineModel(stages).transform(points).collect()
    y = np.array([r["y"] for r in rows])
    w = np.ones(len(y))
    for t, weight in enumerate(weights):
        missed = np.array([r[f"mx_p{t}"] for r in rows]) != y
        error = w[missed].sum() / w.sum()
        assert weight == pytest.approx(math.log((1 - error) / error) + math.log(2), abs=1e-9)
        w = w * np.exp(weight * missed)
    for r in rows:
        votes = np.array([sum(a for t, a in enumerate(weights) if r[f"mx_p{t}"] == k) for k in range(3)]) / 2
        odds = np.exp(votes) / np.exp(votes).sum()
        assert r[B.ODDS] == pytest.approx(odds.tolist()) and r["prediction"] == int(np.argmax(odds))


def test_samme_stops_at_a_perfect_tree(spark):
    rows = spark.createDataFrame([(float(i % 2), Vectors.dense([float(i % 2)])) for i in range(20)], ["y", "features"])
    stages, weights = B.samme(rows, 2, rounds=5, max_depth=1)
    assert len(weights) == 1 and len(stages) == 2
    assert PipelineModel(stages).transform(rows).where(F.col("prediction") != F.col("y")).count() == 0


def test_softmax_boosting_by_hand(spark):
    """Two leaves: the first round's answers are the mean residuals of each leaf, the second's follow from them."""
    y = [0] * 6 + [1] * 2 + [1] * 3 + [2] * 5
    x = [0.0] * 8 + [1.0] * 8
    rows = spark.createDataFrame([(float(a), Vectors.dense([b])) for a, b in zip(y, x)], ["y", "features"]).coalesce(1)
    stages, start = B.softmax_boosting(rows, 3, rounds=2, max_depth=1, rate=0.5)
    shares = np.array([6, 5, 5]) / 16
    assert start == pytest.approx(np.log(shares).tolist())
    expected = {}
    for leaf, counts in ((0.0, [6, 2, 0]), (1.0, [0, 3, 5])):
        score = np.log(shares)
        for _ in range(2):
            p = np.exp(score) / np.exp(score).sum()
            score = score + 0.5 * (np.array(counts) / 8 - p)
        expected[leaf] = np.exp(score) / np.exp(score).sum()
    for r in PipelineModel(stages).transform(rows).collect():
        assert r[B.ODDS] == pytest.approx(expected[r["features"][0]].tolist())
        assert r["prediction"] == int(np.argmax(expected[r["features"][0]]))


def test_ensembles_are_saved_and_reloaded(spark, points, tmp_path):
    for stages, _ in (B.samme(points, 3, rounds=3), B.softmax_boosting(points, 3, rounds=2)):
        model = PipelineModel(stages)
        folder = str(tmp_path / f"e{len(stages)}")
        model.write().save(folder)
        first, again = (sorted(map(str, m.transform(points).select("y", B.ODDS, "prediction").collect()))
                        for m in (model, PipelineModel.load(folder)))
        assert first == again
