"""Fitted models and the served bundle: reload equals fit, documents reach every text."""

import os

import pytest
from pyspark.sql import functions as F

from screenlens import constants as C
from screenlens.operators import models as MD
from screenlens.plans import q_fitted
from screenlens.plans.registry import all_queries


@pytest.fixture(scope="module")
def fitted(spark, sf, tmp_path_factory):
    train = q_fitted.labelled(spark, sf).where("split = 'train'")
    columns = (q_fitted.NUMERIC, q_fitted.CATEGORICAL, q_fitted.MONTHS)
    folder = str(tmp_path_factory.mktemp("models"))
    first = MD.fit_or_load(lambda: train, spark, folder, *columns, names=["logistic", "bayes"], **q_fitted.SEARCH)
    again = MD.fit_or_load(lambda: pytest.fail("trained twice"), spark, folder, *columns)
    return first, again, folder


def test_reload_gives_equal_predictions(spark, sf, fitted):
    first, again, folder = fitted
    assert set(first) == set(again) == {"logistic", "bayes"} and os.path.isdir(f"{folder}/logistic")
    test = q_fitted.labelled(spark, sf).where("split = 'test'").orderBy("record_id").limit(60)
    for name in first:
        rows = [MD.predict(test, m[name][0], "record_id", "y").orderBy("record_id").collect() for m in (first, again)]
        assert rows[0] == rows[1] and len(rows[0]) == 60
        for r in rows[0]:
            p = [r["p0"], r["p1"], r["p2"]]
            assert abs(sum(p) - 1) < 1e-9 and r["p"] == p.index(max(p))


def test_linear_attributions_follow_the_coefficients(spark, sf, fitted):
    model = fitted[0]["logistic"][0]
    test = q_fitted.labelled(spark, sf).where("split = 'test'").orderBy("record_id").limit(20)
    names, coef = model.feature_names(), model.pipeline.stages[-1].coefficientMatrix.toArray()
    assert len(names) == coef.shape[1]
    z = {r["record_id"]: r["features"].toArray() for r in model.transform(test, keep_features=True).collect()}
    for r in MD.linear_top_features(test, model, "record_id").collect():
        parts = coef[r["predicted"]] * z[r["record_id"]]
        assert len(r["top"]) == C.TOP_ATTRIBUTIONS
        best = sorted(abs(parts), reverse=True)[: C.TOP_ATTRIBUTIONS]
        assert [abs(t["contribution"]) for t in r["top"]] == pytest.approx(best)
        assert all(t["contribution"] == pytest.approx(parts[names.index(t["feature"])]) for t in r["top"])


def test_bounded_sample(spark):
    df = spark.range(5000)
    picked = MD.bounded_sample(df, "id", 100)
    assert picked.count() == 100 and MD.bounded_sample(df, "id", 5000).count() == 5000
    assert {r["id"] for r in picked.collect()} == {r["id"] for r in MD.bounded_sample(df.repartition(7), "id", 100).collect()}


def test_documents_reach_advice_report_and_prompt(spark, sf):
    served = all_queries()["serve_records"](spark, sf)
    with_docs = served.where(F.size("document_ids") > 0).limit(5).collect()
    assert with_docs and served.count() == all_queries()["score_records"](spark, sf).count()
    for r in with_docs:
        assert C.NO_REFERENCES not in r["advice_text"] and C.PROMPT_NO_DOCS not in r["user_prompt"]
        assert " | " in r["report"].split(C.REPORT_SECTIONS[3])[1]
    for r in served.where(F.size("document_ids") == 0).limit(3).collect():
        assert C.NO_REFERENCES in r["advice_text"]
