"""Semantics traps and operator properties on small inline tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from screenlens import constants as C
from screenlens.functions import text as T
from screenlens.functions.findings import rule_hit_tag
from screenlens.operators import features as FE
from screenlens.operators import ids
from screenlens.operators import metrics as M
from screenlens.operators import prep as P
from screenlens.operators import store as ST
from screenlens.operators.retrieval import query_variants


def _one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("raw,months,valid", [("2年3月", 27, True), ("3年", 0, False), ("", 0, False),
                                              (None, 0, False), ("x2年3月", 0, False)])
def test_duration_months(spark, raw, months, valid):
    lit = F.lit(raw).cast("string")
    assert _one(spark, T.duration_months(lit)) == months
    assert _one(spark, T.duration_valid(lit)) is valid


@pytest.mark.parametrize("raw,expected", [("１２", 12.0), ("160 mmHg", 160.0), ("未检", 0.0), ("-3.5x", -3.5),
                                          (None, 0.0), ("1e5", 1.0)])
def test_safe_float(spark, raw, expected):
    assert _one(spark, T.safe_float(F.lit(raw).cast("string"))) == expected


def test_strict_numeric_rejects_suffixes_and_nan(spark):
    vals = ["12", " 7.5 ", "12d", "1f", "nan", "inf", "0x1p3", ".5", "1e3"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r["d"] for r in df.select(T.strict_double(F.col("v")).alias("d")).collect()]
    assert got == [12.0, 7.5, None, None, None, None, None, 0.5, 1000.0]


def test_whitespace_includes_ideographic_space(spark):
    assert _one(spark, T.norm_ws(F.lit("　肺功能　 正常 "))) == "肺功能 正常"


@pytest.mark.parametrize("compat,expected", [(False, 0), (True, 1)])
def test_binary_flag_null(spark, compat, expected):
    df = spark.createDataFrame([(None,)], "x string")
    assert P.binary_flags(df, ["x"], compat=compat).first()["x"] == expected


def test_keyword_search_is_literal_by_default(spark):
    df = spark.createDataFrame([(1, "a%b"), (2, "axb")], "id long, t string")
    got = ST.search(df, keyword="a%b", keyword_columns=["t"], select=["id"]).collect()
    assert [r["id"] for r in got] == ["1"]
    compat = ST.search(df, keyword="a%b", keyword_columns=["t"], select=["id"], compat=True).collect()
    assert sorted(r["id"] for r in compat) == ["1", "2"]


def test_rule_hit_tag_prefix_excludes_miss(spark):
    df = spark.createDataFrame([("expert_system", "r1"), ("expert_system", ""), ("heuristic_fallback", None)],
                               "s string, r string").select(rule_hit_tag(F.col("s"), F.col("r")).alias("tag"))
    tags = [r["tag"] for r in df.collect()]
    assert tags == ["命中 r1", "命中", "未命中"]
    assert [t for t in tags if t.startswith(C.RULE_HIT)] == ["命中 r1", "命中"]


def test_query_variants_keep_decimals(spark):
    v = _one(spark, query_variants(F.lit("血糖 6.1 偏高；复查. 随访")))
    assert v == ["血糖 6.1 偏高；复查. 随访", "血糖 6.1 偏高", "复查", "随访"]
    compat = _one(spark, query_variants(F.lit("血糖 6.1 偏高"), compat=True))
    assert compat == ["血糖 6.1 偏高", "血糖 6", "1 偏高"]


def test_append_ids_dense_under_skew(spark):
    rows = [(i, "hot" if i % 3 else f"k{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "rid long, k string")
    out = ids.append_ids(df, ["k", "rid"], 41).collect()
    assert sorted(r["id"] for r in out) == list(range(42, 342))
    ordered = sorted(out, key=lambda r: (r["k"], r["rid"]))
    assert [r["id"] for r in ordered] == list(range(42, 342))


def test_stratified_split_exact_shares(spark):
    rows = [(i, 0 if i < 700 else (1 if i < 900 else 2)) for i in range(1000)]
    out = FE.stratified_split(spark.createDataFrame(rows, "rid long, y int"), "y", "rid").collect()
    tests = {y: sum(1 for r in out if r["y"] == y and r["split"] == "test") for y in (0, 1, 2)}
    assert tests == {0: 210, 1: 60, 2: 30}


def test_cell_metrics_and_auc_against_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(300):
        y = rnd.randrange(3)
        a, b, d = rnd.randint(1, 6) + (3 if y == 0 else 0), rnd.randint(1, 6) + (3 if y == 1 else 0), rnd.randint(1, 6)
        s = a + b + d
        probs = [a / s, b / s, d / s]
        p = max(range(3), key=lambda k: (probs[k], -k))
        rows.append(("m", i, y, p, *probs))
    df = spark.createDataFrame(rows, "model string, row_id long, y int, p int, p0 double, p1 double, p2 double")
    s = M.summary_metrics(M.class_table(M.confusion_cells(df))).first()
    acc = sum(r[2] == r[3] for r in rows) / len(rows)
    assert s["accuracy"] == pytest.approx(acc)

    def auc(a, b):
        pos = [r[4 + a] for r in rows if r[2] == a]
        neg = [r[4 + a] for r in rows if r[2] == b]
        tot = sum(1.0 if x > z else 0.5 if x == z else 0.0 for x, z in itertools.product(pos, neg))
        return tot / (len(pos) * len(neg))
    expected = sum(auc(a, b) for a in range(3) for b in range(3) if a != b) / 6
    got = M.auc_ovo(df, ["p0", "p1", "p2"]).first()["auc_ovo_macro"]
    assert got == pytest.approx(expected)


def test_bootstrap_bounds_contain_mean(spark, sf):
    from screenlens.sources import fixtures as X
    out = M.bootstrap_ci(X.pred(spark, sf), ["p0", "p1", "p2"], replicates=40).collect()
    for r in out:
        assert r["lo"] <= r["boot_mean"] <= r["hi"]
        assert r["n_replicates"] == 40


def test_prep_plan_roundtrip_and_idempotent(spark, sf):
    from screenlens.sources import fixtures as X
    df = X.exam(spark, sf)
    plan = P.fit_clean(df, privacy=["name"], unit_keywords=["unit"], other=[])
    again = P.PrepPlan.from_json(plan.to_json())
    assert again == plan
    once = P.apply_clean(df, plan)
    assert P.apply_clean(once, plan).columns == once.columns


def test_single_row_and_batch_scoring_agree(spark, sf):
    from screenlens.functions.rules import exam_rules
    from screenlens.operators.scoring import score_records
    from screenlens.sources import fixtures as X
    df = X.exam(spark, sf)
    batch = {r["record_id"]: (r["final"]["label"], r["query"])
             for r in score_records(df, exam_rules(), X.EXAM_FIELDS).collect()}
    some = df.orderBy("record_id").limit(3).collect()
    for row in some:
        single = spark.createDataFrame([row], df.schema)
        r = score_records(single, exam_rules(), X.EXAM_FIELDS).first()
        assert (r["final"]["label"], r["query"]) == batch[row["record_id"]]


def test_hazard_dummies_sum_bounded_by_tokens(spark):
    df = spark.createDataFrame([(1, "A,B,C"), (2, "A、B"), (3, None)], "rid long, e string")
    out = P.hazard_dummies(df, "e", ["A", "B", "C", "A、B"], drop_source=False).collect()
    for r in out:
        flags = sum(r[C.HAZARD_PREFIX + t] for t in ["A", "B", "C", "A、B"])
        assert flags <= len([t for t in (r["e"] or "").split(",") if t])
