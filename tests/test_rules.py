"""Rule compiler: records with the rule and trace they must give, and properties of groups, traces and priority."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from screenlens.functions.rules import RuleSet, evaluate_rules

RULES = [
    {"id": "a", "priority": 5, "output_label": "L1", "diagnosis": "d1",
     "decision_tree": {"any": [{"field": "x", "operator": ">=", "value": 10},
                               {"all": [{"field": "m", "operator": "==", "value": "bad"},
                                        {"field": "x", "operator": ">", "value": 5}]}]}},
    {"id": "b", "priority": 5, "output_label": "L2", "diagnosis": "d2",
     "decision_tree": {"all": [{"field": "t", "operator": "contains_any", "value": ["dust", "noise"]},
                               {"field": "m", "operator": "not_empty"}]}},
    {"id": "c", "priority": 1, "output_label": "L3", "diagnosis": "d3",
     "decision_tree": {"all": [{"field": "x", "operator": "<", "value": 0}, {"field": "zz", "operator": "weird"}]}},
]

X10 = "x >= 10 | 当前值: "
M_BAD = "m == bad | 当前值: "
X5 = "x > 5 | 当前值: "
T_ANY = "t contains_any ['dust', 'noise'] | 当前值: "
M_SET = "m not_empty None | 当前值: "

# (x, m, t) -> rule, trace
CASES = [
    (("12", None, None), "a", [X10 + "12"]),
    (("10", "good", "dust"), "a", [X10 + "10"]),
    (("7.5", "bad", None), "a", [X10 + "7.5", M_BAD + "bad", X5 + "7.5"]),
    ((" 6 mmHg", " bad ", None), "a", [X10 + " 6 mmHg", M_BAD + " bad ", X5 + " 6 mmHg"]),
    (("１２", "", ""), "a", [X10 + "１２"]),
    (("5", "bad", None), None, None),
    (("7.5", "b a d", None), None, None),
    (("nan", "good", "dust,noise"), "b", [T_ANY + "dust,noise", M_SET + "good"]),
    ((None, "x", "　noise"), "b", [T_ANY + "　noise", M_SET + "x"]),
    ((None, "", "dusty"), None, None),
    ((None, "None", "dusty"), None, None),
    ((None, None, "heat"), None, None),
    (("-3", None, None), None, None),           # the unknown operator is never true
    (("abc", "good", "heat"), None, None),
]


def hits(spark, rules, records):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(records)], "rid int, x string, m string, t string")
    return [r["rule_hit"] for r in evaluate_rules(df, RuleSet.load(rules)).orderBy("rid").collect()]


def test_cases(spark):
    found = hits(spark, RULES, [c[0] for c in CASES])
    for (record, rule, trace), hit in zip(CASES, found):
        assert (hit["rule_id"] if hit else None) == rule, record
        if rule:
            assert list(hit["trace"]) == trace, record


values = st.sampled_from([None, "", "12", "7.5", "-3", "abc", "bad", " bad ", "dust", "10"])
records = st.lists(st.tuples(values, values, values), min_size=1, max_size=12)
LEAVES = [{"field": "x", "operator": ">=", "value": 7}, {"field": "m", "operator": "contains", "value": "a"},
          {"field": "t", "operator": "not_empty"}, {"field": "x", "operator": "!=", "value": "12"}]
TRUE, FALSE = {"all": []}, {"any": []}


def one(tree, rule="r", priority=1):
    return {"id": rule, "priority": priority, "decision_tree": tree}


@settings(max_examples=8, deadline=None)
@given(records, st.permutations(LEAVES))
def test_properties_of_groups(spark, rows, leaves):
    every = hits(spark, [one({"all": leaves})], rows)
    some = hits(spark, [one({"any": leaves})], rows)
    assert all(h is None for h in hits(spark, [one({"all": [*leaves, FALSE]})], rows))
    assert all(h is not None for h in hits(spark, [one({"any": [*leaves, TRUE]})], rows))
    alone = [[h is not None for h in hits(spark, [one({"all": [leaf]})], rows)] for leaf in leaves]
    for i in range(len(rows)):
        assert (every[i] is not None) == all(a[i] for a in alone)
        assert (some[i] is not None) == any(a[i] for a in alone)
        if every[i] is not None:                       # a conjunction that holds shows every leaf, in order
            assert [t.split(" ")[0] for t in every[i]["trace"]] == [leaf["field"] for leaf in leaves]
        if some[i] is not None:                        # a disjunction stops at its first true leaf
            first = [a[i] for a in alone].index(True)
            assert len(some[i]["trace"]) == first + 1


@settings(max_examples=6, deadline=None)
@given(records, st.integers(1, 9), st.integers(1, 9))
def test_priority_decides(spark, rows, p, q):
    found = hits(spark, [one(TRUE, "first", p), one({"any": LEAVES}, "second", q)], rows)
    if p >= q:
        assert {h["rule_id"] for h in found} == {"first"}
    else:
        alone = hits(spark, [one({"any": LEAVES})], rows)
        assert [h["rule_id"] for h in found] == ["second" if a else "first" for a in alone]


def test_priority_ties_keep_file_order():
    rs = RuleSet.load([one({"all": []}, "p"), one({"all": []}, "q"), one({"any": []}, "r", 2)])
    assert [r.id for r in rs.rules] == ["r", "p", "q"]


def test_shipped_screening_rules_evaluate(spark):
    """The fixed rule set on its own field names: nothing fires on an empty record, every rule is well formed."""
    import json
    import os

    import screenlens
    path = os.path.join(os.path.dirname(screenlens.__file__), "rules", "screening_rules.json")
    with open(path, encoding="utf-8") as f:
        loaded = json.load(f)
    rules = RuleSet.load(loaded["rules"] if isinstance(loaded, dict) else loaded)
    df = spark.createDataFrame([(1,)], "rid int")
    assert len(rules.rules) == 7 and evaluate_rules(df, rules).first()["rule_hit"] is None


def test_nan_text_does_not_pass_numeric_leaf(spark):
    df = spark.createDataFrame([("NaN",), ("nan",), ("inf",)], "x string")
    rs = RuleSet.load([one({"field": "x", "operator": ">=", "value": 7}, "n")])
    assert all(r["rule_hit"] is None for r in evaluate_rules(df, rs).collect())


def test_missing_field_reads_as_empty(spark):
    df = spark.createDataFrame([(1,)], "id int")
    rs = RuleSet.load([one({"field": "absent", "operator": "!=", "value": "x"}, "m")])
    hit = evaluate_rules(df, rs).first()["rule_hit"]
    assert hit["rule_id"] == "m" and list(hit["trace"]) == ["absent != x | 当前值: "]


@pytest.mark.parametrize("compat,expected", [(False, True), (True, False)])
def test_looks_normal_negated_forms(spark, compat, expected):
    from screenlens.functions.text import looks_normal
    row = spark.range(1).select((~looks_normal(F.lit("不合格"), compat)).alias("abn")).first()
    assert row["abn"] is expected
