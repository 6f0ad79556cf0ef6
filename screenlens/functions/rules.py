"""Rule trees compiled to one Spark ``Column``.

Grammar (JSON): a node is ``{"all": [...]}``, ``{"any": [...]}`` or a leaf
``{"field", "operator", "value"}``.  ``all`` wins when a node has both keys;
an empty ``all`` is true, an empty ``any`` is false.  Leaf operators:
``>= > <= <`` (numeric, first number in the text; unparseable -> false),
``== !=`` (whitespace-normalised text), ``contains``, ``contains_any``,
``not_empty``; anything else is false.

Rules are tried by priority (descending, stable); the first match wins.
The trace lists every leaf visited, with short circuit: an ``all`` stops at
its first failing child, an ``any`` at its first passing child.

The whole rule set becomes a single ``coalesce(when(r1, ...), when(r2, ...))``
expression, so scoring a table is one narrow projection: no shuffle, no UDF.
Each referenced field is parsed once (number and normalised text) in a
projection below the rule expression.
"""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .text import as_text, contains_any, fmt_py_value, is_non_empty, norm_ws, safe_float

NUMERIC_OPS = {">=": "__ge__", ">": "__gt__", "<=": "__le__", "<": "__lt__"}
KNOWN_OPS = set(NUMERIC_OPS) | {"==", "!=", "contains", "contains_any", "not_empty"}
def empty_lines() -> Column:
    return F.array().cast("array<string>")


@dataclass
class Rule:
    id: str
    priority: int
    output_label: str
    diagnosis: str
    decision_tree: dict[str, Any]
    order: int = 0

    @staticmethod
    def from_dict(d: dict[str, Any], order: int = 0) -> "Rule":
        return Rule(str(d.get("id", f"rule_{order}")), int(d.get("priority", 0)), str(d.get("output_label", "")),
                    str(d.get("diagnosis", "")), d.get("decision_tree") or {}, order)


@dataclass
class RuleSet:
    rules: list[Rule] = field(default_factory=list)

    @staticmethod
    def load(source: str | Path | list[dict[str, Any]]) -> "RuleSet":
        if isinstance(source, (str, Path)):
            items = json.loads(Path(source).read_text(encoding="utf-8"))
        else:
            items = source
        rules = [Rule.from_dict(d, i) for i, d in enumerate(items)]
        # stable: equal priorities keep file order
        rules.sort(key=lambda r: (-r.priority, r.order))
        return RuleSet(rules)

    def fields(self) -> list[str]:
        seen: list[str] = []

        def walk(node: dict[str, Any]) -> None:
            if "all" in node:
                for ch in node["all"]:
                    walk(ch)
            elif "any" in node:
                for ch in node["any"]:
                    walk(ch)
            elif "field" in node and node["field"] not in seen:
                seen.append(node["field"])

        for r in self.rules:
            walk(r.decision_tree)
        return seen


def _hidden(kind: str, i: int) -> str:
    return f"__rule_{kind}_{i}"


def _leaves(ruleset: RuleSet) -> list[dict[str, Any]]:
    """Every leaf node of every rule, in a fixed traversal order (index = position)."""
    out: list[dict[str, Any]] = []

    def walk(node: dict[str, Any]) -> None:
        if "all" in node:
            for ch in node["all"]:
                walk(ch)
        elif "any" in node:
            for ch in node["any"]:
                walk(ch)
        else:
            out.append(node)

    for r in ruleset.rules:
        walk(r.decision_tree)
    return out


def _leaf_condition(node: dict[str, Any], num: Column, txt: Column, raw: Column) -> Column:
    op, target = node.get("operator"), node.get("value")
    if op in NUMERIC_OPS:
        return F.coalesce(getattr(num, NUMERIC_OPS[op])(F.lit(float(target))), F.lit(False))
    if op == "==":
        return txt == F.lit(_norm_py(target))
    if op == "!=":
        return txt != F.lit(_norm_py(target))
    if op == "contains":
        return txt.contains(_norm_py(target))
    if op == "contains_any":
        return contains_any(txt, [_norm_py(t) for t in (target or [])])
    if op == "not_empty":
        return is_non_empty(raw)
    warnings.warn(f"unknown rule operator {op!r} on {node.get('field')!r}: evaluates to false")
    return F.lit(False)


class _Compiler:
    """Builds rule success and trace expressions over precomputed leaf columns.

    Leaf truth values are materialised once per row as boolean columns
    (``__rule_leaf_k``); rule success, the short-circuit "visited" flags and
    the trace are cheap boolean/array expressions over them.  This keeps the
    generated code small enough for whole-stage codegen.
    """

    def __init__(self, ruleset: RuleSet, present: set[str]):
        self.ids = {id(n): k for k, n in enumerate(_leaves(ruleset))}
        self.present = present

    def raw(self, name: str) -> Column:
        return F.col(f"`{name}`") if name in self.present else F.lit(None).cast("string")

    def success(self, node: dict[str, Any]) -> Column:
        if "all" in node:
            kids = [self.success(c) for c in node["all"]]
            return reduce(lambda a, b: a & b, kids) if kids else F.lit(True)
        if "any" in node:
            kids = [self.success(c) for c in node["any"]]
            return reduce(lambda a, b: a | b, kids) if kids else F.lit(False)
        return F.col(_hidden("leaf", self.ids[id(node)]))

    def trace(self, node: dict[str, Any]) -> Column:
        """Lines of the leaves visited under short circuit, in visiting order."""
        items: list[Column] = []

        def walk(n: dict[str, Any], visited: Column | None) -> None:
            if "all" in n or "any" in n:
                any_mode = "all" not in n
                kids = n["any"] if any_mode else n["all"]
                cond = visited
                for ch in kids:
                    walk(ch, cond)
                    s = self.success(ch)
                    step = ~s if any_mode else s
                    cond = step if cond is None else (cond & step)
                return
            target = n.get("value")
            prefix = f"{n['field']} {n.get('operator')} {fmt_py_value(target)}{C.TRACE_VALUE_SEP}"
            line = F.concat(F.lit(prefix), F.coalesce(as_text(self.raw(n["field"])), F.lit("")))
            items.append(line if visited is None else F.when(visited, line))

        walk(node, None)
        return F.array_compact(F.array(*items)) if items else empty_lines()


def _norm_py(v: Any) -> str:
    # normalize_whitespace(v) of the original: falsy -> ''
    if v is None or v is False or v == 0 and not isinstance(v, str):
        return ""
    return " ".join(str(v).split())


def with_rule_inputs(df: DataFrame, ruleset: RuleSet) -> DataFrame:
    """Parse each referenced field once (number, normalised text), then evaluate each leaf once."""
    present = set(df.columns)
    fields = ruleset.fields()
    cols = []
    for i, name in enumerate(fields):
        raw = F.col(f"`{name}`") if name in present else F.lit(None).cast("string")
        cols.append(safe_float(raw, default=None).alias(_hidden("num", i)))
        cols.append(norm_ws(raw).alias(_hidden("txt", i)))
    staged = df.select("*", *cols)
    fidx = {f: i for i, f in enumerate(fields)}
    leaf_cols = []
    for k, node in enumerate(_leaves(ruleset)):
        i = fidx[node["field"]]
        raw = F.col(f"`{node['field']}`") if node["field"] in present else F.lit(None).cast("string")
        cond = _leaf_condition(node, F.col(_hidden("num", i)), F.col(_hidden("txt", i)), raw)
        leaf_cols.append(cond.alias(_hidden("leaf", k)))
    return staged.select("*", *leaf_cols)


def drop_rule_inputs(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__rule_")])


def rule_hit_column(df: DataFrame, ruleset: RuleSet) -> Column:
    """struct<rule_id, label, diagnosis, priority, trace array<string>> of the first match, or null.

    ``df`` must already carry the hidden inputs of :func:`with_rule_inputs`.
    """
    comp = _Compiler(ruleset, set(df.columns))
    branches = []
    for r in ruleset.rules:
        hit = F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.output_label).alias("label"),
                       F.lit(r.diagnosis).alias("diagnosis"), F.lit(r.priority).alias("priority"),
                       comp.trace(r.decision_tree).alias("trace"))
        branches.append(F.when(comp.success(r.decision_tree), hit))
    if not branches:
        return F.lit(None)
    return F.coalesce(*branches) if len(branches) > 1 else branches[0]


def evaluate_rules(df: DataFrame, ruleset: RuleSet, out: str = "rule_hit") -> DataFrame:
    """Append the first-matching-rule struct as column ``out`` (null: no rule fired)."""
    staged = with_rule_inputs(df, ruleset)
    return drop_rule_inputs(staged.withColumn(out, rule_hit_column(staged, ruleset)))


def rule_flags(df: DataFrame, ruleset: RuleSet) -> DataFrame:
    """One boolean column per rule (``hit_<id>``), independent of priority."""
    staged = with_rule_inputs(df, ruleset)
    comp = _Compiler(ruleset, set(staged.columns))
    flags = [comp.success(r.decision_tree).alias(f"hit_{r.id}") for r in ruleset.rules]
    return drop_rule_inputs(staged.select("*", *flags))


RULES_DIR = Path(__file__).resolve().parent.parent / "rules"


def screening_rules() -> RuleSet:
    """The shipped rule set on the wide screening schema."""
    return RuleSet.load(RULES_DIR / "screening_rules.json")


def exam_rules() -> RuleSet:
    """Same thresholds and grammar on the EXAM fixture's English field names."""
    return RuleSet.load(RULES_DIR / "exam_rules.json")
