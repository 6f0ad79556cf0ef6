"""DuckDB-dialect text for the oracle side.

These helpers write the *oracle* SQL that the driver runs in DuckDB next to
our Spark plans.  They are independent re-statements of the same semantics
in another dialect (RE2 regexes, DuckDB list functions), not a planner.
"""

from __future__ import annotations

from typing import Any

from .. import constants as C
from ..functions.text import fmt_py_value
from ..functions.rules import RuleSet, _norm_py

WS = r"[\s\x{3000}\x{00a0}]+"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + str(s).replace("'", "''") + "'"


def ident(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def txt(x: str) -> str:
    return f"cast({x} as varchar)"


def norm_ws(x: str) -> str:
    return f"trim(regexp_replace(coalesce({txt(x)}, ''), '{WS}', ' ', 'g'))"


def is_non_empty(x: str) -> str:
    return f"({x} is not null and {norm_ws(x)} not in ('', 'nan', 'None'))"


def safe_float(x: str, default: float | None = 0.0) -> str:
    e = (f"try_cast(nullif(regexp_extract(translate({txt(x)}, '０１２３４５６７８９．－', '0123456789.-'), "
         r"'-?\d+(?:\.\d+)?', 0), '') as double)")
    return e if default is None else f"coalesce({e}, {float(default)})"


def contains_any(x: str, tokens: list[str]) -> str:
    if not tokens:
        return "false"
    return "(" + " or ".join(f"contains({x}, {q(t)})" for t in tokens) + ")"


def looks_normal(x: str, compat: bool = False) -> str:
    t = norm_ws(x)
    probe = t if compat else f"regexp_replace({t}, {q('|'.join(C.NEGATED_NORMAL))}, '', 'g')"
    return f"({t} = '' or {contains_any(probe, C.NORMAL_TOKENS)})"


def raw(x: str) -> str:
    return f"coalesce({txt(x)}, '')"


def col_or_null(name: str | None, present: set[str] | None = None) -> str:
    if not name or (present is not None and name not in present):
        return "cast(null as varchar)"
    return ident(name)


# ---------------------------------------------------------------- rules

class RuleSQL:
    def __init__(self, present: set[str]):
        self.present = present

    def col(self, name: str) -> str:
        return col_or_null(name, self.present)

    def leaf(self, node: dict[str, Any]) -> tuple[str, str]:
        name, op, target = node["field"], node.get("operator"), node.get("value")
        c = self.col(name)
        num, t = safe_float(c, None), norm_ws(c)
        ops = {">=": ">=", ">": ">", "<=": "<=", "<": "<"}
        if op in ops:
            ok = f"coalesce({num} {ops[op]} {float(target)}, false)"
        elif op == "==":
            ok = f"({t} = {q(_norm_py(target))})"
        elif op == "!=":
            ok = f"({t} <> {q(_norm_py(target))})"
        elif op == "contains":
            ok = f"contains({t}, {q(_norm_py(target))})"
        elif op == "contains_any":
            ok = contains_any(t, [_norm_py(v) for v in (target or [])])
        elif op == "not_empty":
            ok = is_non_empty(c)
        else:
            ok = "false"
        prefix = f"{name} {op} {fmt_py_value(target)}{C.TRACE_VALUE_SEP}"
        return ok, f"[{q(prefix)} || {raw(c)}]"

    def node(self, node: dict[str, Any]) -> tuple[str, str]:
        if "all" in node:
            return self.chain([self.node(c) for c in node["all"]], False)
        if "any" in node:
            return self.chain([self.node(c) for c in node["any"]], True)
        return self.leaf(node)

    @staticmethod
    def chain(parts: list[tuple[str, str]], any_mode: bool) -> tuple[str, str]:
        empty = "cast([] as varchar[])"
        if not parts:
            return ("false" if any_mode else "true"), empty
        ok = "(" + (" or " if any_mode else " and ").join(p[0] for p in parts) + ")"
        lines = parts[-1][1]
        for s, ls in reversed(parts[:-1]):
            cond = f"not {s}" if any_mode else s
            lines = f"list_concat({ls}, case when {cond} then {lines} else {empty} end)"
        return ok, lines

    def first_match(self, rs: RuleSet, field: str) -> str:
        """CASE over rules in priority order returning one attribute of the first match."""
        whens = []
        for r in rs.rules:
            ok, lines = self.node(r.decision_tree)
            val = {"rule_id": q(r.id), "label": q(r.output_label), "diagnosis": q(r.diagnosis),
                   "trace": lines}[field]
            whens.append(f"when {ok} then {val}")
        return "case " + " ".join(whens) + " end"


# ---------------------------------------------------------------- findings

def highlights(roles: dict[str, str | None], present: set[str], compat: bool = False) -> str:
    def c(r: str) -> str:
        return col_or_null(roles.get(r), present)
    checks = [
        (f"({safe_float(c('sbp'))} >= {C.SBP_HIGH} or {safe_float(c('dbp'))} >= {C.DBP_HIGH})",
         f"{q(C.HL_BP)} || {raw(c('sbp'))} || '/' || {raw(c('dbp'))}"),
        (f"{safe_float(c('glucose'))} >= {C.GLUCOSE_HIGH}", f"{q(C.HL_GLUCOSE)} || {raw(c('glucose'))}"),
        (f"({is_non_empty(c('chest_judgment'))} and not {looks_normal(c('chest_judgment'), compat)})",
         f"{q(C.HL_CHEST)} || {raw(c('chest_judgment'))}"),
        (f"({is_non_empty(c('lung'))} and {contains_any(raw(c('lung')), C.ABNORMAL_KEYWORDS)})",
         f"{q(C.HL_LUNG)} || {raw(c('lung'))}"),
        (f"{safe_float(c('high_freq'))} >= {C.HIGH_FREQ_HIGH}", f"{q(C.HL_HIGH_FREQ)} || {raw(c('high_freq'))}"),
        (f"{safe_float(c('speech_freq'))} >= {C.SPEECH_FREQ_HIGH}",
         f"{q(C.HL_SPEECH_FREQ)} || {raw(c('speech_freq'))}"),
        (f"({is_non_empty(c('ecg'))} and not {looks_normal(c('ecg'), compat)})", f"{q(C.HL_ECG)} || {raw(c('ecg'))}"),
        (f"({is_non_empty(c('symptom'))} and not {looks_normal(c('symptom'), compat)})",
         f"{q(C.HL_SYMPTOM)} || {raw(c('symptom'))}"),
    ]
    items = ", ".join(f"case when {ok} then {t} end" for ok, t in checks)
    return f"list_filter([{items}], lambda x: x is not null)[1:{C.MAX_HIGHLIGHTS}]"


def heuristic_label(roles: dict[str, str | None], present: set[str], hl: str) -> str:
    hz = norm_ws(col_or_null(roles.get("hazard"), present))
    return (f"case when len({hl}) = 0 then {q(C.LABELS[1])} when {contains_any(hz, C.OCCUPATIONAL_SIGNAL_TOKENS)} "
            f"then {q(C.LABELS[2])} else {q(C.LABELS[0])} end")


def query_text(roles: dict[str, str | None], present: set[str], label: str, diagnosis: str, hl: str) -> str:
    parts = [f"{q(C.QUERY_CONCLUSION)} || coalesce({label}, '')",
             f"case when coalesce({diagnosis}, '') <> '' then {q(C.QUERY_DIAGNOSIS)} || {diagnosis} end"]
    for r in C.QUERY_ROLES:
        v = norm_ws(col_or_null(roles.get(r), present))
        parts.append(f"case when {v} <> '' then {q(C.ROLE_LABELS[r] + ' ')} || {v} end")
    arr = f"list_concat(list_filter([{', '.join(parts)}], lambda x: x is not null), {hl})"
    return f"array_to_string({arr}[1:{C.MAX_QUERY_PARTS}], {q(C.QUERY_SEPARATOR)})"


def portable_hash(seed: str, key: str) -> str:
    return f"('0x' || substr(md5({q(seed)} || ':' || cast({key} as varchar)), 1, 8))::BIGINT"
