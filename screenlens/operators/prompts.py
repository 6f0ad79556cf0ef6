"""Prompt assembly and generated-text quality gate, as table operators.

The original builds one chat prompt per record and checks the generated
advice before showing it.  Here both are column expressions, so a whole
table of records becomes a table of prompts (for any batch inference
service) and a table of generations becomes a table of accept/reject
decisions.  No model is loaded or called.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import as_text, norm_ws, split_lines


def record_block(columns: list[str], max_items: int = C.PROMPT_MAX_RECORD_LINES) -> Column:
    """'- key: value' for the first ``max_items`` non-empty fields, or '- 无'."""
    lines = F.array_compact(F.array(*[
        F.when(norm_ws(F.col(f"`{c}`")) != "", F.concat(F.lit(f"- {c}: "), norm_ws(F.col(f"`{c}`")))) for c in columns]))
    lines = F.slice(lines, 1, max_items)
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(F.lit(C.PROMPT_NO_RECORD))


def evidence_block(source: Column, trace: Column, features: Column | None = None) -> Column:
    """Rule trace (<=8 lines) for rule results, else top features (<=6) or a placeholder."""
    tr = F.array_join(F.transform(F.slice(F.coalesce(trace, F.array().cast("array<string>")), 1, C.PROMPT_MAX_TRACE),
                                  lambda x: F.concat(F.lit("- "), x)), "\n")
    rule_text = F.when(tr != "", tr).otherwise(F.lit(C.PROMPT_NO_TRACE))
    if features is None:
        other = F.lit(C.PROMPT_NO_FEATURES)
    else:
        ft = F.array_join(F.transform(F.slice(features, 1, C.PROMPT_MAX_FEATURES), lambda f: F.concat(
            F.lit("- "), f["feature"].cast("string"), F.lit(": value="), f["value"].cast("string"),
            F.lit(" contribution="), F.format_string("%.4f", f["contribution"]))), "\n")
        other = F.when(F.size(features) > 0, ft).otherwise(F.lit(C.PROMPT_NO_FEATURES))
    return F.when(source == C.SOURCE_RULES, rule_text).otherwise(other)


def rag_block(docs: Column | None) -> Column:
    if docs is None:
        return F.lit(C.PROMPT_NO_DOCS)
    top = F.slice(docs, 1, C.PROMPT_MAX_DOCS)
    rows = F.transform(top, lambda d, i: F.concat(
        (i + 1).cast("string"), F.lit(". "),
        F.coalesce(F.nullif(norm_ws(d["title"]), F.lit("")), F.lit(C.PROMPT_UNTITLED)), F.lit(" | "),
        norm_ws(d["source"]), F.lit("\n"), F.substring(norm_ws(d["text"]), 1, C.PROMPT_DOC_CHARS)))
    return F.when(F.size(top) > 0, F.array_join(rows, "\n\n")).otherwise(F.lit(C.PROMPT_NO_DOCS))


def user_prompt(label: Column, diagnosis: Column, source: Column, evidence: Column, record: Column, query: Column,
                rag: Column) -> Column:
    """Fill the fixed user-prompt template; slots are filled left to right by splitting on the markers."""
    parts = []
    rest = C.PROMPT_USER_TEMPLATE
    slots = {"label": norm_ws(label), "diagnosis": F.coalesce(F.nullif(norm_ws(diagnosis), F.lit("")),
                                                               F.lit(C.PROMPT_NO_DIAGNOSIS)),
             "source": norm_ws(source), "evidence": evidence, "record": record, "query": norm_ws(query), "rag": rag}
    while "{" in rest:
        head, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        parts += [F.lit(head), slots[name]]
    parts.append(F.lit(rest))
    return F.trim(F.concat(*parts))


def reject_reason(text: Column) -> Column:
    """Why a generated advice text would be rejected, or null when it passes."""
    t = F.trim(F.coalesce(as_text(text), F.lit("")))
    lines = split_lines(t)
    bad = F.lit(False)
    for m in C.GATE_BAD_MARKERS:
        bad = bad | t.contains(m)
    headings = sum((t.contains(h).cast("int") for h in C.GATE_HEADINGS), F.lit(0))
    return (F.when(t == "", F.lit("empty"))
            .when((F.length(t) < C.GATE_MIN_CHARS) | bad, F.lit("low_quality"))
            .when(F.size(F.array_distinct(lines)) <= 1, F.lit("repetitive"))
            .when(headings < C.GATE_MIN_HEADINGS, F.lit("unstructured")))
