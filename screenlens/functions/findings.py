"""Record-level findings as Column expressions: highlights, heuristic label,
summary sections, retrieval query text, template advice, report text,
probability display, argmax, rule-hit tag.

Field access goes through a *role map* (role -> column name) so the same
expressions run on the wide screening schema and on the EXAM test view.
A role whose column is absent reads as null, like a missing dict key.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .text import as_text, contains_any, is_non_empty, looks_normal, norm_ws, safe_float

# role -> column of the wide screening schema
SCREENING_FIELDS = {
    "gender": "性别2", "age": "年龄3", "job": "工种21", "total_years": "总工龄22", "exposure_years": "接害工龄23",
    "hazard": "接触危害因素25", "protection": "防护措施29", "sbp": "收缩压结果242", "sbp_marker": "收缩压合格标记244",
    "dbp": "舒张压结果245", "dbp_marker": "舒张压合格标记247", "glucose": "血葡萄糖结果1185",
    "chest_judgment": "胸部正位片结果判定596", "chest_marker": "胸部正位片合格标记595", "lung": "肺功能结果结果590",
    "high_freq": "双耳高频平均听阈结果735", "speech_freq": "双耳语频平均听阈结果732", "ecg": "心电图结果572",
    "symptom": "自觉症状45",
}
EMPTY_SUMMARY = "当前记录字段较少，暂无可展示摘要。"


class Fields:
    """Resolve roles to columns of one DataFrame schema."""

    def __init__(self, columns: list[str], roles: Mapping[str, str | None]):
        self.present = set(columns)
        self.roles = dict(roles)

    def __call__(self, role: str) -> Column:
        name = self.roles.get(role)
        if name and name in self.present:
            return F.col(f"`{name}`")
        return F.lit(None).cast("string")

    def raw(self, role: str) -> Column:
        """Text as the original prints a missing value: ''."""
        return F.coalesce(as_text(self(role)), F.lit(""))


def highlights(f: Fields, compat: bool = False) -> Column:
    """Eight ordered abnormality checks; the first six hits, as array<string>."""
    checks = [
        ((safe_float(f("sbp"), 0) >= C.SBP_HIGH) | (safe_float(f("dbp"), 0) >= C.DBP_HIGH),
         F.concat(F.lit(C.HL_BP), f.raw("sbp"), F.lit("/"), f.raw("dbp"))),
        (safe_float(f("glucose"), 0) >= C.GLUCOSE_HIGH, F.concat(F.lit(C.HL_GLUCOSE), f.raw("glucose"))),
        (is_non_empty(f("chest_judgment")) & ~looks_normal(f("chest_judgment"), compat),
         F.concat(F.lit(C.HL_CHEST), f.raw("chest_judgment"))),
        (is_non_empty(f("lung")) & contains_any(f.raw("lung"), C.ABNORMAL_KEYWORDS),
         F.concat(F.lit(C.HL_LUNG), f.raw("lung"))),
        (safe_float(f("high_freq"), 0) >= C.HIGH_FREQ_HIGH, F.concat(F.lit(C.HL_HIGH_FREQ), f.raw("high_freq"))),
        (safe_float(f("speech_freq"), 0) >= C.SPEECH_FREQ_HIGH,
         F.concat(F.lit(C.HL_SPEECH_FREQ), f.raw("speech_freq"))),
        (is_non_empty(f("ecg")) & ~looks_normal(f("ecg"), compat), F.concat(F.lit(C.HL_ECG), f.raw("ecg"))),
        (is_non_empty(f("symptom")) & ~looks_normal(f("symptom"), compat),
         F.concat(F.lit(C.HL_SYMPTOM), f.raw("symptom"))),
    ]
    arr = F.array(*[F.when(ok, text) for ok, text in checks])
    return F.slice(F.array_compact(arr), 1, C.MAX_HIGHLIGHTS)


def heuristic_label(f: Fields, highlight_col: Column) -> Column:
    signal = contains_any(norm_ws(f("hazard")), C.OCCUPATIONAL_SIGNAL_TOKENS)
    return (F.when(F.size(highlight_col) == 0, F.lit(C.LABELS[1]))
            .when(signal, F.lit(C.LABELS[2])).otherwise(F.lit(C.LABELS[0])))


def summary_sections(f: Fields, highlight_col: Column) -> Column:
    """array<struct<title, items array<string>>>: labelled non-empty fields, highlights, exposure tags."""
    sections = []
    for title, roles in C.SUMMARY_LAYOUT:
        cells = F.array_compact(F.array(*[
            F.when(is_non_empty(f(r)), F.concat(F.lit(C.ROLE_LABELS[r] + "："), f.raw(r))) for r in roles]))
        sections.append(F.when(F.size(cells) > 0, F.struct(F.lit(title).alias("title"), cells.alias("items"))))
    sections.append(F.when(F.size(highlight_col) > 0,
                           F.struct(F.lit(C.HIGHLIGHT_SECTION).alias("title"), highlight_col.alias("items"))))
    hz = norm_ws(f("hazard"))
    tags = F.slice(F.filter(F.transform(F.split(hz, "[,、]"), lambda t: F.trim(t)), lambda t: t != ""), 1, C.MAX_TAGS)
    sections.append(F.when(hz != "", F.struct(F.lit(C.TAG_SECTION).alias("title"), tags.alias("items"))))
    return F.array_compact(F.array(*sections))


def summary_text(sections: Column) -> Column:
    body = F.array_join(F.transform(sections, lambda s: F.concat(s["title"], F.lit(": "),
                                                                  F.array_join(s["items"], " | "))), "\n")
    return F.when(F.size(sections) == 0, F.lit(EMPTY_SUMMARY)).otherwise(body)


def query_text(f: Fields, label: Column, diagnosis: Column, highlight_col: Column) -> Column:
    """Retrieval query: conclusion, diagnosis, five labelled fields, highlights; <=12 parts joined by '；'."""
    parts = [F.concat(F.lit(C.QUERY_CONCLUSION), F.coalesce(label, F.lit(""))),
             F.when(F.coalesce(diagnosis, F.lit("")) != "", F.concat(F.lit(C.QUERY_DIAGNOSIS), diagnosis))]
    for r in C.QUERY_ROLES:
        v = norm_ws(f(r))
        parts.append(F.when(v != "", F.concat(F.lit(C.ROLE_LABELS[r] + " "), v)))
    allp = F.concat(F.array_compact(F.array(*parts)), highlight_col)
    return F.array_join(F.slice(allp, 1, C.MAX_QUERY_PARTS), C.QUERY_SEPARATOR)


def employment_advice(label: Column) -> Column:
    expr = None
    for k, v in C.EMPLOYMENT_ADVICE.items():
        expr = (F.when(label == k, F.lit(v)) if expr is None else expr.when(label == k, F.lit(v)))
    return expr.otherwise(F.lit(C.EMPLOYMENT_DEFAULT))


def reference_lines(docs: Column | None) -> Column:
    """First three documents as 'title | source | text[:120]' (docs: array<struct<title,source,text,...>>)."""
    if docs is None:
        return F.array().cast("array<string>")
    return F.transform(F.slice(docs, 1, C.MAX_REFERENCES), lambda d: F.concat_ws(
        " | ", F.coalesce(d["title"], F.lit("")), F.coalesce(d["source"], F.lit("")),
        F.substring(norm_ws(d["text"]), 1, C.REFERENCE_CHARS)))


def advice_lines(label: Column, highlight_col: Column, docs: Column | None = None, refs: Column | None = None) -> Column:
    """The template's lines; ``refs``: the documents' reference lines, where they are made already."""
    refs = reference_lines(docs) if refs is None else refs
    follow = F.when(F.size(highlight_col) > 0, F.array_join(highlight_col, "；")).otherwise(F.lit(C.FOLLOW_UP_DEFAULT))
    h = C.ADVICE_HEADINGS
    return F.array(
        F.lit(h[0]), employment_advice(label),
        F.lit(h[1]), follow,
        F.lit(h[2]), F.lit("；".join(C.PREVENTION)),
        F.lit(h[3]), F.when(F.size(refs) > 0, F.array_join(refs, "；")).otherwise(F.lit(C.NO_REFERENCES)),
        F.lit(h[4]), F.lit(C.TEMPLATE_NOTICE),
    )


def advice_struct(label: Column, highlight_col: Column, docs: Column | None = None, refs: Column | None = None) -> Column:
    lines = advice_lines(label, highlight_col, docs, refs)
    return F.struct(F.lit(C.ADVICE_MODE).alias("mode"), F.array_join(lines, "\n").alias("text"), lines.alias("lines"))


def record_lines(columns: list[str]) -> Column:
    """'key: value' for every non-empty field of the record, in column order."""
    return F.array_compact(F.array(*[
        F.when(is_non_empty(F.col(f"`{c}`")), F.concat(F.lit(f"{c}: "), as_text(F.col(f"`{c}`")))) for c in columns]))


def report_text(record_cols: list[str], label: Column, source: Column, diagnosis: Column,
                logic_lines: Column, rag_lines: Column, advice_text: Column) -> Column:
    s = C.REPORT_SECTIONS
    blank = F.lit("")
    return F.concat_ws("\n", F.lit(C.REPORT_TITLE), blank, F.lit(s[0]), record_lines(record_cols), blank,
                       F.lit(s[1]), F.concat(F.lit("结论: "), F.coalesce(label, blank)),
                       F.concat(F.lit("来源: "), F.coalesce(source, blank)),
                       F.concat(F.lit("诊断提示: "), F.coalesce(diagnosis, blank)), blank,
                       F.lit(s[2]), logic_lines, blank, F.lit(s[3]), rag_lines, blank, F.lit(s[4]), advice_text)


def rule_hit_tag(source: Column, rule_id: Column) -> Column:
    rid = F.trim(F.coalesce(rule_id, F.lit("")))
    return (F.when(source == C.SOURCE_RULES,
                   F.when(rid != "", F.concat(F.lit(C.RULE_HIT + " "), rid)).otherwise(F.lit(C.RULE_HIT)))
            .otherwise(F.lit(C.RULE_MISS)))


def argmax_index(probs: list[Column]) -> Column:
    """Index of the first maximum (numpy argmax tie rule)."""
    best = F.greatest(*probs)
    expr = None
    for i, p in enumerate(probs):
        expr = F.when(p == best, F.lit(i)) if expr is None else expr.when(p == best, F.lit(i))
    return expr


def prob_display(prob: Column) -> Column:
    """Display text of one probability: '>99.99%', '<0.01%' or two-decimal percent."""
    return (F.when((prob >= C.SHARE_BUCKET_HIGH) & (prob < 1.0), F.lit(">99.99%"))
            .when((prob > 0.0) & (prob <= C.SHARE_BUCKET_LOW), F.lit("<0.01%"))
            .otherwise(F.concat(F.format_string("%.2f", F.bround(prob * 100, 2)), F.lit("%"))))


def bar_width(prob: Column) -> Column:
    w = F.when(prob <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(C.BAR_MIN), prob * 100.0))
    return F.when((prob < 1.0) & (w > C.BAR_MAX), F.lit(C.BAR_MAX)).otherwise(w)
