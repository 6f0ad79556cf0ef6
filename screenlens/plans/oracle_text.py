"""DuckDB oracle for text outputs and record parsers."""

from __future__ import annotations

from .. import constants as C
from ..functions.findings import EMPTY_SUMMARY
from ..sources import fixtures as X
from ..sources import records_text as RT
from . import q_text as K
from . import sqlgen as S
from .oracle import _SCORE_BASE, EXAM_PRESENT, ORACLE, _label_text, oracle
from .views import EXAM_SQL, with_views

_V = dict(exam=EXAM_SQL, scored=_SCORE_BASE)
_P = EXAM_PRESENT | {"final_label", "final_diagnosis"}
_QUERY = S.query_text(X.EXAM_FIELDS, _P, "final_label", "final_diagnosis", "h")


def _col(role: str) -> str:
    return S.col_or_null(X.EXAM_FIELDS.get(role), EXAM_PRESENT)


def _lines_list(items: list[str]) -> str:
    return "[" + ", ".join(items) + "]"


_EMPLOY = "case final_label " + " ".join(f"when {S.q(k)} then {S.q(v)}" for k, v in C.EMPLOYMENT_ADVICE.items()) + \
    f" else {S.q(C.EMPLOYMENT_DEFAULT)} end"
_FOLLOW = f"case when len(h) > 0 then array_to_string(h, '；') else {S.q(C.FOLLOW_UP_DEFAULT)} end"
_HD = C.ADVICE_HEADINGS
_ADVICE = "array_to_string(" + _lines_list([
    S.q(_HD[0]), _EMPLOY, S.q(_HD[1]), _FOLLOW, S.q(_HD[2]), S.q("；".join(C.PREVENTION)), S.q(_HD[3]),
    S.q(C.NO_REFERENCES), S.q(_HD[4]), S.q(C.TEMPLATE_NOTICE)]) + ", chr(10))"

oracle("query_text", with_views(f"select record_id, {_QUERY} as query from scored", **_V))

oracle("advice_template", with_views(
    f"select record_id, '{C.ADVICE_MODE}' as advice_mode, {_ADVICE} as advice_text from scored", **_V))

# ---------------------------------------------------------------- summary
_sections = []
for title, roles in C.SUMMARY_LAYOUT:
    cells = "list_filter(" + _lines_list([
        f"case when {S.is_non_empty(_col(r))} then {S.q(C.ROLE_LABELS[r] + '：')} || {S.raw(_col(r))} end"
        for r in roles]) + ", lambda x: x is not null)"
    _sections.append(f"case when len({cells}) > 0 then {S.q(title + ': ')} || array_to_string({cells}, ' | ') end")
_sections.append(f"case when len(h) > 0 then {S.q(C.HIGHLIGHT_SECTION + ': ')} || array_to_string(h, ' | ') end")
_HZ = S.norm_ws(_col("hazard"))
_TAGS = (f"list_filter(list_transform(regexp_split_to_array({_HZ}, '[,、]'), lambda t: trim(t)), "
         f"lambda t: t <> '')[1:{C.MAX_TAGS}]")
_sections.append(f"case when {_HZ} <> '' then {S.q(C.TAG_SECTION + ': ')} || array_to_string({_TAGS}, ' | ') end")
_SECS = "list_filter(" + _lines_list(_sections) + ", lambda x: x is not null)"

oracle("record_summary", with_views(f"""
select record_id, cast(len(secs) as int) as n_sections,
       case when len(secs) = 0 then {S.q(EMPTY_SUMMARY)} else array_to_string(secs, chr(10)) end as summary
from (select record_id, {_SECS} as secs from scored) t""", **_V))

# ---------------------------------------------------------------- report
_REC_LINES = "list_filter(" + _lines_list([
    f"case when {S.is_non_empty(c)} then {S.q(c + ': ')} || cast({c} as varchar) end" for c in K.RECORD_FIELDS]) + \
    ", lambda x: x is not null)"
_RS = C.REPORT_SECTIONS
_REPORT = ("array_to_string(list_concat(" + _lines_list([S.q(C.REPORT_TITLE), "''", S.q(_RS[0])]) + f", {_REC_LINES}, " +
           _lines_list(["''", S.q(_RS[1]), "'结论: ' || coalesce(final_label, '')", "'来源: ' || coalesce(source, '')",
                        "'诊断提示: ' || coalesce(final_diagnosis, '')", "''", S.q(_RS[2])]) +
           ", case when source = 'expert_system' then final_trace else cast([] as varchar[]) end, " +
           _lines_list(["''", S.q(_RS[3]), "''", S.q(_RS[4]), _ADVICE]) + "), chr(10))")
oracle("report_text", with_views(f"select record_id, {_REPORT} as report from scored", **_V))

# ---------------------------------------------------------------- prompt
_RB_LINES = "list_filter(" + _lines_list([
    f"case when {S.norm_ws(c)} <> '' then {S.q('- ' + c + ': ')} || {S.norm_ws(c)} end" for c in K.RECORD_FIELDS]) + \
    f", lambda x: x is not null)[1:{C.PROMPT_MAX_RECORD_LINES}]"
_RB = f"case when len({_RB_LINES}) > 0 then array_to_string({_RB_LINES}, chr(10)) else {S.q(C.PROMPT_NO_RECORD)} end"
_TR = f"array_to_string(list_transform(coalesce(final_trace, [])[1:{C.PROMPT_MAX_TRACE}], lambda x: '- ' || x), chr(10))"
_EV = (f"case when source = 'expert_system' then (case when {_TR} <> '' then {_TR} else {S.q(C.PROMPT_NO_TRACE)} end) "
       f"else {S.q(C.PROMPT_NO_FEATURES)} end")
_SLOTS = {"label": S.norm_ws("final_label"),
          "diagnosis": f"coalesce(nullif({S.norm_ws('final_diagnosis')}, ''), {S.q(C.PROMPT_NO_DIAGNOSIS)})",
          "source": S.norm_ws("source"), "evidence": _EV, "record": _RB, "query": S.norm_ws(_QUERY),
          "rag": S.q(C.PROMPT_NO_DOCS)}


def _fill(template: str) -> str:
    parts, rest = [], template
    while "{" in rest:
        head, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        parts += [S.q(head), f"({_SLOTS[name]})"]
    parts.append(S.q(rest))
    return "trim(" + " || ".join(parts) + ")"


oracle("prompt_build", with_views(f"select record_id, {_fill(C.PROMPT_USER_TEMPLATE)} as user_prompt from scored",
                                  **_V))

# ---------------------------------------------------------------- gate
_LINES = "list_filter(list_transform(regexp_split_to_array(t, '\\r\\n|\\r|\\n'), lambda s: trim(s)), lambda s: s <> '')"
_BAD = " or ".join(f"contains(t, {S.q(m)})" for m in C.GATE_BAD_MARKERS)
_HEADS = " + ".join(f"(case when contains(t, {S.q(h)}) then 1 else 0 end)" for h in C.GATE_HEADINGS)
_GEN = f"""
select conv_id, turn, text || case when conv_id % 3 = 0 then {S.q(RT.GEN_HEADINGS)} else '' end
                          || case when conv_id % 7 = 0 then {S.q(RT.GEN_BAD)} else '' end as text
from conversations where role = 'assistant'"""
oracle("quality_gate", with_views(f"""
select conv_id, turn,
  case when t = '' then 'empty' when length(t) < {C.GATE_MIN_CHARS} or {_BAD} then 'low_quality'
       when len(list_distinct({_LINES})) <= 1 then 'repetitive' when {_HEADS} < {C.GATE_MIN_HEADINGS} then 'unstructured'
  end as reject_reason,
  cast(len({_LINES}) as int) as n_lines
from (select conv_id, turn, trim(coalesce(text, '')) as t from gen) g""", gen=_GEN))

# ---------------------------------------------------------------- parsers
_KV = """
select record_id, label, exposure, concat_ws(chr(10), 'job: ' || coalesce(job, ''), '', '年龄：' || cast(age as varchar),
  'free text without a colon', '  sbp_result : ' || coalesce(sbp_result, ''), 'job：' || gender, ':orphan value',
  'exposure: ' || coalesce(exposure, ''), 'mixed: a：b') as kv_text
from exam"""


def _kv_parse(src: str, key: str, text: str) -> str:
    """(key, n_keys, record_text) for key/value text."""
    return f"""
select b.{key}, cast(coalesce(n, 0) as int) as n_keys, coalesce(record_text, '') as record_text
from {src} b left join (
  select {key}, count(*) as n, string_agg(k || '=' || v, ';' order by k, v) as record_text from (
    select {key}, k, v, row_number() over (partition by {key}, k order by pos desc) as rk from (
      select {key}, pos, case when contains(l, '：') then trim(regexp_extract(l, '{RT.KEY_FULL}', 1))
                              else trim(regexp_extract(l, '{RT.KEY_HALF}', 1)) end as k,
                         case when contains(l, '：') then trim(regexp_extract(l, '{RT.VAL_FULL}', 1))
                              else trim(regexp_extract(l, '{RT.VAL_HALF}', 1)) end as v
      from (select {key}, trim(l0) as l, pos from (
              select {key}, unnest(string_split({text}, chr(10))) as l0,
                     generate_subscripts(string_split({text}, chr(10)), 1) as pos from {src}) u0) u
      where l <> '' and (contains(l, '：') or contains(l, ':'))) e
    where k <> '') d
  where rk = 1 group by {key}) p on b.{key} = p.{key}"""


oracle("parse_kv_text", with_views(_kv_parse("kv", "record_id", "kv_text"), exam=EXAM_SQL, kv=_KV))

oracle("parse_record_json", """
select e.event_id, cast(coalesce(n, 0) as int) as n_keys, coalesce(record_text, '') as record_text
from events e left join (
  select event_id, count(*) as n, string_agg(k || '=' || v, ';' order by k, v) as record_text
  from (select event_id, k, json_extract_string(props, '$."' || k || '"') as v
        from (select event_id, props, unnest(json_keys(props)) as k from events
              where starts_with(trim(props), '{')) a) b
  group by event_id) p on e.event_id = p.event_id""")

_DEMO = ORACLE["demo_samples"]
_ROUTE = f"""
select record_id, mode, label, exposure,
  case when mode = 'upload' and exposure is null then '[]' when mode <> 'upload' and exposure is null then '   '
       else kv_text end as text,
  coalesce({_label_text('label')}, '') || '_' || cast(record_id as varchar) as sample_id
from (select *, ['dataset', 'manual', 'upload'][record_id % 3 + 1] as mode from kv) k"""
oracle("input_routing", with_views(f"""
select r.record_id, mode,
  cast(case when mode = 'dataset' then 0 when mode = 'upload' then (case when exposure is null then 0 else 2 end)
       else coalesce(p.n_keys, 0) end as int) as n_fields,
  case when mode = 'dataset' then (case when d.sample_id is null then {S.q(RT.REJECT_DATASET)} end)
       when mode = 'upload' then (case when exposure is null then {S.q(RT.REJECT_UPLOAD)} end)
       else (case when coalesce(p.n_keys, 0) = 0 then {S.q(RT.REJECT_MANUAL)} end) end as reject_reason
from routed r left join ({_DEMO}) d on r.sample_id = d.sample_id
left join parsed p on r.record_id = p.record_id""", exam=EXAM_SQL, kv=_KV, routed=_ROUTE,
    parsed=_kv_parse("routed", "record_id", "text")))
