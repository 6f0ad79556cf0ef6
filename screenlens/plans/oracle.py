"""DuckDB oracle SQL, one string per catalogue key.

Tables ``region nation customer supplier part orders lineitem events
documents embeddings pages benchmark labels conversations`` are views in
the driver's DuckDB; derived views are inlined as CTEs.
"""

from __future__ import annotations

from ..functions.rules import exam_rules
from ..sources import fixtures as X
from . import sqlgen as S
from .views import EXAM_COLUMNS, EXAM_SQL, PRED_SQL, with_views

ORACLE: dict[str, str] = {}
EXAM_PRESENT = set(EXAM_COLUMNS)


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql.strip()


def _label_text(c: str) -> str:
    return "case " + " ".join(f"when {c} = {S.q(k)} then {S.q(v)}" for k, v in X.EXAM_LABEL_TEXT.items()) + " end"


# ------------------------------------------------------------------ rules

_R = S.RuleSQL(EXAM_PRESENT)
_RS = exam_rules()
_HL = S.highlights(X.EXAM_FIELDS, EXAM_PRESENT)

oracle("rule_eval", with_views(f"""
select record_id, {_R.first_match(_RS, 'rule_id')} as rule_id, {_R.first_match(_RS, 'label')} as rule_label,
       {_R.first_match(_RS, 'diagnosis')} as diagnosis
from exam""", exam=EXAM_SQL))

oracle("rule_trace", with_views(f"""
select record_id, rule_id, cast(len(trace) as bigint) as n_lines, array_to_string(trace, chr(10)) as trace
from (select record_id, {_R.first_match(_RS, 'rule_id')} as rule_id, {_R.first_match(_RS, 'trace')} as trace from exam) t
where rule_id is not null""", exam=EXAM_SQL))

oracle("rule_profile", with_views(f"""
select coalesce(rule_id, '') as rule_id, expected_label, count(*) as n,
       cast(sum(case when rule_label is null then null when rule_label = expected_label then 1 else 0 end) as bigint) as n_agree
from (select {_R.first_match(_RS, 'rule_id')} as rule_id, {_R.first_match(_RS, 'label')} as rule_label,
             coalesce({_label_text('label')}, '') as expected_label from exam) t
group by 1, 2""", exam=EXAM_SQL))

oracle("highlights", with_views(f"""
select record_id, cast(len(h) as bigint) as n_highlights, array_to_string(h, chr(10)) as highlights
from (select record_id, {_HL} as h from exam) t""", exam=EXAM_SQL))

oracle("heuristic_label", with_views(f"""
select record_id, {S.heuristic_label(X.EXAM_FIELDS, EXAM_PRESENT, 'h')} as heuristic_label
from (select *, {_HL} as h from exam) t""", exam=EXAM_SQL))

_SCORE_BASE = f"""
select *, case when rule_id is not null then 'expert_system' else 'heuristic_fallback' end as source,
       coalesce(rule_label, {S.heuristic_label(X.EXAM_FIELDS, EXAM_PRESENT, 'h')}) as final_label,
       case when rule_id is not null then rule_diagnosis else '' end as final_diagnosis,
       case when rule_id is not null then rule_trace else ['LightGBM 执行异常时启用保底启发式规则。'] end as final_trace
from (select *, {_HL} as h, {_R.first_match(_RS, 'rule_id')} as rule_id, {_R.first_match(_RS, 'label')} as rule_label,
             {_R.first_match(_RS, 'diagnosis')} as rule_diagnosis, {_R.first_match(_RS, 'trace')} as rule_trace
      from exam) t
"""

oracle("score_records", with_views(f"""
select record_id, source, final_label as label, final_diagnosis as diagnosis, rule_id,
       array_to_string(final_trace, chr(10)) as trace,
       {S.query_text(X.EXAM_FIELDS, EXAM_PRESENT | {'final_label', 'final_diagnosis'}, 'final_label', 'final_diagnosis', 'h')} as query
from scored""", exam=EXAM_SQL, scored=_SCORE_BASE))


# ------------------------------------------------------------------ prep

from .. import constants as C  # noqa: E402
from . import catalog as K  # noqa: E402

_STRINGS = X.EXAM_TEXT_COLUMNS
_NORMAL = ", ".join(S.q(v) for v in C.COMMON_NORMAL_VALUES)

oracle("norm_values", with_views("select record_id, " + ", ".join(
    f"case when {c} in ({_NORMAL}) then '无' else {c} end as {c}" for c in _STRINGS) + " from exam", exam=EXAM_SQL))

oracle("fill_rules", with_views("select record_id, " + ", ".join(
    f"coalesce({c}, {S.q(v)}) as {c}" for c, v in K.EXAM_FILL.items()) + " from exam", exam=EXAM_SQL))

oracle("binary_flags", with_views("select record_id, " + ", ".join(
    f"case when {c} is null then 0 when regexp_matches({S.txt(c)}, '无|未|不') then 0 else 1 end as {c}"
    for c in K.EXAM_BINARY) + " from exam", exam=EXAM_SQL))

oracle("duration_months", with_views(r"""
select record_id, tenure,
  coalesce(try_cast(regexp_extract(tenure, '^(\d+)年(\d+)月', 1) as bigint) * 12
           + try_cast(regexp_extract(tenure, '^(\d+)年(\d+)月', 2) as bigint), 0) as months,
  coalesce(regexp_matches(tenure, '^(\d+)年(\d+)月'), false) as valid
from exam""", exam=EXAM_SQL))

oracle("marker_fill", with_views("select record_id, " + ", ".join(
    f"coalesce({c}, '合格') as {c}" for c in EXAM_COLUMNS if "marker" in c) + " from exam", exam=EXAM_SQL))

_TOKENS = """
select record_id, trim(t) as token
from (select record_id, unnest(string_split(coalesce(exposure, ''), ',')) as t from exam) u
where trim(t) <> ''"""

oracle("hazard_top", with_views("""
select token, count(*) as n, round(count(*) / (select count(*) from exam), 6) as share
from toks group by token order by n desc, token limit 20""", exam=EXAM_SQL, toks=_TOKENS))

oracle("hazard_dummies", with_views("""
select distinct t.record_id, '危害因素_' || t.token as hazard
from toks t join (select token from toks group by token order by count(*) desc, token limit 20) v
  on t.token = v.token""", exam=EXAM_SQL, toks=_TOKENS))

oracle("hazard_dummies_fixed", with_views(f"""
select distinct record_id, '危害因素_' || token as hazard
from (select record_id, trim(t) as token
      from (select record_id, unnest(regexp_split_to_array(coalesce(exposure, ''), '[,、]')) as t from exam) u) s
where token in ({', '.join(S.q(t) for t in K.FIXED_HAZARDS)})""", exam=EXAM_SQL))

_STRICT = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"
oracle("smart_types", with_views(" union all ".join(
    f"select {S.q(c)} as column_name, round(avg(case when regexp_matches({S.txt(c)}, {_STRICT}) then 1.0 else 0.0 end), 6)"
    f" as conversion_rate, case when avg(case when regexp_matches({S.txt(c)}, {_STRICT}) then 1.0 else 0.0 end) > 0.8"
    f" then 'numeric' else 'categorical' end as kind from exam" for c in K.SMART_TYPE_COLUMNS), exam=EXAM_SQL))

_NON_STRING = {"record_id", "age", "exam_date"}
_STATS = " union all ".join(
    f"select {i} as ord, {S.q(c)} as column_name, {str(c not in _NON_STRING).lower()} as is_string, count({c}) as nn, "
    f"min({S.txt(c)}) as lo, max({S.txt(c)}) as hi, count(*) as n_rows from exam" for i, c in enumerate(EXAM_COLUMNS))
oracle("prep_report", with_views("""
select step, cast(row_number() over (partition by step order by ord) - 1 as int) as pos, column_name from (
  select ord, column_name,
    case when nn = 0 then 'full_missing_removed'
         when is_string and lo = hi then 'single_value_removed'
         when column_name in ('name') then 'privacy_removed'
         when contains(column_name, 'unit') then 'unit_columns_removed'
         else 'remaining' end as step from stats) s
union all
select 'shape', 0, cast(max(n_rows) as varchar) || 'x' || cast(count(*) as varchar) from stats
union all
select 'shape', 1, cast(max(n_rows) as varchar) || 'x' || cast(sum(case when nn > 0 and not (is_string and lo = hi)
       and column_name <> 'name' and not contains(column_name, 'unit') then 1 else 0 end) as varchar) from stats
""", exam=EXAM_SQL, stats=_STATS))


# ------------------------------------------------------------------ profile, labels, records

_LABEL_DIM = "(select * from (values " + ", ".join(f"({S.q(t)}, {c})" for c, t in C.LABELS.items()) + \
    ") d(label_text, code))"
_CODES = f"""
select record_id, case when code = 5 then 2 else code end as y
from (select record_id, {_label_text('label')} as label_text from exam where label is not null) e
left join {_LABEL_DIM} d using (label_text)
where code not in (3, 4)"""

oracle("missing_ratio", with_views(" union all ".join(
    f"select {S.q(c)} as column_name, round(avg(case when {c} is null then 1.0 else 0.0 end), 6) as missing_ratio "
    f"from exam" for c in EXAM_COLUMNS), exam=EXAM_SQL))

_STR_COLS = [c for c in EXAM_COLUMNS if c not in _NON_STRING]
oracle("column_profile", with_views(" union all ".join(
    f"select {S.q(c)} as column_name, count(distinct {c}) as n_distinct, count({c}) as non_null, "
    f"count(distinct {c}) = 1 as single_value from exam" for c in _STR_COLS), exam=EXAM_SQL))

oracle("label_distribution", with_views("""
select 'raw' as stage, label, count(*) as n, round(count(*) * 100.0 / (select count(*) from exam), 6) as pct
from exam group by label
union all
select 'filtered', cast(y as varchar), count(*), round(count(*) * 100.0 / (select count(*) from codes), 6)
from codes group by y""", exam=EXAM_SQL, codes=_CODES))

oracle("label_clean", with_views("select record_id, y from codes", exam=EXAM_SQL, codes=_CODES))

oracle("label_unknown", with_views(f"""
select label, count(*) as n from exam
where label is not null and label not in (select label_text from {_LABEL_DIM})
group by label""", exam=EXAM_SQL))

oracle("completeness", with_views("select record_id, " +
    " + ".join(f"(case when {c} is not null then 1 else 0 end)" for c in EXAM_COLUMNS) + " as field_score, " +
    " + ".join(f"(case when {S.is_non_empty(c)} then 1 else 0 end)" for c in EXAM_COLUMNS) + " as non_empty from exam",
    exam=EXAM_SQL))

_PROBE_COLS = [c for c in EXAM_COLUMNS if K.PROBE_KEYWORD in c]
oracle("value_probe", with_views("""
select column_name, value, n, cast(rank as int) as rank from (
  select column_name, value, n, row_number() over (partition by column_name order by n desc, value) as rank
  from (select column_name, value, count(*) as n from long where value is not null group by 1, 2) c) r
where rank <= 10""", exam=EXAM_SQL, long=" union all ".join(
    f"select {S.q(c)} as column_name, {S.txt(c)} as value from exam" for c in _PROBE_COLS)))

_COLS_SQL = " union all ".join(f"select {i} as ord, {S.q(c)} as column_name" for i, c in enumerate(EXAM_COLUMNS))
_KW_SQL = " union all ".join(f"select {i} as kord, {S.q(k)} as keyword" for i, k in enumerate(K.SEARCH_KEYWORDS))
oracle("column_search", with_views("""
select keyword, cast(row_number() over (partition by keyword order by ord) - 1 as int) as pos, column_name
from kws join cols on contains(column_name, keyword)""", cols=_COLS_SQL, kws=_KW_SQL))

oracle("samples_per_label", with_views("""
select record_id, label, coalesce(sbp_result, '') as sbp_result, coalesce(glucose_result, '') as glucose_result,
       coalesce(tenure, '') as tenure, sample_rank
from (select *, row_number() over (partition by label order by record_id) as sample_rank
      from exam where label is not null) t
where sample_rank <= 5""", exam=EXAM_SQL))

_FS = " + ".join(f"(case when {c} is not null then 1 else 0 end)" for c in EXAM_COLUMNS)
oracle("demo_samples", with_views(f"""
select expected_label || '_' || cast(record_id as varchar) as sample_id, expected_label, record_id,
       coalesce(expert_hit, '') as expert_hit, field_score, cast(sample_rank as int) as sample_rank
from (select *, row_number() over (partition by expected_label order by
          case when expected_label in ({S.q(C.LABELS[3])}, {S.q(C.LABELS[4])}) and expert_hit = expected_label
               then 0 else 1 end, field_score desc, record_id) as sample_rank
      from (select *, row_number() over (partition by expected_label order by field_score desc, record_id) as rn1
            from (select record_id, {_label_text('label')} as expected_label, {_FS} as field_score,
                         {_R.first_match(_RS, 'label')} as expert_hit from exam) b
            where expected_label is not null) c
      where rn1 <= 200) d
where sample_rank <= 4""", exam=EXAM_SQL))

_SPARSE_COLS = [c for c in EXAM_COLUMNS if c not in ("record_id", "name", "label")]
_ENTRIES = ", ".join(f"{{'k': {S.q(c)}, 'v': {S.txt(c)}}}" for c in _SPARSE_COLS)
oracle("sparse_record", with_views(f"""
select record_id, to_json(map_from_entries(e)) as record_json, cast(len(e) as int) as n_fields
from (select record_id, list_filter([{_ENTRIES}], lambda x: x.v is not null) as e from exam) t""", exam=EXAM_SQL))

_UNSAFE = '/\\:*?"<>| \t\n\r'
oracle("sanitize_names", f"""
select doc_id, translate(text, {S.q(_UNSAFE)}, {S.q('_' * len(_UNSAFE))}) as file_name,
       split_part(translate(text, {S.q(_UNSAFE)}, {S.q('_' * len(_UNSAFE))}), '_', 1) as base_name
from documents""")

oracle("safe_float", with_views(f"""
select record_id, {S.safe_float('sbp_result')} as sbp, {S.safe_float('glucose_result')} as glucose,
       {S.safe_float('lung_result', None)} as lung, {S.safe_float('tenure', -1.0)} as tenure from exam""",
    exam=EXAM_SQL))

oracle("norm_ws", f"""
select doc_id, cast(length({S.norm_ws('text')}) as bigint) as n_chars, md5({S.norm_ws('text')}) as text_md5
from documents""")
