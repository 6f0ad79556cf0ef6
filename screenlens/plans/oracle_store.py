"""DuckDB oracle for the stored-table keys."""

from __future__ import annotations

from .. import constants as C
from ..sources import fixtures as X
from . import q_store as K
from . import sqlgen as S
from .oracle import _SCORE_BASE, _label_text, oracle
from .views import EXAM_COLUMNS, EXAM_SQL, with_views

_FIELDS = [c for c in EXAM_COLUMNS if c not in ("record_id", "name", "label")]


def _json_map(pairs: list[tuple[str, str]]) -> str:
    entries = ", ".join(f"{{'k': {S.q(k)}, 'v': {S.txt(v)}}}" for k, v in pairs)
    return f"to_json(map_from_entries(list_filter([{entries}], lambda x: x.v is not null)))"


_RECORDS = f"""
select record_id, 'doctor' || cast(record_id % 7 as varchar) as username, input_mode,
  case when input_mode = 'dataset' then coalesce({_label_text('label')}, '') || '_' || cast(record_id as varchar)
       else '' end as sample_id,
  final_label, source as final_source, final_diagnosis as diagnosis, rule_id, 'template_fallback' as advice_mode,
  strftime(exam_date, '%Y-%m-%d %H:%M:%S') as created_at,
  {_json_map([(c, c) for c in _FIELDS])} as record_json,
  {_json_map([('source', 'source'), ('label', 'final_label'), ('diagnosis', 'final_diagnosis'), ('rule_id', 'rule_id')])}
    as result_json
from (select *, ['dataset', 'manual', 'upload'][record_id % 3 + 1] as input_mode from scored) s"""

_SAVED = "select row_number() over (order by created_at, record_id) as id, * from records"
_TAG = (f"case when final_source = 'expert_system' then (case when trim(coalesce(rule_id, '')) <> '' "
        f"then '{C.RULE_HIT} ' || trim(rule_id) else '{C.RULE_HIT}' end) else '{C.RULE_MISS}' end")
_CASES = f"""
select row_number() over (order by created_at, record_id) as id, username, final_label, diagnosis, diagnosis as note,
  created_at, record_json, result_json, {_TAG} as rule_hit_tag, '{X.RULE_VERSION}' as rule_version, record_id
from records where final_source = 'expert_system'"""
_LOG = """
select event_id as id, strftime(ts, '%Y-%m-%d %H:%M:%S') as created_at,
  case when trim(coalesce('user' || cast(user_id as varchar), '')) = '' then 'anonymous'
       else trim(coalesce('user' || cast(user_id as varchar), '')) end as username,
  trim(coalesce(event_type, '')) as action, trim(coalesce(props, '')) as detail, ts
from events"""

_V = dict(exam=EXAM_SQL, scored=_SCORE_BASE, records=_RECORDS)


def _kw(cols: list[str], kw: str) -> str:
    return "(" + " or ".join(f"coalesce(contains(lower(cast({c} as varchar)), {S.q(kw.lower())}), false)"
                             for c in cols) + ")"


def _sel(cols: list[str]) -> str:
    return ", ".join(f"coalesce(cast({c} as varchar), '') as {c}" for c in cols)


oracle("append_records", with_views("""
select id, record_id, username, input_mode, sample_id, final_label, final_source, diagnosis, rule_id, advice_mode,
       created_at, result_json from saved""", **_V, saved=_SAVED))

oracle("case_library", with_views("""
select id, username, final_label, diagnosis, note, created_at, rule_hit_tag, rule_version, record_id from cases""",
                                  **_V, cases=_CASES))

oracle("log_append", with_views("""
select row_number() over (order by ts, id) as id, username, action, detail, created_at, id as event_id from log""",
                                log=_LOG))

_LIST_RECORDS = f"""
select {_sel(K.RECORD_LIST)} from (select * from saved
where {_kw(K.RECORD_KEYWORD_COLUMNS, K.RECORD_SEARCH['keyword'])} and final_label = {S.q(K.RECORD_SEARCH['final_label'])}
order by id desc limit {C.LIST_LIMIT}) t"""

oracle("list_records", with_views(_LIST_RECORDS, **_V, saved=_SAVED))

oracle("list_cases", with_views(f"""
select {_sel(K.CASE_LIST)} from (select * from cases
where starts_with(rule_hit_tag, {S.q(K.CASE_SEARCH['rule_hit_tag'])}) and {_kw(['rule_version'], K.CASE_SEARCH['rule_version'])}
order by id desc limit {C.LIST_LIMIT}) t""", **_V, cases=_CASES))

oracle("list_logs", with_views(f"""
select {_sel(K.LOG_LIST)} from (select * from log
where {_kw(K.LOG_KEYWORD_COLUMNS, K.LOG_SEARCH['keyword'])} and {_kw(['action'], K.LOG_SEARCH['action'])}
  and {_kw(['username'], K.LOG_SEARCH['username'])}
order by id desc limit {C.LIST_LIMIT}) t""", log=_LOG))

oracle("replay_records", with_views("""
select id, cast(len(json_keys(record_json)) as int) as n_fields, json_extract_string(result_json, '$.label') as label,
       json_extract_string(result_json, '$.source') as source, json_extract_string(record_json, '$.sbp_result') as sbp_result
from saved where id in (select cast(id as bigint) from listed)""", **_V, saved=_SAVED, listed=_LIST_RECORDS))
