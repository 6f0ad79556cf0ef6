"""DuckDB oracle for schema alignment and SMOTE."""

from __future__ import annotations

from .. import constants as C
from . import q_models as K
from . import sqlgen as S
from .oracle import oracle
from .oracle_models import _FB, _LONG, _SAFE_VIEWS, _VOCAB
from .views import with_views

_STRICT = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"


def _num(c: str) -> str:
    t = "'0'" if c not in ("age", "hearing_high_result", "hearing_speech_result", "dbp_result") else f"cast({c} as varchar)"
    return f"coalesce(case when regexp_matches({t}, {_STRICT}) then try_cast(trim({t}) as double) end, 0.0) as {c}"


_ALONG = " union all ".join(
    f"select record_id, '{c}' as column_name, {S.norm_ws(c) if c != 'absent_category' else chr(39) * 2} "
    f"as value from exam" for c in K.ALIGN_CATEGORICAL)
oracle("align_features", with_views(f"""
select n.record_id, {', '.join('n.' + c for c in K.ALIGN_NUMERIC)},
       {', '.join(f"cast(e.{c} as double) as {c}" for c in K.ALIGN_CATEGORICAL)}
from (select record_id, {', '.join(_num(c) for c in K.ALIGN_NUMERIC)} from exam) n
join (select record_id, {', '.join(f"max(case when column_name = '{c}' then code end) as {c}" for c in K.ALIGN_CATEGORICAL)}
      from (select record_id, l.column_name, coalesce(v.code, fb.fallback_code, 0) as code
            from along l left join vocab v on l.column_name = v.column_name and l.value = v.value
            left join fb on l.column_name = fb.column_name) x group by record_id) e on n.record_id = e.record_id""",
    **_SAFE_VIEWS, along=_ALONG))

# the stored plan: fills, parsed numbers, coded and uncoded categories, hazard tokens
_PARSE = lambda t, c: f"coalesce(case when regexp_matches({t}, {_STRICT}) then try_cast(trim({t}) as double) end, 0.0) as {c}"


def _filled(c: str) -> str:
    if c.startswith("absent"):
        return "'0'"
    return f"coalesce({S.txt(c)}, {S.q(K.SERVE_FILLS[c])})" if c in K.SERVE_FILLS else S.txt(c)


_SLONG = " union all ".join(f"select record_id, '{c}' as column_name, case when {c} is not null then {S.norm_ws(c)} end as value"
                            f" from exam" for c in K.SERVE_CODED)
_SERVE_VIEWS = dict(_SAFE_VIEWS, long=_SLONG)
_STOKENS = "select record_id, list_transform(regexp_split_to_array(coalesce(exposure, ''), '[,、]'), lambda t: trim(t)) as toks from exam"
_SERVED = f"""
select e.record_id, {', '.join(_PARSE(_filled(c), c) for c in K.SERVE_NUMERIC)},
       {', '.join(f"cast(c.{c} as double) as {c}" for c in K.SERVE_CODED)},
       {_PARSE(S.norm_ws('dbp_result'), 'dbp_result')}, cast(0 as double) as absent_category,
       {', '.join(f"cast(list_contains(toks, {S.q(t)}) as double) as hazard_{i}" for i, t in enumerate(K.FIXED_HAZARDS))}
from exam e join stoks using (record_id) join (
  select record_id, {', '.join(f"max(case when column_name = '{c}' then code end) as {c}" for c in K.SERVE_CODED)}
  from (select record_id, l.column_name, coalesce(v.code, fb.fallback_code, 0) as code
        from long l left join vocab v on l.column_name = v.column_name and l.value = v.value
        left join fb on l.column_name = fb.column_name) x group by record_id) c using (record_id)"""
oracle("serve_features", with_views(_SERVED, **_SERVE_VIEWS, stoks=_STOKENS))
oracle("stream_features", with_views(_SERVED, **_SERVE_VIEWS, stoks=_STOKENS))

_FEATURES = [*K.SERVE_NUMERIC, *K.SERVE_CATEGORICAL, *("hazard:" + t for t in K.FIXED_HAZARDS)]
_NUMBERS = f"""select {', '.join(_PARSE(_filled(c), c) for c in K.SERVE_NUMERIC)} from exam
where record_id in (select record_id from split where split = 'train')"""
oracle("training_artefacts", with_views(f"""
select 'split' as kind, split || ':' || y as name, cast(count(*) as double) as value from split group by split, y
union all select 'vocabulary', column_name, cast(count(*) as double) from vocab group by column_name
union all select 'feature', name, cast(position as double) from (values {', '.join(f"({S.q(f)}, {i})" for i, f in enumerate(_FEATURES))}) f(name, position)
""" + "".join(f"union all select 'mean', '{c}', round(avg({c}), 6) from numbers union all select 'std', '{c}', round(stddev_pop({c}), 6) from numbers\n"
             for c in K.SERVE_NUMERIC), **_SERVE_VIEWS, numbers=_NUMBERS))

_P = 2147483647
_KEY = "cast(label as varchar) || ':' || cast(j as varchar)"
oracle("smote", f"""
with sizes as (select label, count(*) as n from embeddings group by label),
draws as (select s.label, s.n, j from sizes s, range(0, (select max(n) from sizes)) r(j)
          where j < (select max(n) from sizes) - s.n),
d1 as (select *, ({S.portable_hash('smote-base', _KEY)} % n) + 1 as base_pos,
              cast(({S.portable_hash('smote-nn', _KEY)} % {K.KNN_K}) + 1 as int) as nn_rank,
              ((j % {_P}) + {_P}) % {_P} * 48271 as t0 from draws),
d2 as (select *, (t0 + (cast(label as bigint) + 1) * 16807 + {C.SEED}) % {_P} as x1 from d1),
d3 as (select *, ((x1 * x1) % {_P} * 69621 + x1 * 40692 + 1) % {_P} as x2 from d2),
d4 as (select *, (((x2 * x2) % {_P} * 48271 + x2 * 16807 + 7) % {_P}) / cast({_P} as double) as gap from d3),
pos as (select vec_id, label, row_number() over (partition by label order by vec_id) as pos from embeddings),
nb as (select * from (
         select a.vec_id as base_id, b.vec_id as neighbor_id,
                row_number() over (partition by a.vec_id order by
                  list_distance(cast(a.embedding as double[]), cast(b.embedding as double[])), b.vec_id) as nn_rank
         from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id) t
       where nn_rank <= {K.KNN_K})
select d4.label, j, p.vec_id as base_id, nb.neighbor_id, round(gap, 6) as gap,
       array_to_string(list_transform(list_zip(cast(eb.embedding as double[]), cast(en.embedding as double[])),
         lambda x: cast(cast(floor((x[1] + gap * (x[2] - x[1])) * 1e4) as bigint) as varchar)), ',') as x_e4
from d4 join pos p on d4.label = p.label and d4.base_pos = p.pos
join nb on nb.base_id = p.vec_id and nb.nn_rank = d4.nn_rank
join embeddings eb on eb.vec_id = p.vec_id join embeddings en on en.vec_id = nb.neighbor_id""")
_ = (_FB, _LONG, _VOCAB)
