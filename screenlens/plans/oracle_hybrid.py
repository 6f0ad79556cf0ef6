"""DuckDB oracle for hybrid search (fusion, boosts) and its de-duplicated top-k."""

from __future__ import annotations

from .. import constants as C
from . import oracle_retrieval as R
from . import sqlgen as S
from .oracle import oracle
from .views import with_views

SK = max(C.DEFAULT_TOP_K * 6, 20)
_SKC = f"least({SK}, (select count(*) from kb))"


def _best(src: str) -> str:
    return f"""
select qid, doc_id, score, rank from (
  select qid, doc_id, score, row_number() over (partition by qid order by score desc, doc_id) as rank from (
    select qid, doc_id, max(score) as score from (
      select * from (select *, row_number() over (partition by qid, pos order by score desc, doc_id) as r from {src}) a
      where r <= {SK}) b
    group by all) c) d
where rank <= {_SKC}"""


def _norm(src: str, name: str) -> str:
    lo = (f"case when count(*) over (partition by qid) < {_SKC} then least(0.0, min(score) over (partition by qid)) "
          f"else min(score) over (partition by qid) end")
    return f"""
select qid, doc_id, case when abs(hi - lo) < {C.NORM_RANGE_EPS} then 1.0 else (score - lo) / (hi - lo) end as {name}
from (select *, {lo} as lo, max(score) over (partition by qid) as hi from {src}) t"""


def _any(text: str, tokens: list[str]) -> str:
    return "(" + " or ".join(f"contains({text}, {S.q(t)})" for t in tokens) + ")"


_M = S.norm_ws("metric_name")
_HZ = S.norm_ws("hazard")
_REF = f"({_M} <> '' and (contains(query, {_M}) or {_any('query', C.REFERENCE_QUERY_TOKENS)}))"
_JOINED = "(title || ' ' || text)"
_SCORE = f"""
  {C.DENSE_WEIGHT} * dense + {C.SPARSE_WEIGHT} * sparse
  + least(len(list_intersect(dtokens, qtokens)), {C.OVERLAP_CAP}) * {C.OVERLAP_WEIGHT}
  + {C.TITLE_WEIGHT} * len(list_intersect(ttokens, qtokens))
  + case when {_HZ} <> '' and {_HZ} <> {S.q(C.HAZARD_GENERIC)} and contains(query, {_HZ}) then {C.HAZARD_BOOST} else 0.0 end
  + case when type = '{C.REFERENCE_TYPE}' then (case when {_REF} then {C.REFERENCE_MATCH_BOOST}
         else {C.REFERENCE_MISS_PENALTY} end) else 0.0 end
  + case when {_M} <> '' and contains(query, {_M}) then {C.METRIC_BOOST} else 0.0 end
  + case when contains(query, {S.q(C.CONTRA_QUERY)}) and {_any(_JOINED, C.CONTRA_DOC_TOKENS)} then {C.CONTRA_BOOST} else 0.0 end
  + case when contains(query, {S.q(C.SUSPECT_QUERY)}) and {_any(_JOINED, C.SUSPECT_DOC_TOKENS)} then {C.SUSPECT_BOOST} else 0.0 end
  + case when contains(query, {S.q(C.RECHECK_QUERY)}) and {_any(_JOINED, C.RECHECK_DOC_TOKENS)} then {C.RECHECK_BOOST} else 0.0 end"""

VIEWS = dict(
    **R.KB_VIEWS, **R.BM25_VIEWS, **R.TFIDF_VIEWS, qv=R.QV,
    vqt=f"select qid, pos, term, count(*) as qtf from (select qid, pos, unnest({R.tokens('v')}) as term from qv) t group by all",
    sparse="select qid, pos, doc_id, round(sum(qtf * w), 9) as score from post join vqt using (term) group by all",
    vgrams=R.grams("qv", "qid, pos", "v"),
    vqw="""select qid, pos, term, x / sqrt(sum(x * x) over (partition by qid, pos)) as qw from (
             select qid, pos, term, count(*) * max(idf) as x from vgrams join vocab using (term) group by all) q""",
    dense="select qid, pos, doc_id, round(sum(qw * w), 9) as score from dw join vqw using (term) group by all",
    sbest=_best("sparse"), dbest=_best("dense"),
    snorm=_norm("sbest", "sparse"), dnorm=_norm("dbest", "dense"),
    fused="""select coalesce(d.qid, s.qid) as qid, coalesce(d.doc_id, s.doc_id) as doc_id,
                    coalesce(d.dense, 0.0) as dense, coalesce(s.sparse, 0.0) as sparse
             from dnorm d full join snorm s on d.qid = s.qid and d.doc_id = s.doc_id""",
    qrow=f"select item_id as qid, {S.norm_ws('text')} as query, list_distinct({R.tokens('text')}) as qtokens from benchmark",
    docs=f"""select doc_id, title, source, text, type, metric_name, hazard,
                    list_distinct({R.tokens('search_text')}) as dtokens, list_distinct({R.tokens('title')}) as ttokens from kb""",
    cand=f"select qid, doc_id, title, source, type, metric_name, query, dense, sparse, round({_SCORE}, 6) as score "
         f"from fused join qrow using (qid) join docs using (doc_id)",
)

oracle("hybrid_topk", with_views(f"""
select qid, rank, doc_id, score, round(dense, 6) as dense, round(sparse, 6) as sparse from (
  select *, cast(row_number() over (partition by qid order by score desc, doc_id) as int) as rank from cand) t
where rank <= {C.DEFAULT_TOP_K}""", **VIEWS))

oracle("dedupe_topk", with_views(f"""
select qid, rank, doc_id, title, type, score from (
  select *, cast(row_number() over (partition by qid order by score desc, doc_id) as int) as rank from (
    select * from (
      select *, row_number() over (partition by qid, is_ref order by score desc, doc_id) as rr from (
        select *, type = '{C.REFERENCE_TYPE}' as is_ref from (
          select *, row_number() over (partition by qid, title, source, coalesce(type, '') order by score desc, doc_id) as k1
          from cand where type <> '{C.REFERENCE_TYPE}' or {_REF}) a
        where k1 = 1) b) c
    where not is_ref or rr <= {C.REFERENCE_CAP}) d) e
where rank <= {C.DEFAULT_TOP_K}""", **VIEWS))

oracle("ranked_lists", with_views("""
select qid, 'sparse' as list, cast(rank as int) as rank, doc_id, round(score, 6) as score from sbest
union all select qid, 'dense', cast(rank as int), doc_id, round(score, 6) from dbest""", **VIEWS))
