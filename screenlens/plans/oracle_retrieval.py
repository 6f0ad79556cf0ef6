"""DuckDB oracle for the retrieval keys (KB x QUERY, VEC)."""

from __future__ import annotations

from .. import constants as C
from . import sqlgen as S
from .oracle import oracle
from .views import with_views

K = C.DEFAULT_TOP_K
TOKEN_RE = r"'[\p{L}\p{N}]+'"
WS_RE = r"'[\s\x{3000}\x{00a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{1680}\x{85}\x{0b}]+'"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({S.norm_ws(x)}), {TOKEN_RE})"


_KB0 = f"""
select doc_id, {S.norm_ws('substr(text, 1, 24)')} as title, source,
  case when doc_id % 10 = 0 then '{C.REFERENCE_TYPE}' else 'note' end as type,
  coalesce(toks[1], '') as metric_name, coalesce(toks[2], '') as hazard, text
from (select *, {tokens('text')} as toks from documents) d"""
_PIECES = ["title", "source", "hazard", "type", "''", "metric_name", "''", "''", "text", "''", "text"]
_KB = (f"select *, array_to_string(list_filter([{', '.join(S.norm_ws(p) for p in _PIECES)}], lambda x: x <> ''), ' ') "
       f"as search_text from kb0")
KB_VIEWS = dict(kb0=_KB0, kb=_KB)

oracle("kb_documents", with_views("""
select doc_id, title, source, type, metric_name, hazard, cast(length(search_text) as bigint) as n_chars,
       md5(search_text) as search_md5 from kb""", **KB_VIEWS))

_QN = S.norm_ws("text")
_GUARD = f"regexp_replace(regexp_replace({_QN}, '(\\d)\\.(\\d)', '\\1' || chr(1) || '\\2'), '(\\d)\\.(\\d)', '\\1' || chr(1) || '\\2')"
_PARTS = (f"list_filter(list_transform(regexp_split_to_array({_GUARD}, '[；;。.\\n]'), "
          f"lambda p: {S.norm_ws('replace(p, chr(1), ' + chr(39) + '.' + chr(39) + ')')}), lambda p: p <> '')")
QV = f"""
select qid, v, pos from (
  select qid, v, pos, row_number() over (partition by qid order by pos) as rn from (
    select qid, v, min(pos) as pos from (
      select qid, unnest(allv) as v, generate_subscripts(allv, 1) as pos
      from (select item_id as qid, list_concat([{_QN}], {_PARTS}) as allv from benchmark where {_QN} <> '') a) b
    group by qid, v) c) d
where rn <= {C.MAX_VARIANTS}"""

oracle("query_variants", with_views("""
select b.item_id as qid, cast(coalesce(n, 0) as int) as n_variants, coalesce(variants, '') as variants
from benchmark b left join (select qid, count(*) as n, string_agg(v, ' || ' order by pos) as variants from qv group by qid) q
  on b.item_id = q.qid""", qv=QV))

# ---------------------------------------------------------------- BM25
BM25_VIEWS = dict(
    toks=f"select doc_id, unnest({tokens('search_text')}) as term from kb",
    tf="select doc_id, term, count(*) as tf from toks group by all",
    dl="select doc_id, count(*) as dl from toks group by all",
    stats="select (select count(*) from kb) as n, (select count(*) from toks) / (select count(*) from kb) as avgdl",
    idf0="select term, ln((n - df + 0.5) / (df + 0.5)) as idf0 from (select term, count(*) as df from tf group by term) d, stats",
    idf=f"select term, case when idf0 < 0 then (select avg(idf0) from idf0) * {C.BM25_EPSILON} else idf0 end as idf from idf0",
    post=f"""select doc_id, term, idf * tf * ({C.BM25_K1} + 1) / (tf + {C.BM25_K1} * (1 - {C.BM25_B} + {C.BM25_B} * dl / avgdl)) as w
             from tf join dl using (doc_id) join idf using (term), stats""",
)


def bm25_scores(qterms: str, qkey: str) -> str:
    return f"select {qkey}, doc_id, sum(qtf * w) as score from post join {qterms} using (term) group by all"


def topk(src: str, key: str, cols: str, k: int = K) -> str:
    return f"""select {cols} from (select *, cast(row_number() over (partition by {key} order by score desc, doc_id) as int)
              as rank from {src}) r where rank <= {k}"""


_QT = f"select qid, term, count(*) as qtf from (select item_id as qid, unnest({tokens('text')}) as term from benchmark) t group by all"
oracle("bm25_topk", with_views(topk("sc", "qid", "qid, rank, doc_id, score"), **KB_VIEWS, **BM25_VIEWS, qt=_QT,
                               sc=f"select qid, doc_id, round(score, 6) as score from ({bm25_scores('qt', 'qid')}) s"))

# ---------------------------------------------------------------- char_wb TF-IDF


def grams(src: str, key: str, text: str) -> str:
    """(key, term) rows: char 2-4-grams of space-padded lower-cased words."""
    return f"""
select {key}, substr(p, gpos + 1, n) as term from (
  select {key}, p, n, unnest(generate_series(0, length(p) - n)) as gpos
  from (select {key}, ' ' || w || ' ' as p
        from (select {key}, unnest(regexp_split_to_array(lower(coalesce({text}, '')), {WS_RE})) as w from {src}) a
        where w <> '') b, range(2, 5) r(n)
  where n <= length(p)) c"""


TFIDF_VIEWS = dict(
    dgrams=grams("kb", "doc_id", "search_text"),
    counts="select doc_id, term, count(*) as tf from dgrams group by all",
    vocab=f"""select term, df, cf, ln((1 + (select count(*) from kb)) / (1 + df)) + 1 as idf from (
               select term, cast(sum(tf) as bigint) as cf, count(*) as df from counts group by term
               order by cf desc, term limit {C.TFIDF_MAX_FEATURES}) v""",
    wx="select doc_id, term, tf * idf as x from counts join vocab using (term)",
    dw="select doc_id, term, x / sqrt(sum(x * x) over (partition by doc_id)) as w from wx",
)

oracle("tfidf_weights", with_views("select term, df, cf, round(idf, 6) as idf from vocab", **KB_VIEWS, **TFIDF_VIEWS))

_QW = f"""
select qid, term, x / sqrt(sum(x * x) over (partition by qid)) as qw from (
  select qid, term, count(*) * max(idf) as x
  from ({grams("(select item_id as qid, text from benchmark)", "qid", "text")}) g join vocab using (term) group by all) q"""
oracle("tfidf_topk", with_views(topk("sc", "qid", "qid, rank, doc_id, score"), **KB_VIEWS, **TFIDF_VIEWS, qw=_QW,
                                sc="select qid, doc_id, round(sum(qw * w), 6) as score from dw join qw using (term) group by all"))

# ---------------------------------------------------------------- dense vectors
oracle("dense_topk", f"""
select vec_id, rank, neighbor_id, round(score, 6) as score from (
  select a.vec_id, b.vec_id as neighbor_id, list_inner_product(cast(a.embedding as double[]), cast(b.embedding as double[])) as score,
         cast(row_number() over (partition by a.vec_id order by
              list_inner_product(cast(a.embedding as double[]), cast(b.embedding as double[])) desc, b.vec_id) as int) as rank
  from embeddings a join embeddings b on a.vec_id <> b.vec_id) t
where rank <= {K}""")
