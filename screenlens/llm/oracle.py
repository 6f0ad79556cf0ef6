"""DuckDB twins of the operator queries that SQL can express."""

from __future__ import annotations

from . import op3_minhash

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP3 = f"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
                                    '[^\\x20\\x09-\\x0D]+') as w
  from documents),
sets as (
  select doc_id, case when len(w) = 0 then []
                      when len(w) < {op3_minhash.SHINGLE} then [array_to_string(w, ' ')]
                      else list_distinct(list_transform(range(1, len(w) - {op3_minhash.SHINGLE - 2}),
                             lambda i: array_to_string(w[i : i + {op3_minhash.SHINGLE - 1}], ' '))) end as s
  from words),
post as (select doc_id, unnest(s) as x from sets),
inter as (
  select a.doc_id as a, b.doc_id as b, count(*) as n
  from post a join post b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
link as (
  select a, b from inter join sets sa on sa.doc_id = a join sets sb on sb.doc_id = b
  where 100 * n >= {op3_minhash.SHARE} * (len(sa.s) + len(sb.s) - n)),
edge as (select a, b from link union select b, a from link),
reach as (
  select doc_id as start, doc_id as node from sets
  union
  select r.start, e.b from reach r join edge e on e.a = r.node),
least_id as (select start, min(node) as component_id from reach group by 1)
select s.doc_id, len(s.s)::bigint as n_shingles, component_id, s.doc_id = component_id as kept
from sets s join least_id l on l.start = s.doc_id
"""

OP11 = """
with docs as (
  select doc_id, coalesce(text, '') as t, coalesce(source, '') as part,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w
  from documents),
fails as (
  select d.doc_id, part, len(w) < 200 as A, 100 * len(list_distinct(w)) < 50 * len(w) as B,
         100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) as C,
         regexp_matches(t, '[#$%&*|]') as D,
         coalesce(d.doc_id > min(d.doc_id) over (partition by t), false) as E,
         coalesce(l.good, false) as good, coalesce(l.toxic, false) as toxic
  from docs d left join (
    select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic
    from labels group by 1) l on d.doc_id = l.doc_id),
cells as (
  select part, [A, B, C, D, E] as f, good, toxic, count(*) as n,
         A::int + B::int + C::int + D::int + E::int as many
  from fails group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order
  from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (
  select filter_order, step, ascii(filter_order[step]) - 64 as own,
         [ascii(filter_order[i]) - 64 for i in range(1, step)] as before
  from orders, unnest(range(1, 6)) as s(step)),
judged as (
  select part, filter_order, step, n, good, toxic, many, f[own] as own_fails,
         len(list_filter(before, lambda i: f[i])) > 0 as gone
  from cells, steps)
select part, filter_order, step::int as step,
       sum(case when not gone and not own_fails then n else 0 end)::bigint as kept,
       sum(case when not gone and own_fails then n else 0 end)::bigint as removed,
       sum(case when gone and own_fails then n else 0 end)::bigint as redundant,
       sum(case when own_fails and many = 1 then n else 0 end)::bigint as unique_fails,
       sum(case when not gone and own_fails and good then n else 0 end)::bigint as good_lost,
       sum(case when not gone and own_fails and toxic then n else 0 end)::bigint as toxic_lost,
       sum(case when own_fails then n * 120 // many else 0 end)::bigint as shapley
from judged group by all
"""

ORACLE = {"op3_near_duplicates": OP3, "op11_filter_audit": OP11}
