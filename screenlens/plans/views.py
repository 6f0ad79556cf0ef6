"""DuckDB text of the derived test views (FIXTURES.md §3), usable as CTEs."""

from __future__ import annotations

EXAM_SQL = """
with b as (select o.*, c.*, cast(floor(o_totalprice) as bigint) tp, cast(floor(abs(c_acctbal)) as bigint) ab
             from orders o join customer c on o_custkey = c_custkey),
     h as (select l_orderkey, string_agg(distinct case when p_type = 'LARGE' then 'LARGE、XL' else p_type end, ','
                    order by case when p_type = 'LARGE' then 'LARGE、XL' else p_type end) as exposure
             from lineitem join part on l_partkey = p_partkey group by l_orderkey),
     n as (select b.*, h.exposure, 90 + cast(floor(o_totalprice / 5000) as bigint) sv, 55 + tp % 60 dv, 30 + tp % 60 gv,
                  ab % 70 hv, (ab + 13) % 60 spv
             from b left join h on o_orderkey = l_orderkey)
select o_orderkey as record_id, c_name as name, o_orderdate as exam_date, c_mktsegment as job,
  case when c_custkey % 2 = 0 then 'M' else 'F' end as gender, cast(18 + c_custkey % 48 as int) as age,
  case when o_orderkey % 23 = 0 then null when o_orderkey % 7 = 0 then ''
       else cast(o_orderkey % 31 as varchar(20)) || '年' || cast(o_orderkey % 12 as varchar(20)) || '月' end as tenure,
  exposure,
  case when o_orderkey % 13 = 0 then null when o_orderkey % 17 = 0 then '未检'
       when o_orderkey % 19 = 0 then cast(sv as varchar(20)) || ' mmHg' else cast(sv as varchar(20)) end as sbp_result,
  'mmHg' as sbp_unit,
  case when o_orderkey % 11 = 0 then null when sv >= 140 then '不合格' else '合格' end as sbp_marker,
  cast(dv as varchar(20)) as dbp_result,
  case when o_orderkey % 3 = 0 then null else cast(cast(floor(gv / 10.0) as bigint) as varchar(20)) || '.' || cast(gv % 10 as varchar(20)) end as glucose_result,
  case o_orderpriority when '1-URGENT' then '轻度阻塞性' when '2-HIGH' then '中度拘束性' when '3-MEDIUM' then '未见异常'
       when '4-NOT SPECIFIED' then '　肺功能　 正常 ' else null end as lung_result,
  case when o_orderkey % 40 = 0 then '尘肺样改变' when o_orderkey % 40 < 4 then '其他异常' when o_orderkey % 40 = 4 then '未检查' else '未见异常' end as chest_judgment,
  case when o_orderkey % 40 < 4 then '不合格' else '合格' end as chest_marker,
  cast(hv as varchar(20)) as hearing_high_result,
  case when hv >= 25 then '不合格' else '合格' end as hearing_high_marker,
  cast(spv as varchar(20)) as hearing_speech_result,
  case when spv >= 25 then '不合格' when o_orderkey % 5 = 0 then null else '合格' end as hearing_speech_marker,
  case when o_orderkey % 9 = 0 then '咳嗽' when o_orderkey % 9 = 1 then '无特殊情况' when o_orderkey % 9 = 2 then null else '无' end as symptom,
  cast(null as varchar(20)) as spare_result,
  case when o_orderkey % 97 = 0 then null when o_orderkey % 211 = 0 then 'suspected' when o_orderkey % 50 = 0 then 'contraindication'
       when o_orderstatus = 'F' then 'other' when o_orderstatus = 'O' then 'normal' else 'recheck' end as label
from n
"""

PRED_SQL = """
with w as (select o_orderkey as row_id, case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as y,
   1 + o_custkey % 7 a, 1 + o_orderkey % 5 b, 1 + cast(floor(o_totalprice) as bigint) % 11 d from orders),
 m as (select * from (values ('m0', 6), ('m1', 4), ('m2', 2)) t(model, boost)),
 s as (select model, row_id, y, a + case when y = 0 and row_id % 10 < 6 then boost else 0 end a,
   b + case when y = 1 and row_id % 10 < 6 then boost else 0 end b, d + case when y = 2 and row_id % 10 < 6 then boost else 0 end d from w cross join m)
select model, row_id, y, case when a >= b and a >= d then 0 when b >= d then 1 else 2 end as p,
  cast(a as double)/(a+b+d) as p0, cast(b as double)/(a+b+d) as p1, cast(d as double)/(a+b+d) as p2 from s
"""

EXAM_COLUMNS = ["record_id", "name", "exam_date", "job", "gender", "age", "tenure", "exposure", "sbp_result",
                "sbp_unit", "sbp_marker", "dbp_result", "glucose_result", "lung_result", "chest_judgment",
                "chest_marker", "hearing_high_result", "hearing_high_marker", "hearing_speech_result",
                "hearing_speech_marker", "symptom", "spare_result", "label"]


def with_views(body: str, **views: str) -> str:
    """Prefix ``body`` with named CTEs; each view text is a complete SELECT."""
    ctes = ",\n".join(f"{name} as ({sql})" for name, sql in views.items())
    return f"with {ctes}\n{body}"
