"""DuckDB oracle for the metric keys over PRED."""

from __future__ import annotations

from .. import constants as C
from ..operators.metrics import poisson_thresholds
from . import sqlgen as S
from .oracle import oracle
from .views import PRED_SQL, with_views

PROBS = ["p0", "p1", "p2"]
R6 = "round({0}, 6) as {0}"


def class_sql(cells: str, g: list[str]) -> dict[str, str]:
    """CTE texts: per-class table and summary metrics from a cells view (g..., y, p, n)."""
    gs = ", ".join(g)
    on = " and ".join(f"r.{x} = c.{x}" for x in g + ["cls"])
    co = ", ".join(f"coalesce(r.{x}, c.{x}) as {x}" for x in g)
    ct = f"""
select {co}, coalesce(r.cls, c.cls) as cls, coalesce(t_k, 0.0) as t_k, coalesce(tp, 0.0) as tp, coalesce(p_k, 0.0) as p_k
from (select {gs}, y as cls, sum(n) as t_k, sum(case when y = p then n else 0.0 end) as tp from {cells} group by all) r
full join (select {gs}, p as cls, sum(n) as p_k from {cells} group by all) c on {on}"""
    pc = f"""
select ct.*, n_total, p_k - tp as fp, t_k - tp as fn, n_total - t_k - p_k + tp as tn,
  case when p_k > 0 then tp / p_k else 0.0 end as precision,
  case when t_k > 0 then tp / t_k else 0.0 end as recall,
  case when t_k + p_k > 0 then 2 * tp / (t_k + p_k) else 0.0 end as f1,
  case when n_total - t_k > 0 then (n_total - t_k - p_k + tp) / (n_total - t_k) else 0.0 end as specificity,
  case when n_total - p_k > 0 then (n_total - t_k - p_k + tp) / (n_total - p_k) else 0.0 end as npv
from ct_{cells} ct join (select {gs}, sum(n) as n_total from {cells} group by all) t using ({gs})"""
    sm = f"""
select {gs}, c / s as accuracy, precision_macro, recall_macro, f1_macro, specificity_macro, npv_macro,
  case when (s * s - pp) * (s * s - tt) > 0 then (c * s - tp_sum) / sqrt((s * s - pp) * (s * s - tt)) else 0.0 end as mcc,
  case when tp_sum / (s * s) < 1 then (c / s - tp_sum / (s * s)) / (1 - tp_sum / (s * s)) end as kappa
from (select {gs}, sum(tp) as c, max(n_total) as s, sum(t_k * p_k) as tp_sum, sum(p_k * p_k) as pp,
             sum(t_k * t_k) as tt, avg(precision) as precision_macro, avg(recall) as recall_macro, avg(f1) as f1_macro,
             avg(specificity) as specificity_macro, avg(npv) as npv_macro
      from pc_{cells} group by all) a"""
    return {f"ct_{cells}": ct, f"pc_{cells}": pc, f"sm_{cells}": sm}


CELLS = "select model, y, p, cast(count(*) as double) as n from pred group by all"
BRIER_ROW = "((p0 - case when y = 0 then 1.0 else 0.0 end) ** 2 + (p1 - case when y = 1 then 1.0 else 0.0 end) ** 2 " \
            "+ (p2 - case when y = 2 then 1.0 else 0.0 end) ** 2) / 3.0"
BRIER = f"select model, avg({BRIER_ROW}) as brier from pred group by model"
AUC = """
select model, avg(auc) as auc_ovo_macro from (
  select model, a, b, sum(np * (neg_below + 0.5 * nn)) / (sum(np) * sum(nn)) as auc from (
    select *, coalesce(sum(nn) over (partition by model, a, b order by score
                                     rows between unbounded preceding and 1 preceding), 0.0) as neg_below from (
      select model, a, b, score, sum(case when pos then 1.0 else 0.0 end) as np, sum(case when pos then 0.0 else 1.0 end) as nn
      from (select model, a, b, case a when 0 then p0 when 1 then p1 else p2 end as score, y = a as pos
            from pred cross join (values (0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)) pr(a, b) where y in (a, b)) l
      group by all) bs) rk
  group by all) pp
group by model"""

_base = {"pred": PRED_SQL, "cells": CELLS, **class_sql("cells", ["model"])}

oracle("confusion_matrix", with_views(f"""
select model, case y {' '.join(f"when {k} then {S.q(C.LABELS[k])}" for k in C.THREE_CLASS)} end as true_label,
  {', '.join(f"cast(sum(case when p = {k} then n else 0 end) as bigint) as n_pred_{k}" for k in C.THREE_CLASS)}
from cells group by model, y""", pred=PRED_SQL, cells=CELLS))

oracle("per_class_metrics", with_views("""
select model, cast(cls as int) as cls, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn,
  cast(tn as bigint) as tn, """ + ", ".join(R6.format(c) for c in ("precision", "recall", "f1", "specificity", "npv")) +
    " from pc_cells", **_base))

ALL = ["accuracy", "precision_macro", "recall_macro", "f1_macro", "specificity_macro", "npv_macro", "mcc", "kappa",
       "brier", "auc_ovo_macro"]
_ALL_BODY = "from sm_cells join brier using (model) join auc using (model)"

oracle("metrics_all", with_views(" union all ".join(
    f"select model, '{c}' as metric, {R6.format(c).rsplit(' as ', 1)[0]} as value {_ALL_BODY}" for c in ALL),
    **_base, brier=BRIER, auc=AUC))

oracle("metrics_by_model", with_views(f"select model, {', '.join(R6.format(c) for c in ALL)} {_ALL_BODY}",
                                      **_base, brier=BRIER, auc=AUC))

oracle("brier_score", with_views("select model, round(brier, 6) as brier from brier", pred=PRED_SQL, brier=BRIER))

oracle("auc_ovo", with_views("select model, round(auc_ovo_macro, 6) as auc_ovo_macro from auc", pred=PRED_SQL, auc=AUC))

_X0 = "(((row_id % 2147483647) + 2147483647) % 2147483647)"
_X1 = f"(({_X0} * 48271 + (rep + 1) * 16807 + 42) % 2147483647)"
_U = ("(((x2 * x2) % 2147483647 * 48271 + x2 * 16807 + 7) % 2147483647) / cast(2147483647 as double)")
_W = " + ".join(f"(case when u >= {t!r} then 1 else 0 end)" for t in poisson_thresholds())
_REPS = f"""
select * from (
  select *, {_W} as w from (
    select *, {_U} as u from (
      select *, ((x1 * x1) % 2147483647 * 69621 + x1 * 40692 + 1) % 2147483647 as x2 from (
        select pred.*, rep, {_X1} as x1 from pred cross join range(500) r(rep)) a) b) c) d
where w > 0"""
_RCELLS = "select model, rep, y, p, cast(sum(w) as double) as n, sum(w * bw) as bw from (" \
          f"select *, {BRIER_ROW} as bw from reps) z group by all"
_RAUC = """
select model, rep, case when count(auc) = 6 then avg(auc) end as auc_ovo_macro from (
  select model, rep, a, b, case when sum(np) * sum(nn) > 0 then sum(np * (neg_below + 0.5 * nn)) / (sum(np) * sum(nn)) end
         as auc from (
    select *, coalesce(sum(nn) over (partition by model, rep, a, b order by score
                                     rows between unbounded preceding and 1 preceding), 0.0) as neg_below from (
      select model, rep, a, b, case a when 0 then p0 when 1 then p1 else p2 end as score,
             sum(case when y = a then w else 0.0 end) as np, sum(case when y = a then 0.0 else w end) as nn
      from (select model, rep, y, p0, p1, p2, sum(w) as w from reps group by all) c
        cross join (values (0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)) pr(a, b) where y in (a, b)
      group by all) bs) rk
  group by all) pp
group by all"""
_METRICS8 = ["accuracy", "precision_macro", "recall_macro", "f1_macro", "specificity_macro", "npv_macro", "mcc", "kappa"]
_REP_LONG = " union all ".join(
    f"select model, rep, '{m}' as metric, {m} as value from sm_rcells" for m in _METRICS8) + \
    " union all select model, rep, 'brier', sum(bw) / sum(n) from rcells group by model, rep" \
    " union all select model, rep, 'auc_ovo_macro', auc_ovo_macro from rauc"
_POINT_LONG = " union all ".join(
    f"select model, '{m}' as metric, {m} as estimate from sm_cells" for m in _METRICS8) + \
    " union all select model, 'brier', brier from brier" \
    " union all select model, 'auc_ovo_macro', auc_ovo_macro from auc"

oracle("bootstrap_ci", with_views("""
select p.model, p.metric, round(estimate, 6) as estimate, round(boot_mean, 6) as boot_mean, round(lo, 6) as lo,
       round(hi, 6) as hi, n_replicates
from point p left join (
  select model, metric, avg(value) as boot_mean, quantile_cont(value, 0.025) as lo, quantile_cont(value, 0.975) as hi,
         count(*) as n_replicates
  from rep_long where value is not null group by all) s on p.model = s.model and p.metric = s.metric""",
    **_base, brier=BRIER, auc=AUC, reps=_REPS, rcells=_RCELLS, **class_sql("rcells", ["model", "rep"]), rauc=_RAUC,
    rep_long=_REP_LONG, point=_POINT_LONG))

_IDX = "case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end"
oracle("argmax_label", with_views(f"""
select model, row_id, {_IDX} as pred_idx,
  case {_IDX} {' '.join(f"when {k} then {S.q(C.LABELS[k])}" for k in C.THREE_CLASS)} end as label,
  round(greatest(p0, p1, p2), 6) as p_max from pred""", pred=PRED_SQL))

_DISP = ("case when prob >= 0.99995 and prob < 1.0 then '>99.99%' when prob > 0.0 and prob <= 5e-05 then '<0.01%' "
         "else printf('%.2f', round_even(prob * 100, 2)) || '%' end")
_WIDTH = "case when prob <= 0 then 0.0 else greatest(2.0, prob * 100.0) end"
oracle("prob_display", with_views(f"""
select model, row_id, string_agg(label || '=' || {_DISP} || '|' ||
    printf('%.2f', round_even(case when prob < 1.0 and {_WIDTH} > 98.0 then 98.0 else {_WIDTH} end, 2)), ';'
    order by prob desc, idx) as display
from (select model, row_id, unnest([p0, p1, p2]) as prob, unnest([0, 1, 2]) as idx,
             unnest([{', '.join(S.q(C.LABELS[k]) for k in C.THREE_CLASS)}]) as label from pred) t
group by model, row_id""", pred=PRED_SQL))

oracle("explain_sample", with_views(f"""
select model, row_id, y, p from pred
qualify row_number() over (partition by model order by {S.portable_hash('explain', 'row_id')}, row_id)
        <= {C.EXPLAIN_SAMPLE}""", pred=PRED_SQL))
