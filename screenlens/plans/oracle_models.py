"""DuckDB oracle for scorecards, lineitem feature operators, EXAM encoders and kNN."""

from __future__ import annotations

from .. import constants as C
from . import oracle_metrics as OM
from . import q_models as K
from . import sqlgen as S
from .oracle import _CODES, oracle
from .views import EXAM_SQL, with_views

# ---------------------------------------------------------------- scorecards
_TIME = lambda times, col="model": f"case {col} " + " ".join(f"when '{k}' then {float(v)!r}" for k, v in times.items()) + " end"
_POINT = "select model, accuracy, f1_macro from sm_cells"
_OLD = {k: v for k, v in K.TRAIN_SECONDS.items() if k != "m2"}
oracle("scorecard_upsert", with_views(f"""
select model, round(accuracy, 6) as accuracy, round(f1_macro, 6) as f1_macro, train_seconds from (
  select *, {_TIME(_OLD)} as train_seconds from point
  where model in ({', '.join(S.q(m) for m in _OLD)}) and model not in ({', '.join(S.q(m) for m in K.RETRAINED)})
  union all
  select *, {_TIME(K.RETRAINED)} from point where model in ({', '.join(S.q(m) for m in K.RETRAINED)})) u""",
    **OM._base, point=_POINT))

_REPS100 = OM._REPS.replace("range(500)", f"range({K.CI_REPLICATES})")
_BOUNDS = ", ".join(f"max(case when metric = '{m}' then {b} end) as {m}_{b}" for m in K.CARD_METRICS for b in ("lo", "hi"))
_CARD = f"""
select p.*, {_TIME(K.TRAIN_SECONDS, "p.model")} as train_seconds, b.* exclude (model)
from (select * from sm_cells join auc using (model) join brier using (model)) p left join (
  select model, {_BOUNDS} from (
    select model, metric, quantile_cont(value, {C.CI_ALPHA / 2}) as lo, quantile_cont(value, {1 - C.CI_ALPHA / 2}) as hi
    from rep_long where value is not null group by all) s group by model) b on p.model = b.model"""
_CARD_VIEWS = dict(**OM._base, auc=OM.AUC, brier=OM.BRIER, reps=_REPS100, rcells=OM._RCELLS, **OM.class_sql("rcells", ["model", "rep"]),
                   rauc=OM._RAUC, rep_long=OM._REP_LONG, card=_CARD)

_COMPOSITE = "(" + " + ".join(C.RADAR_METRICS) + f") / {len(C.RADAR_METRICS)}"
oracle("model_ranking", with_views(f"""
select model, round(composite, 6) as composite, round(time_share, 6) as time_share,
       cast(rank() over (order by composite desc) as int) as rank
from (select model, {_COMPOSITE} as composite, train_seconds / sum(train_seconds) over () as time_share from card) c""",
    **_CARD_VIEWS))

_RLONG = " union all ".join(f"select model, '{m}' as metric, {m} as value, {m}_lo as lo, {m}_hi as hi from card"
                            for m in C.RADAR_METRICS)
oracle("model_radar", with_views("""
select model, metric, round((value - vmin) / span, 6) as value_scaled, round((lo - vmin) / span, 6) as lo_scaled,
       round((hi - vmin) / span, 6) as hi_scaled
from rlong join (select metric, min(value) as vmin, case when max(value) - min(value) > 0 then max(value) - min(value)
                 else 1.0 end as span from rlong group by metric) r using (metric)""", **_CARD_VIEWS, rlong=_RLONG))

_CLONG = " union all ".join(f"select model, '{m}' as metric, {m} as value, {m}_lo as lower, {m}_hi as upper from card"
                            for m in K.CARD_METRICS)
oracle("ci_long", with_views("""
select model, metric, round(value, 6) as value, round(lower, 6) as lower, round(upper, 6) as upper,
       round(value - lower, 6) as err_low, round(upper - value, 6) as err_high from clong""",
    **_CARD_VIEWS, clong=_CLONG))

# ---------------------------------------------------------------- lineitem features
_LI = """
select l_orderkey, l_linenumber, cast(l_linenumber as double) as line_no, l_quantity, l_extendedprice, l_discount, l_tax,
       l_extendedprice * (1 - l_discount) as net_price, l_extendedprice * (1 - l_discount) * (1 + l_tax) as charge,
       l_extendedprice * l_discount as discount_sum, l_extendedprice * l_tax as tax_sum, l_returnflag as cls, row_number() over () as row_key
from lineitem"""
_Z = ", ".join(f"case when stddev_pop({f}) over () > 0 then ({f} - avg({f}) over ()) / stddev_pop({f}) over () "
               f"else 0.0 end as {f}" for f in K.ATTR_FEATURES)
_SCALED = f"select row_key, l_orderkey, l_linenumber, cls, {_Z} from li"

oracle("standard_scale", with_views(
    "select l_orderkey, l_linenumber, " + ", ".join(f"round({f}, 6) as {f}" for f in K.LI_FEATURES) + " from scaled",
    li=_LI, scaled=_SCALED))

oracle("gaussian_nb_stats", with_views(" union all ".join(
    f"select cls, '{f}' as feature, count(*) as n, round(count(*) / (select count(*) from li), 6) as prior, "
    f"round(avg({f}), 6) as mean, round(var_pop({f}), 6) as var from li group by cls" for f in K.LI_FEATURES), li=_LI))

_CLASSES = list(K.COEF)
_SCORE = {k: f"({float(K.INTERCEPT.get(k, 0.0))!r} + " + " + ".join(
    f"{float(c)!r} * {f}" for c, f in zip(K.COEF[k], K.ATTR_FEATURES)) + ")" for k in _CLASSES}
_PRED = "case " + " ".join(
    f"when {_SCORE[k]} >= greatest({', '.join(_SCORE[x] for x in _CLASSES)}) then '{k}'" for k in _CLASSES) + " end"
_ATTR = " union all ".join(
    f"select row_key, l_orderkey, l_linenumber, {_PRED} as predicted, '{k}' as cls, '{f}' as feature, "
    f"{float(K.COEF[k][i])!r} * {f} as contribution from scaled" for k in _CLASSES for i, f in enumerate(K.ATTR_FEATURES))
_AV = dict(li=_LI, scaled=_SCALED, attr=_ATTR)

oracle("feature_importance", with_views("""
select feature, cls, round(avg(abs(contribution)), 6) as mean_abs, split_part(feature, '_', 1) as base_name
from attr group by feature, cls
union all
select feature, '*', round(avg(abs(contribution)), 6), split_part(feature, '_', 1) from attr group by feature""", **_AV))

oracle("top_features", with_views(f"""
select l_orderkey, l_linenumber, predicted, rank, feature, round(contribution, 6) as contribution from (
  select *, cast(row_number() over (partition by row_key order by abs(contribution) desc, feature) as int) as rank
  from attr where cls = predicted) t
where rank <= {C.TOP_ATTRIBUTIONS}""", **_AV))

# ---------------------------------------------------------------- EXAM encoders
_SPLIT = f"""
select record_id, y, case when rn <= round(n * {C.TEST_SHARE}) then 'test' else 'train' end as split from (
  select *, row_number() over (partition by y order by h, record_id) as rn, count(*) over (partition by y) as n
  from (select *, {S.portable_hash('split42', 'record_id')} as h from codes) a) b"""
_SPLIT_VIEWS = dict(exam=EXAM_SQL, codes=_CODES, split=_SPLIT)
oracle("stratified_split", with_views("select record_id, y, split from split", **_SPLIT_VIEWS))

_LONG = " union all ".join(f"select record_id, '{c}' as column_name, case when {c} is not null then {S.norm_ws(c)} end as value from exam"
                           for c in K.CAT_COLUMNS)
_VOCAB = """select column_name, value, cast(dense_rank() over (partition by column_name order by value) - 1 as int) as code
            from (select distinct column_name, value from {src} where value is not null) d"""
oracle("category_encode", with_views("""
select record_id, column_name, code from long left join vocab using (column_name, value)""",
    exam=EXAM_SQL, long=_LONG, vocab=_VOCAB.format(src="long")))

_FB = "case value " + " ".join(f"when {S.q(v)} then {i}" for i, v in enumerate(C.ENCODE_FALLBACKS)) + " end"
_SAFE_VIEWS = dict(**_SPLIT_VIEWS, long=_LONG,
                   train_long="select * from long where record_id in (select record_id from split where split = 'train')",
                   vocab=_VOCAB.format(src="train_long"),
                   fb=f"select column_name, arg_min(code, {_FB}) as fallback_code from vocab where {_FB} is not null "
                      f"group by column_name")
oracle("safe_encode", with_views("""
select record_id, l.column_name, cast(coalesce(v.code, fb.fallback_code, 0) as int) as code
from long l left join vocab v on l.column_name = v.column_name and l.value = v.value
left join fb on l.column_name = fb.column_name""", **_SAFE_VIEWS))

# ---------------------------------------------------------------- kNN
oracle("knn_classify", f"""
with nb as (
  select * from (
    select a.vec_id, a.label, b.label as nlabel,
           list_distance(cast(a.embedding as double[]), cast(b.embedding as double[])) as dist,
           row_number() over (partition by a.vec_id order by
                              list_distance(cast(a.embedding as double[]), cast(b.embedding as double[])), b.vec_id) as r
    from embeddings a join embeddings b on a.vec_id <> b.vec_id) t where r <= {K.KNN_K}),
votes as (select vec_id, label, nlabel, count(*) as n, sum(case when dist = 0 then 1e300 else 1.0 / dist end) as wsum
          from nb group by all)
select vec_id, label, arg_max(nlabel, n * 1000 - nlabel) as pred_uniform,
       (select v2.nlabel from votes v2 where v2.vec_id = v.vec_id order by wsum desc, nlabel limit 1) as pred_distance
from votes v group by vec_id, label""")
