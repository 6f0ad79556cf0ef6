"""DuckDB oracle for the file keys."""

from __future__ import annotations

from .. import constants as C
from . import q_files as K
from . import sqlgen as S
from .oracle import ORACLE, oracle
from .oracle_metrics import CELLS
from .views import EXAM_SQL, PRED_SQL, with_views

oracle("cohort_csv", with_views("select " + ", ".join(f"nullif(cast({c} as varchar), '') as {c}" for c in K.COHORT) + " from exam",
                                exam=EXAM_SQL))
oracle("demo_samples_kept", ORACLE["demo_samples"])

_NAMES = " ".join(f"when {k} then {S.q(n)}" for k, n in K.LABEL_NAMES.items())
_COUNTS = ", ".join(f"cast(coalesce(sum(case when p = {k} then n end), 0) as bigint) as predicted_{k}" for k in C.THREE_CLASS)
oracle("confusion_csv", with_views(f"""
select m.model, case c.y {_NAMES} end as label, {_COUNTS}
from (select distinct model from pred) m cross join (select unnest({list(C.THREE_CLASS)}) as y) c
left join cells on cells.model = m.model and cells.y = c.y
group by m.model, c.y""", pred=PRED_SQL, cells=CELLS))
