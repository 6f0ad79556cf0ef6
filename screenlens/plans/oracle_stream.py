"""DuckDB oracle for the streaming keys: a stream's sink must equal the batch result."""

from __future__ import annotations

from .oracle import ORACLE, oracle
from .oracle_store import _LOG
from .views import with_views

oracle("stream_score", ORACLE["score_records"])
oracle("stream_log", with_views("select id, username, action, detail, created_at from log", log=_LOG))
oracle("stream_log_store", with_views("select id as event_id, username, action, detail, created_at, true as ids_dense "
                                      "from log where ts is not null and action <> ''", log=_LOG))
