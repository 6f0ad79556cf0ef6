"""Collects the query catalogue and the oracle SQL from their modules."""

from __future__ import annotations

import importlib

QUERY_MODULES = ["catalog", "q_store", "q_text", "q_retrieval", "q_models", "q_stream", "q_fitted", "q_serve", "q_files"]
ORACLE_MODULES = ["oracle", "oracle_metrics", "oracle_store", "oracle_text", "oracle_retrieval", "oracle_models", "oracle_stream", "oracle_hybrid", "oracle_features2", "oracle_files"]


def all_queries():
    for m in QUERY_MODULES:
        importlib.import_module(f"screenlens.plans.{m}")
    from .catalog import QUERIES
    return dict(QUERIES)


def all_oracles():
    for m in ORACLE_MODULES:
        importlib.import_module(f"screenlens.plans.{m}")
    from .oracle import ORACLE
    return dict(ORACLE)
