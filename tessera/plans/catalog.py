"""All queries outside the training-data subpackage, with their SQL."""

from __future__ import annotations

from tessera.plans import q_encode, q_flows, q_learn, q_metrics, q_models, q_sources, q_tables

_MODULES = (q_tables, q_metrics, q_encode, q_models, q_sources, q_flows, q_learn)


def queries() -> dict:
    return {name: f for m in _MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
