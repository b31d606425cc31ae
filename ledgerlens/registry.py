"""All queries by name, and the SQL that must agree with them."""

from __future__ import annotations

import importlib

_CORE = (
    "ledgerlens.plans.transaction_problems",
    "ledgerlens.plans.feature_queries",
    "ledgerlens.plans.graph_queries",
    "ledgerlens.plans.risk_queries",
    "ledgerlens.plans.report_queries",
    "ledgerlens.plans.study_queries",
    "ledgerlens.plans.source_queries",
    "ledgerlens.plans.measure_queries",
    "ledgerlens.plans.replayed",
)


def gather(modules: tuple[str, ...] = _CORE) -> tuple[dict, dict]:
    queries: dict = {}
    oracles: dict = {}
    for name in modules:
        module = importlib.import_module(name)
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
