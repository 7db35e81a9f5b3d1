"""All queries by name. The llm subpackage takes part only where it can be imported."""

from __future__ import annotations

import importlib
import importlib.util

MODULES = ("tempolex.plans.problems", "tempolex.plans.temporal_queries", "tempolex.plans.ranking_queries", "tempolex.plans.audit_queries", "tempolex.plans.source_queries")
OPTIONAL = ("tempolex.llm.queries",)


def _modules() -> list:
    found = [importlib.import_module(m) for m in MODULES]
    for m in OPTIONAL:
        package = m.rpartition(".")[0]
        try:
            present = importlib.util.find_spec(package) is not None
        except ModuleNotFoundError:
            present = False
        if present:  # what fails inside it is an error
            found.append(importlib.import_module(m))
    return found


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in _modules() for k, q in m.SQL.items()}
