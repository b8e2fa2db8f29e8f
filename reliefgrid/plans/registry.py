"""Query registry: name -> Spark plan, and name -> SQL text where SQL can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

_PLANS: dict[str, Plan] = {}
_SQL: dict[str, str] = {}
_MODULES = [
    "capacity_plans",
    "rollup_plans",
    "geo_plans",
    "similarity_plans",
    "explain_plans",
    "panel_plans",
    "impact_plans",
    "text_plans",
    "quality_plans",
    "traffic_plans",
    "stream_plans",
    "record_plans",
    "master_plans",
]


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        if name in _PLANS:
            raise ValueError(f"query {name} is registered twice")
        _PLANS[name] = plan
        if sql is not None:
            _SQL[name] = sql
        return plan

    return register


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"reliefgrid.plans.{module}")


def queries() -> dict[str, Plan]:
    _load()
    return dict(_PLANS)


def oracles() -> dict[str, str]:
    _load()
    return dict(_SQL)
