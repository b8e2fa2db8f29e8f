"""Registered corpus queries: name -> Spark plan, and name -> SQL text where SQL can express the result."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

_MODULES = [
    "quality_lines", "url_filter", "packing", "bpe_count", "minmax_dedup", "mixing", "ball_tree", "suffix_repeats",
    "suffix_tree_lm", "surrogates", "k2_treap",
    "qd_whitening", "collision_links", "pipeline",
]


def _modules():
    return [importlib.import_module(f"reliefgrid.llm.plans.{name}") for name in _MODULES]


def queries() -> dict[str, Plan]:
    return {module.NAME: module.plan for module in _modules()}


def oracles() -> dict[str, str]:
    return {module.NAME: module.SQL for module in _modules() if module.SQL}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
