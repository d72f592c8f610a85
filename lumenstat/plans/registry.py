"""Collects the query catalogue: each module of MODULES offers QUERIES and ORACLES."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ("linear", "assess", "learn", "classify", "shape", "flow", "choose", "infer", "points", "forms", "deep")


def _modules():
    return [importlib.import_module(f"lumenstat.plans.{name}") for name in MODULES]


def queries() -> dict[str, Query]:
    return {key: fn for module in _modules() for key, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {key: sql for module in _modules() for key, sql in module.ORACLES.items()}
