"""All queries of the analytics operators and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ["queries_metrics", "queries_columns", "queries_models", "queries_exact", "queries_sparse"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in MODULES:
        out |= importlib.import_module(f"quarry.plans.{m}").Q
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= importlib.import_module(f"quarry.plans.{m}").SQL
    return out
