"""Registered queries of the library's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FAMILIES = ("q_metrics", "q_corpus", "q_bench", "q_scenes", "q_raster", "q_trace", "q_streams")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in FAMILIES:
        out |= import_module(f"sceneweave.plans.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in FAMILIES:
        out |= import_module(f"sceneweave.plans.{name}").SQL
    return out
