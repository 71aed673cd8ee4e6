"""All queries of the engine's own operators, by name, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_city, q_estate, q_field, q_filter, q_models, q_network, q_series, q_shapes, q_sites, q_space, q_structure, q_table, q_text

MODULES = (q_space, q_table, q_models, q_text, q_structure, q_city, q_sites, q_series, q_estate, q_field, q_filter, q_network, q_shapes)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for m in MODULES for name, (fn, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql is not None}
