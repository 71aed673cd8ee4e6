"""Data quality: rules as data, violations as rows, uniqueness with the first occurrence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    column: str
    name: str
    fails: Column


def required(column: str) -> Rule:
    return Rule(column, "required", F.col(column).isNull())


def one_of(column: str, values: list) -> Rule:
    """Nulls are the business of ``required``."""
    return Rule(column, "one_of", ~F.col(column).isin(values))


def in_range(column: str, low: float, high: float) -> Rule:
    return Rule(column, "in_range", (F.col(column) < low) | (F.col(column) > high))


def matches(column: str, pattern: str) -> Rule:
    return Rule(column, "matches", ~F.col(column).rlike(pattern))


def violations(df: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """``id, column, rule``: one row per rule that a row breaks, in one pass over the table."""
    hits = F.array_compact(F.array(*[F.when(r.fails, F.struct(F.lit(r.column).alias("column"), F.lit(r.name).alias("rule"))) for r in rules]))
    return df.select(F.col(key).alias("id"), F.explode(hits).alias("v")).select("id", "v.column", "v.rule")


def repeats(df: DataFrame, key: str, order: str) -> DataFrame:
    """``id, key, first_id``: rows whose key was seen before, with the first row's id; null keys are skipped."""
    w = Window.partitionBy(key).orderBy(order)
    seen = df.filter(F.col(key).isNotNull()).select(F.col(order).alias("id"), F.col(key).alias("key"), F.first(order).over(w).alias("first_id"), F.row_number().over(w).alias("n"))
    return seen.filter("n > 1").drop("n")


def timeliness(df: DataFrame, column: str, now: Column, max_age_s: int) -> DataFrame:
    """Rows older than ``max_age_s`` or in the future, with a reason."""
    age = F.unix_seconds(now) - F.unix_seconds(F.col(column).cast("timestamp"))
    return df.withColumn("reason", F.when(age > max_age_s, "stale").when(age < 0, "future")).filter("reason is not null")


def tile_report(tile: DataFrame, fields: list[str], expected: int) -> DataFrame:
    """One row: count as expected, all values 0..100, at least two different vectors."""
    ok = F.forall(F.array(*[F.col(f).cast("double") for f in fields]), lambda v: v.isNotNull() & (v >= 0) & (v <= 100))
    return tile.agg(
        (F.count("*") == expected).alias("count_ok"), F.bool_and(ok).alias("range_ok"), (F.approx_count_distinct(F.xxhash64(*fields)) >= 2).alias("varied"),
    )
