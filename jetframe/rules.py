"""Fail-closed checks: every audit returns ``violations(rule, key, detail)``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class RuleViolation(ValueError):
    """Raised by :func:`enforce`; carries the first violations found."""

    def __init__(self, rows: Sequence[tuple[str, str, str]]):
        self.rows = list(rows)
        super().__init__("; ".join(f"{rule}[{key}] {detail}" for rule, key, detail in self.rows))


def as_text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("null"))


def broken_rules(df: DataFrame, key: Column, rules: Mapping[str, Column]) -> DataFrame:
    """One row per failed rule of one pass over ``df``.

    ``rules`` maps a rule name to the predicate that is true for a *bad* row.  All
    predicates are evaluated in the same projection, so a hundred rules cost one scan.
    The outer explode keeps that projection from being repeated in a filter below it.
    """
    failed = F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()])
    )
    return (
        df.select(as_text(key).alias("key"), failed.alias("failed"))
        .select(F.explode_outer("failed").alias("rule"), "key")
        .filter("rule IS NOT NULL")
        .select("rule", "key", F.lit("").alias("detail"))
    )


def repeated_keys(df: DataFrame, columns: Sequence[str], rule: str) -> DataFrame:
    """Keys that occur more than once; counts are combined before the shuffle."""
    return (
        df.groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(
            F.lit(rule).alias("rule"),
            F.concat_ws(":", *[as_text(F.col(c)) for c in columns]).alias("key"),
            F.concat(F.lit("count="), F.col("n").cast("string")).alias("detail"),
        )
    )


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def enforce(violations: DataFrame, show: int = 20) -> None:
    """Raise if there is any violation; only the first ``show`` rows reach the driver."""
    rows = violations.select("rule", "key", "detail").limit(show).collect()
    if rows:
        raise RuleViolation([tuple(row) for row in rows])
