"""Running sums over an ordered value column, for any number of rows per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 64


def range_bounds(df: DataFrame, value: str, bins: int = BINS) -> Column:
    """Quantiles that cut ``df`` into ``bins`` ranges, as a scalar subquery: one sketch pass, no job."""
    cuts = [i / bins for i in range(1, bins)]
    return df.agg(F.percentile_approx(value, cuts, 20 * bins)).scalar()


def with_bin(df: DataFrame, value: str, bounds: Column | Sequence[float]) -> DataFrame:
    """``_bin``: how many bounds a value reaches.  Null values fall into range 0, NaN into the last."""
    if not isinstance(bounds, Column):
        bounds = F.array(*[F.lit(float(b)) for b in bounds]).cast("array<double>")
    reached = F.size(F.filter("_bounds", lambda b: b <= F.col(value)))
    held = df.withColumn("_bounds", F.coalesce(bounds, F.array().cast("array<double>")))
    return held.withColumn("_bin", F.greatest(reached, F.lit(0))).drop("_bounds")


def running_sums(
    groups: DataFrame,
    keys: Sequence[str],
    value: str,
    sums: Sequence[str],
    bounds: Column | Sequence[float] = (),
) -> DataFrame:
    """Add ``<s>_before`` (sum over smaller values) and ``<s>_total`` for every ``s``.

    ``groups`` has one row per ``(keys, value)``.  Each bin is summed on its own, the bin
    sums are accumulated per key, and only rows of one bin meet in one window.
    """
    partition = list(keys) or [F.lit(0)]
    binned = with_bin(groups, value, bounds)
    upto = Window.partitionBy(*partition).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*partition)
    inside = (
        Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = (
        binned.groupBy(*keys, "_bin")
        .agg(*[F.sum(s).alias(f"_{s}") for s in sums])
        .select(
            *keys,
            "_bin",
            *[F.coalesce(F.sum(f"_{s}").over(upto), F.lit(0)).alias(f"_{s}_offset") for s in sums],
            *[F.sum(f"_{s}").over(whole).alias(f"{s}_total") for s in sums],
        )
    )
    return (
        binned.join(totals, [*keys, "_bin"])
        .select(
            *[c for c in groups.columns],
            *[
                (F.coalesce(F.sum(s).over(inside), F.lit(0)) + F.col(f"_{s}_offset")).alias(
                    f"{s}_before"
                )
                for s in sums
            ],
            *[f"{s}_total" for s in sums],
        )
    )
