"""Nested feature views A, B, C, D over canonical rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jetframe.rules import repeated_keys, union_all
from jetframe.schema import FEATURE_VIEWS, FORBIDDEN_MODEL_FIELDS, MAX_PARTICLES

UNSCALED = ("pid_type",)
Scaling = Mapping[str, tuple[float | Column, float | Column]]


def forbidden_fields(names: Sequence[str]) -> list[str]:
    return sorted(set(names) & set(FORBIDDEN_MODEL_FIELDS))


def view_fields(config: str) -> tuple[str, ...]:
    fields = FEATURE_VIEWS[config]
    banned = forbidden_fields(fields)
    if banned:
        raise ValueError(f"DATA_FORBIDDEN_INPUT: {banned}")
    return fields


def scaled(
    value: Callable[[str], Column], field: str, scaling: Scaling
) -> Column:
    """``(x - location) / scale`` rounded to float after every step."""
    if field in UNSCALED:
        return value(field).cast("float")
    location, scale = scaling[field]
    shifted = (value(field) - F.lit(location).cast("float")).cast("float")
    return (shifted / F.lit(scale).cast("float")).cast("float")


def view_rows(
    rows: DataFrame,
    scaling: Scaling,
    config: str,
    keep: Sequence[str] = ("jet_id", "label", "idx"),
) -> DataFrame:
    """Long form of a view: one row per real slot, one float column per feature."""
    return rows.select(
        *keep, *[scaled(F.col, f, scaling).alias(f) for f in view_fields(config)]
    )


def feature_view(
    canonical: DataFrame,
    scaling: Scaling,
    config: str,
    width: int = MAX_PARTICLES,
    keep: Sequence[str] = ("jet_id", "label"),
) -> DataFrame:
    """``keep`` columns, ``mask`` and ``data[width][features]``, zero where masked."""
    fields = view_fields(config)
    # A lazily fitted state is a subquery, which may not stand inside a lambda.
    held = {
        f"_{part}_{f}": F.lit(scaling[f][at])
        for f in fields
        if f not in UNSCALED
        for at, part in enumerate(("location", "scale"))
    }
    canonical = canonical.withColumns(held)
    scaling = {
        f: (F.col(f"_location_{f}"), F.col(f"_scale_{f}")) for f in fields if f not in UNSCALED
    }
    real = F.transform(
        "particles", lambda p: F.array(*[scaled(lambda n: p[n], f, scaling) for f in fields])
    )
    empty = F.array_repeat(F.lit(0.0).cast("float"), len(fields))
    missing = F.lit(width) - F.size("particles")
    return canonical.select(
        *keep,
        F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: i < F.size("particles")).alias(
            "mask"
        ),
        F.concat(real, F.array_repeat(empty, missing)).alias("data"),
    )


def subset_rows(
    members: DataFrame, canonical: DataFrame, size: int, label: str = "label"
) -> DataFrame:
    """Canonical rows of the subset of ``size`` with ``row`` in subset order: class 0, then class 1.

    ``members`` may hold any number of sizes.  The size is also the number of rows of class 0.
    """
    row = F.when(F.col(label) == 0, F.col("pos")).otherwise(F.col("pos") + size) - 1
    held = members.filter(F.col("size") == size)
    return canonical.join(
        held.select(row.alias("row"), "jet_id", F.col(label).alias("subset_label")), "jet_id"
    )


def subset_violations(members: DataFrame, canonical: DataFrame) -> DataFrame:
    """Subset ids without a canonical row, and canonical ids that repeat."""
    absent = members.select("jet_id").distinct().join(
        canonical.select("jet_id"), "jet_id", "left_anti"
    )
    return union_all(
        [
            absent.select(
                F.lit("VIEW_IDENTITY_MISSING").alias("rule"),
                F.col("jet_id").alias("key"),
                F.lit("").alias("detail"),
            ),
            repeated_keys(canonical, ["jet_id"], "VIEW_IDENTITY_DUPLICATE"),
        ]
    )


def view_differences(views: Mapping[str, DataFrame]) -> DataFrame:
    """Rows at which the views disagree on id, mask or label.

    Each view brings its ``row`` position; the views are stacked and grouped by it, so
    any number of views costs one shuffle.
    """
    stacked = union_all(
        [
            v.select(
                "row",
                F.lit(name).alias("config"),
                F.concat_ws(
                    "|", "jet_id", F.col("label").cast("string"), F.col("mask").cast("string")
                ).alias("face"),
            )
            for name, v in views.items()
        ]
    )
    return (
        stacked.groupBy("row")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("face").alias("lo"),
            F.max("face").alias("hi"),
        )
        .filter((F.col("n") != len(views)) | (F.col("lo") != F.col("hi")))
        .select(
            F.lit("VIEW_EQUIVALENCE").alias("rule"),
            F.col("row").cast("string").alias("key"),
            F.concat(F.lit("views="), F.col("n").cast("string")).alias("detail"),
        )
    )
