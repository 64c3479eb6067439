"""Structural profiles, label tables and small reports over nested rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jetframe.functions import arrays
from jetframe.functions.particles import not_finite
from jetframe.rules import broken_rules


def finite_fraction(df: DataFrame, vector: str, keys: Sequence[str] = ()) -> DataFrame:
    """Share of finite values; NaN where there is no value at all."""
    counted = df.select(
        *keys,
        arrays.finite_count(F.col(vector)).cast("bigint").alias("f"),
        F.size(vector).cast("bigint").alias("n"),
    )
    total = F.sum("n")
    return counted.groupBy(*keys).agg(
        F.when(total > 0, F.sum("f") / total).otherwise(F.lit(float("nan"))).alias("finite_fraction")
    )


def structure_profile(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, nulls, and size range of array columns; one pass."""
    parts = []
    for f in df.schema.fields:
        is_array = isinstance(f.dataType, T.ArrayType)
        size = F.size(f.name) if is_array else F.lit(None).cast("int")
        parts.append(
            F.struct(
                F.lit(f.name).alias("field"),
                F.lit("array" if is_array else f.dataType.simpleString()).alias("kind"),
                F.count(F.lit(1)).alias("n_rows"),
                F.count_if(F.col(f.name).isNull()).alias("nulls"),
                F.min(size).alias("min_size"),
                F.max(size).alias("max_size"),
                (F.count_if(size == 0) if is_array else F.lit(0).cast("bigint")).alias("empty"),
            )
        )
    return df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("e")).select("e.*")


def array_rank(kind: T.DataType) -> int:
    return 1 + array_rank(kind.elementType) if isinstance(kind, T.ArrayType) else 0


def input_contract(df: DataFrame, expected: Mapping[str, int]) -> DataFrame:
    """Expected array rank per column against what the table holds."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    null_int = F.lit(None).cast("int")
    entries = []
    for name, rank in expected.items():
        if name not in kinds:
            entries.append((name, rank, null_int, F.lit(None).cast("bigint"), null_int, null_int, F.lit("missing")))
            continue
        found = array_rank(kinds[name])
        width = F.size(name) if found else null_int
        issue = (
            F.when(F.count(F.lit(1)) == 0, F.lit("empty"))
            .when(F.lit(found != rank), F.lit("rank"))
            .when(F.min(width) != F.max(width), F.lit("ragged"))
            .otherwise(F.lit(""))
        )
        entries.append((name, rank, F.lit(found), F.count(F.lit(1)), F.min(width), F.max(width), issue))
    parts = [
        F.struct(
            F.lit(name).alias("field"),
            F.lit(rank).alias("expected_rank"),
            found.alias("found_rank"),
            count.alias("n_rows"),
            low.alias("min_width"),
            high.alias("max_width"),
            issue.alias("issue"),
        )
        for name, rank, found, count, low, high, issue in entries
    ]
    return df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("e")).select("e.*")


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))


def remap_labels(df: DataFrame, label: str, mapping: Mapping[int, int]) -> DataFrame:
    """Adds ``remapped`` and ``unknown``; the map is a parameter, so it becomes a literal."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    new = F.element_at(F.create_map(*pairs), F.col(label)).cast("bigint")
    return df.withColumn("remapped", new).withColumn("unknown", F.col("remapped").isNull())


def masked_batch_rules(df: DataFrame, key: str, data: str, mask: str) -> DataFrame:
    return broken_rules(
        df,
        F.col(key),
        {
            "BASELINE_SHAPE": F.size(data) != F.size(mask),
            "BASELINE_INPUT": F.exists(data, lambda d: F.exists(d, lambda v: not_finite(v)))
            | F.exists(mask, lambda m: m.isNull()),
            "BASELINE_EMPTY_JET": arrays.mask_count(F.col(mask)) == 0,
        },
    )


def first_rows(df: DataFrame, key: str, data: str, n: int, mask_feature: int) -> DataFrame:
    """Report on the first ``n`` rows by key: a top-n, each task keeps ``n`` rows at most."""
    flat = F.flatten(data)
    by_feature = arrays.mask_from_feature(F.col(data), mask_feature)
    nonzero = arrays.infer_mask(F.col(data))
    return (
        df.orderBy(key)
        .limit(n)
        .select(
            key,
            F.size(data).alias("children"),
            (arrays.finite_count(flat) / F.size(flat)).alias("finite_fraction"),
            arrays.mask_count(by_feature).alias("real"),
            arrays.mask_disagreements(nonzero, by_feature).alias("disagree"),
        )
    )
