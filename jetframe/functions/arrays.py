"""Row-shaped work on nested feature arrays: gather, masks, counts, pooling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from jetframe.functions.particles import not_finite


def resolve_features(
    config: str, ladder: Mapping[str, Sequence[str]], groups: Mapping[str, Sequence[str]]
) -> list[str]:
    """Ordered feature names of one configuration; unknown, empty or repeated names fail."""
    if config not in ladder:
        raise ValueError(f"unknown feature configuration: {config}")
    empty = [group for group in ladder[config] if not groups.get(group)]
    if empty:
        raise ValueError(f"column groups without columns: {empty}")
    names = [name for group in ladder[config] for name in groups[group]]
    if len(set(names)) < len(names):
        raise ValueError(f"repeated feature names: {names}")
    return names


def feature_positions(
    names: Sequence[str], positions: Mapping[str, int], width: int | None = None
) -> list[int]:
    absent = [name for name in names if name not in positions]
    if absent:
        raise ValueError(f"no position known for: {absent}")
    found = [positions[name] for name in names]
    if len(set(found)) < len(found):
        raise ValueError(f"repeated positions: {found}")
    if width is not None and any(p < 0 or p >= width for p in found):
        raise ValueError(f"positions outside [0, {width}): {found}")
    return found


def gather(data: Column, positions: Sequence[int]) -> Column:
    """Pick feature positions out of every child vector."""
    return F.transform(data, lambda row: F.array(*[row[p] for p in positions]))


def infer_mask(data: Column, eps: float = 0.0) -> Column:
    """Child is real when any finite feature exceeds ``eps`` in size."""
    return F.transform(
        data, lambda row: F.exists(row, lambda v: ~not_finite(v) & (F.abs(v) > F.lit(eps)))
    )


def mask_from_feature(data: Column, position: int) -> Column:
    """Child is real when its mask feature is not zero; a missing or non-finite one is an error."""
    if position < 0:
        raise ValueError("the mask feature needs a position of zero or more")

    def real(row: Column) -> Column:
        value = F.get(row, F.lit(position))
        bad = value.isNull() | not_finite(value)
        fail = F.raise_error(F.lit(f"mask feature {position} is missing or not finite")).cast("boolean")
        return F.when(bad, fail).otherwise(value != 0)

    return F.transform(data, real)


def mask_count(mask: Column) -> Column:
    return F.size(F.filter(mask, lambda x: x))


def mask_disagreements(left: Column, right: Column) -> Column:
    return F.size(F.filter(F.zip_with(left, right, lambda a, b: a != b), lambda x: x))


def finite_count(vector: Column) -> Column:
    return F.size(F.filter(vector, lambda v: ~not_finite(v)))


def masked_sum(data: Column, mask: Column, width: int) -> Column:
    """Sum of the real child vectors; what stands in masked slots has no effect."""
    zero = F.array_repeat(F.lit(0.0).cast("double"), width)
    real = F.filter(
        F.zip_with(data, mask, lambda d, m: F.when(m, d)), lambda d: d.isNotNull()
    )
    return F.aggregate(
        real,
        zero,
        lambda acc, d: F.zip_with(acc, d, lambda a, b: a + b.cast("double")),
    )


def masked_mean(data: Column, mask: Column, width: int) -> Column:
    """Mean over real children with a denominator of at least one."""
    count = F.greatest(mask_count(mask), F.lit(1)).cast("double")
    return F.transform(masked_sum(data, mask, width), lambda s: s / count)
