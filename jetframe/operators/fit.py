"""Statistics fitted on training rows only, and what is derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jetframe.operators.ordered import range_bounds, running_sums
from jetframe.schema import CONTINUOUS_FIELDS


def fit_scaling(rows: DataFrame, fields: Sequence[str] = CONTINUOUS_FIELDS) -> DataFrame:
    """``(field, location, scale, n)``: mean and population deviation over train particles.

    ``rows`` is the long form.  Every particle has one vote.  All fields are aggregated in one pass with map-side
    partial sums; only the single result row is turned into one row per field.
    """
    one = rows.filter(F.col("split") == "train").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.col(f).cast("double")).alias(f"loc_{f}") for f in fields],
        *[F.stddev_pop(F.col(f).cast("double")).alias(f"dev_{f}") for f in fields],
    )
    entry = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(f).alias("field"),
                    F.col(f"loc_{f}").alias("location"),
                    F.when(F.col(f"dev_{f}") == 0.0, F.lit(1.0))
                    .otherwise(F.col(f"dev_{f}"))
                    .alias("scale"),
                )
                for f in fields
            ]
        )
    ).alias("e")
    return one.select(entry, "n").select("e.field", "e.location", "e.scale", "n")


def lazy_scaling(
    rows: DataFrame, fields: Sequence[str] = CONTINUOUS_FIELDS
) -> dict[str, tuple[Column, Column]]:
    """The fitted state as columns of one scalar subquery: it is computed when the view is."""
    state = fit_scaling(rows, fields).agg(
        F.map_from_entries(
            F.collect_list(F.struct("field", F.struct("location", "scale").alias("state")))
        )
    ).scalar()
    return {f: (state[f]["location"], state[f]["scale"]) for f in fields}


def load_scaling(
    state: DataFrame, fields: Sequence[str] = CONTINUOUS_FIELDS
) -> dict[str, tuple[float, float]]:
    """A stored state as numbers: one row for each of ``fields`` and no other."""
    rows = state.collect()
    found = {row["field"]: (row["location"], row["scale"]) for row in rows}
    if len(rows) != len(found) or set(found) != set(fields):
        raise ValueError("the state must hold each field once and no other")
    if rows[0]["n"] == 0:
        raise ValueError("no training particles to fit on")
    if any(scale is None or scale <= 0 for _, scale in found.values()):
        raise ValueError("scales must be positive")
    return found


def standardized_difference(df: DataFrame, value: str, label: str) -> DataFrame:
    """|mean1 - mean0| over the pooled sample deviation."""
    y, v = F.col(label), F.col(value).cast("double")
    stats = df.agg(
        *[F.avg(F.when(y == c, v)).alias(f"m{c}") for c in (0, 1)],
        *[F.var_samp(F.when(y == c, v)).alias(f"v{c}") for c in (0, 1)],
    )
    return stats.select(
        F.lit(value).alias("field"),
        (F.abs(F.col("m1") - F.col("m0")) / F.sqrt((F.col("v0") + F.col("v1")) / 2.0)).alias("smd"),
    )


def ks_distance(
    df: DataFrame, value: str, label: str, bounds: Column | Sequence[float] | None = None
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance between the classes."""
    source = df.select(F.col(value).cast("double").alias("v"), F.col(label).alias("y"))
    if bounds is None:
        bounds = range_bounds(source, "v")
    groups = source.groupBy("v").agg(
        F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")
    )
    run = running_sums(groups, [], "v", ["n0", "n1"], bounds)
    f0 = (F.col("n0_before") + F.col("n0")) / F.col("n0_total")
    f1 = (F.col("n1_before") + F.col("n1")) / F.col("n1_total")
    return run.agg(F.max(F.abs(f1 - f0)).alias("ks")).select(F.lit(value).alias("field"), "ks")


def cell_of(value: Column, edges: Sequence[float]) -> Column:
    """Index of the half-open cell of fixed edges; values beyond the ends use the end cells."""
    cell = F.lit(0)
    for i, edge in enumerate(edges[1:-1], start=1):
        cell = F.when(value >= edge, F.lit(i)).otherwise(cell)
    return cell


def class_weights(
    df: DataFrame,
    axes: dict[str, Sequence[float]],
    label: str = "target",
    split: str = "split",
) -> DataFrame:
    """Background weights that give background the train signal shape over fixed cells.

    ``(cells..., weight)`` has at most the product of the axis sizes as rows, fitted on
    the train split only.  Cells without train background get no weight row.
    """
    y = F.col(label)
    cells = [cell_of(F.col(a), e).alias(f"{a}_cell") for a, e in axes.items()]
    names = [f"{a}_cell" for a in axes]
    train = df.filter(F.col(split) == "train").select(*cells, y.alias("y"))
    counts = train.groupBy(*names).agg(
        F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")
    )
    whole = counts.agg(F.struct(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))).scalar()
    t0, t1 = whole["t0"], whole["t1"]
    return counts.filter("n0 > 0").select(
        *names, ((F.col("n1") / t1) / (F.col("n0") / t0)).alias("weight")
    )


def apply_weights(
    df: DataFrame, weights: DataFrame, axes: dict[str, Sequence[float]], label: str = "target"
) -> DataFrame:
    """Frozen train weights joined to every split; signal rows keep weight one.

    The weight is an audit column (``audit_weight``), never a model input.
    """
    names = [f"{a}_cell" for a in axes]
    # One row per cell at most: the planner broadcasts it by its size, and AQE splits a shuffle.
    placed = df.withColumns({f"{a}_cell": cell_of(F.col(a), e) for a, e in axes.items()})
    return placed.join(weights, names, "left").withColumn(
        "audit_weight",
        F.when(F.col(label) == 1, F.lit(1.0)).otherwise(F.coalesce(F.col("weight"), F.lit(0.0))),
    ).drop("weight")
