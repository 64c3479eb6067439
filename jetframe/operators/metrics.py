"""Ranking metrics for any number of scored runs in one pass.

Rows are first combined into one row per distinct score (map-side), then a running sum
over the ordered scores gives every point of the ROC curve.  AUC is an aggregate over
the points; the point where signal efficiency first reaches a target is a filter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jetframe.functions.particles import not_finite
from jetframe.operators.ordered import range_bounds, running_sums
from jetframe.rules import as_text, broken_rules, repeated_keys, union_all
from jetframe.schema import REQUIRED_CONTRASTS

EFFICIENCIES = (0.30, 0.50)


def label_of(efficiency: float) -> str:
    return f"{round(efficiency * 100):02d}"


def score_points(
    scored: DataFrame,
    keys: Sequence[str],
    score: str = "score",
    target: str = "target",
    weight: Column | None = None,
    bounds: Sequence[float] = (),
) -> DataFrame:
    """One row per ``(keys, score)`` with its counts, the counts below it, and the totals."""
    w = F.lit(1) if weight is None else weight
    groups = scored.groupBy(*keys, score).agg(
        F.sum(w).alias("n"), F.sum(F.when(F.col(target) == 1, w).otherwise(0)).alias("p")
    )
    return running_sums(groups, keys, score, ["n", "p"], bounds)


def _background_efficiency(efficiency: float) -> Column:
    """Interpolated at the first point, from high scores down, that reaches the target."""
    n, p = F.col("n"), F.col("p")
    signal, background = F.col("p_total"), F.col("n_total") - F.col("p_total")
    passed = signal - F.col("p_before")
    tpr, tpr_above = passed / signal, (passed - p) / signal
    false = background - (F.col("n_before") - F.col("p_before"))
    fpr, fpr_above = false / background, (false - (n - p)) / background
    goal = F.lit(efficiency)
    here = (signal > 0) & (background > 0) & (tpr >= goal) & (tpr_above < goal)
    between = fpr_above + (goal - tpr_above) / (tpr - tpr_above) * (fpr - fpr_above)
    return F.max(F.when(here, F.when(tpr == goal, fpr).otherwise(between)))


def metrics_of_points(
    points: DataFrame,
    keys: Sequence[str],
    score: str = "score",
    efficiencies: Sequence[float] = EFFICIENCIES,
    threshold: Column | None = None,
) -> DataFrame:
    """AUC, background efficiency and rejection, optionally accuracy, per key.

    AUC is null unless both classes are present; rejection is null where no background
    passes.
    """
    n, p = F.col("n"), F.col("p")
    rank = F.col("n_before") + (n + F.lit(1)) / F.lit(2.0)
    signal = F.max("p_total").cast("double")
    background = F.max(F.col("n_total") - F.col("p_total")).cast("double")
    both = (signal > 0) & (background > 0)
    auc = (F.sum(p * rank) - signal * (signal + 1.0) / 2.0) / (signal * background)
    correct = F.sum(F.when(F.col(score) >= threshold, p).otherwise(n - p)) if threshold is not None else None
    made = points.groupBy(*keys).agg(
        background.cast("bigint").alias("background_count"),
        signal.cast("bigint").alias("signal_count"),
        F.when(both, auc).alias("roc_auc"),
        *([(correct / F.max("n_total")).alias("accuracy")] if correct is not None else []),
        *[_background_efficiency(e).alias(f"background_efficiency_{label_of(e)}") for e in efficiencies],
    )
    return made.select(
        "*",
        *[
            F.when(
                F.col(f"background_efficiency_{label_of(e)}") > 0,
                F.lit(1.0) / F.col(f"background_efficiency_{label_of(e)}"),
            ).alias(f"background_rejection_{label_of(e)}")
            for e in efficiencies
        ],
    )


def binary_metrics(
    scored: DataFrame,
    keys: Sequence[str],
    score: str = "score",
    target: str = "target",
    efficiencies: Sequence[float] = EFFICIENCIES,
    threshold: float | None = None,
    bounds: Column | Sequence[float] | None = None,
) -> DataFrame:
    """Metric bundle per key.  Large inputs are cut into score ranges (see ``ordered``)."""
    if any(not 0.0 < e < 1.0 for e in efficiencies):
        raise ValueError("METRIC_TARGET_EFFICIENCY")
    cuts = range_bounds(scored, score) if bounds is None else bounds
    points = score_points(scored, keys, score, target, bounds=cuts)
    limit = None if threshold is None else F.lit(float(threshold))
    return metrics_of_points(points, keys, score, efficiencies, limit)


def prediction_rules(predictions: DataFrame) -> DataFrame:
    """Contract of scored rows: ids present and unique per run, binary targets, finite scores."""
    key = F.concat_ws(":", as_text(F.col("run_id")), as_text(F.col("jet_id")))
    return union_all(
        [
            broken_rules(
                predictions,
                key,
                {
                    "PREDICTION_IDENTITY": F.coalesce(F.col("jet_id"), F.lit("")) == "",
                    "PREDICTION_TARGET": ~F.coalesce(F.col("target").isin(0, 1), F.lit(False)),
                    "PREDICTION_SCORE": not_finite(F.col("score")),
                },
            ),
            repeated_keys(predictions, ["run_id", "jet_id"], "PREDICTION_IDENTITY_REPEATED"),
        ]
    )


def alignment_rules(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two runs must hold the same ids at the same positions with the same targets."""
    a = left.select("jet_id", F.col("pos").alias("l_pos"), F.col("target").alias("l_target"))
    b = right.select("jet_id", F.col("pos").alias("r_pos"), F.col("target").alias("r_target"))
    return broken_rules(
        a.join(b, "jet_id", "full_outer"),
        F.col("jet_id"),
        {
            "PREDICTION_IDENTITY_MISMATCH": ~F.col("l_pos").eqNullSafe(F.col("r_pos")),
            "PREDICTION_TARGET_MISMATCH": F.col("l_target") != F.col("r_target"),
        },
    )


def seed_summary(values: DataFrame, keys: Sequence[str], seed: str, value: str) -> DataFrame:
    """Mean and sample deviation over model seeds, with the values in seed order.

    A group holds one value per model seed of one condition.
    """
    return (
        values.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("seeds"),
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("sample_standard_deviation"),
            F.array_sort(F.collect_list(F.struct(F.col(seed), F.col(value)))).alias("per_seed"),
        )
        .withColumn("valid", F.col("seeds") >= 2)
    )


def gap_ratio(small: Column, large: Column, minimum: float) -> tuple[Column, Column]:
    """``(fraction, reason)``; the fraction is null where the denominator is too small."""
    if not minimum > 0:
        raise ValueError("METRIC_DATA_EFFICIENCY")
    unstable = F.abs(large) < F.lit(minimum)
    return (
        F.when(~unstable, small / large),
        F.when(unstable, F.lit("unstable_large_scale_denominator")),
    )


def contrasts(
    values: DataFrame,
    keys: Sequence[str],
    config: str,
    value: str,
    required: Sequence[str] = REQUIRED_CONTRASTS,
) -> DataFrame:
    """``left - right`` of every required pair, from one pivot instead of self joins."""
    names = sorted({c for pair in required for c in pair.split("-")})
    wide = values.groupBy(*keys).pivot(config, names).agg(F.first(value))
    pairs = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(pair).alias("contrast"),
                    (F.col(pair.split("-")[0]) - F.col(pair.split("-")[1])).alias("delta"),
                )
                for pair in required
            ]
        )
    )
    return wide.select(*keys, pairs.alias("c")).select(*keys, "c.contrast", "c.delta")


def contrast_set_gaps(
    found: DataFrame, keys: Sequence[str], required: Sequence[str] = REQUIRED_CONTRASTS
) -> DataFrame:
    """Missing and extra contrasts of every group; the set must be exactly ``required``."""
    want = F.array(*[F.lit(c) for c in required])
    have = found.groupBy(*keys).agg(F.collect_set("contrast").alias("have"))
    return (
        have.select(
            *keys,
            F.array_sort(F.array_except(want, F.col("have"))).alias("missing"),
            F.array_sort(F.array_except(F.col("have"), want)).alias("extra"),
        )
        .filter((F.size("missing") > 0) | (F.size("extra") > 0))
        .select(
            *keys,
            F.array_join("missing", ",").alias("missing"),
            F.array_join("extra", ",").alias("extra"),
        )
    )


def efficiency_by_size(
    values: DataFrame, keys: Sequence[str], size: str, auc: str, minimum: float = 0.01
) -> DataFrame:
    """``(AUC_n - 0.5) / (AUC_max - 0.5)`` for every size, guarded against a flat denominator."""
    top = values.groupBy(*keys).agg(F.max_by(auc, size).alias("auc_max"))
    joined = values.join(top, list(keys))
    fraction, reason = gap_ratio(
        F.col(auc) - F.lit(0.5), F.col("auc_max") - F.lit(0.5), minimum
    )
    return joined.select(*keys, size, auc, fraction.alias("auc_gap_fraction"), reason.alias("reason"))
