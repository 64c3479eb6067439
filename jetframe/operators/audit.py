"""Data audits: track completeness, label shuffling, mixtures, class mismatch, missingness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jetframe.functions.particles import TRACK_MISSING, TRACK_USABLE
from jetframe.operators.bootstrap import shuffled_labels
from jetframe.operators.metrics import binary_metrics
from jetframe.operators.views import forbidden_fields
from jetframe.rules import union_all


def missing_track_fraction(states: Column) -> Column:
    """Aggregate: charged particles without track details among all charged ones; 0 if none."""
    eligible = F.count_if(states.isin(TRACK_USABLE, TRACK_MISSING))
    return F.when(eligible > 0, F.count_if(states == TRACK_MISSING) / eligible).otherwise(F.lit(0.0))


def mixture(jets: DataFrame, expected: DataFrame, label: str = "target") -> DataFrame:
    """Train background rows per record against expected counts, both sides kept."""
    seen = (
        jets.filter((F.col("split") == "train") & (F.col(label) == 0))
        .groupBy("record_id")
        .agg(F.count(F.lit(1)).alias("observed"))
    )
    return seen.join(expected, "record_id", "full_outer").select(
        "record_id",
        "observed",
        "expected",
        F.col("observed").eqNullSafe(F.col("expected")).alias("passed"),
    )


def data_audit(
    rows: DataFrame,
    jets: DataFrame,
    expected: DataFrame,
    model_fields: Sequence[str],
    missing_max: float,
    auc_max: float,
    seed: int,
    score: str = "jet_pt",
) -> DataFrame:
    """``(check, observed, threshold, passed)``: one row per check, train split only.

    ``rows`` is the long particle form, ``jets`` one row per jet.
    """
    train = jets.filter(F.col("split") == "train")
    none = F.lit(None).cast("double")

    def check(name: str, observed: Column, threshold: Column, passed: Column) -> list[Column]:
        return [
            F.lit(name).alias("check"),
            observed.cast("double").alias("observed"),
            threshold.cast("double").alias("threshold"),
            passed.alias("passed"),
        ]

    tracks = rows.filter(F.col("split") == "train").agg(
        missing_track_fraction(F.col("track_state")).alias("v")
    )
    shuffled = shuffled_labels(
        train.select("jet_id", "target", F.col(score).cast("double").alias("score")), seed
    )
    auc = binary_metrics(shuffled.withColumn("run_id", F.lit("shuffled")), ["run_id"], efficiencies=())
    mixed = mixture(jets, expected).agg(F.count_if(~F.col("passed")).alias("v"))
    seen = train.agg(
        F.min("n_vertices").alias("lo"),
        F.avg("n_vertices").alias("mean"),
        F.max("n_vertices").alias("hi"),
        F.count_if(F.col("target") == 0).alias("n0"),
        F.count_if(F.col("target") == 1).alias("n1"),
    )
    wide = seen.select(
        F.explode(
            F.array(
                *[
                    F.struct(*check(name, F.col(c), none, F.lit(True)))
                    for name, c in (
                        ("n_vertices_min", "lo"),
                        ("n_vertices_mean", "mean"),
                        ("n_vertices_max", "hi"),
                    )
                ],
                F.struct(
                    *check(
                        "class_yield",
                        F.least("n0", "n1"),
                        F.lit(1),
                        (F.col("n0") > 0) & (F.col("n1") > 0),
                    )
                ),
                F.struct(
                    *check(
                        "forbidden_fields",
                        F.lit(len(forbidden_fields(model_fields))),
                        F.lit(0),
                        F.lit(not forbidden_fields(model_fields)),
                    )
                ),
            )
        ).alias("c")
    ).select("c.*")
    v = F.col("v")
    return union_all(
        [
            tracks.select(*check("missing_track", v, F.lit(missing_max), v <= missing_max)),
            auc.select(
                *check("shuffled_label", F.col("roc_auc"), F.lit(auc_max), F.col("roc_auc") <= auc_max)
            ),
            mixed.select(*check("mixture_differences", v, F.lit(0), v == 0)),
            wide,
        ]
    )


def missingness_cube(rows: DataFrame, jets: DataFrame, limit: int) -> DataFrame:
    """Jets, truncation and track states by class, record and split with all subtotals.

    Particle counts are combined to one row per cell before the cube, so the cube expands
    a table of cells and not of particles.
    """
    keys = ["target", "record_id", "split"]
    a = jets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("jets"), F.count_if(F.col("n_before") > limit).alias("truncated")
    )
    b = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("particles"),
        F.count_if(F.col("track_state") == TRACK_MISSING).alias("track_missing"),
    )
    zero = F.lit(0).cast("bigint")
    cells = a.join(b, keys, "left").withColumns(
        {c: F.coalesce(F.col(c), zero) for c in ("particles", "track_missing")}
    )
    return cells.cube(*keys).agg(
        *[F.sum(c).alias(c) for c in ("jets", "truncated", "particles", "track_missing")]
    )
