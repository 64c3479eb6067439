"""Paired, class-stratified bootstrap by hashed draws in rank space; label shuffling.

Replicate ``r`` draws, for every position ``k`` of class ``c``, the row at position
``hex12(md5("seed|r|c|k")) % n_c``.  The draw depends on nothing else, so any task can
make it, a lost task repeats it, and both runs of a pair see the same rows.

Scores are looked at once: the index of rows has, for every side, the dense rank of a row's score.  All
ranks of a replicate fall into blocks, and a block is summed up by (N, P, U): backgrounds, signals, and
pairs in which the signal ranks higher (ties half, so U is kept doubled).  Two neighbouring blocks are one with
``U = U1 + U2 + P2 * N1``, so blocks are made anywhere and merged in rank order.  The place where signal
efficiency reaches a target lies in one block, which the blocks' sums tell; only there are ranks read
once more.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jetframe.operators import resample
from jetframe.operators.metrics import EFFICIENCIES, label_of
from jetframe.operators.ordered import range_bounds, running_sums
from jetframe.operators.ranking import hash_ordinal
from jetframe.operators.resample import OBSERVED
from jetframe.session import small_batches, stored

DRAW_RULE = "md5-hex12-v1"
# Rows of counts that go to a Python worker at a time, each of up to 100 KB or a range of the index.
BATCH_ROWS = 128
MIN_REPLICATES = 1000
RANGES = 16
# Ranks in a block.
RANK_BLOCK = 4096


def check_policy(replicates: int, seed: int) -> None:
    """A 2.5 % point of fewer replicates says nothing."""
    if replicates < MIN_REPLICATES or seed < 0:
        raise ValueError("METRIC_BOOTSTRAP_POLICY: at least 1000 replicates, seed >= 0")


@dataclass(frozen=True)
class RankIndex:
    """``table(target, k, <side>_rank, <side>_ok)`` and the state of the test set."""

    table: DataFrame
    sides: tuple[str, ...]
    unpaired: int
    classes: int


def rank_index(
    rows: DataFrame,
    seed: int,
    sides: dict[str, str],
    thresholds: dict[str, float] | None = None,
    id_col: str = "jet_id",
) -> RankIndex:
    """The test set of a comparison, one row per id, in seeded order inside each class.

    ``k`` is the 0-based place, ``<side>_rank`` the dense rank of the side's score among all of its
    scores (null scores come first), ``<side>_ok`` whether the threshold classifies the row
    rightly.  The index is stored, so the input is ordered and scores are ranked once.
    """
    seen = Observation()
    placed = hash_ordinal(rows, id_col, seed, ["target"], "_k1").select(
        "target", (F.col("_k1") - 1).alias("k"), *[F.col(c).alias(s) for s, c in sides.items()]
    )
    null = F.lit(False)
    for side in sides:
        null = null | F.col(side).isNull()
    base = stored(
        placed.observe(
            seen,
            F.count_if(null).alias("unpaired"),
            F.max(F.when(F.col("target") == 0, 1).otherwise(0)).alias("background"),
            F.max(F.when(F.col("target") == 1, 1).otherwise(0)).alias("signal"),
        )
    )
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("score")) for s in sides]))
    values = base.select(each.alias("s")).select("s.side", "s.score")
    groups = values.groupBy("side", "score").agg(F.lit(1).cast("bigint").alias("one"))
    ranks = running_sums(
        groups, ["side"], "score", ["one"], range_bounds(values, "score", RANGES)
    )
    table = base
    for side in sides:
        own = ranks.filter(F.col("side") == side).select(
            F.col("score").alias(side), F.col("one_before").alias(f"{side}_rank")
        )
        table = table.join(own, side, "left")
    kept = [F.coalesce(f"{s}_rank", F.lit(-1)).cast("int").alias(f"{s}_rank") for s in sides]
    for side in sides:
        limit = F.lit((thresholds or {}).get(side)).cast("double")
        right = (F.col(side) >= limit) == (F.col("target") == 1)
        kept.append(F.coalesce(right, F.lit(False)).cast("int").alias(f"{side}_ok"))
    found = seen.get
    return RankIndex(
        stored(table.select("target", "k", *kept)),
        tuple(sides),
        found["unpaired"],
        (found["background"] or 0) + (found["signal"] or 0),
    )


def width(spark: SparkSession) -> int:
    """Tasks for work that is large while its rows are few: a stated number, which AQE does not coalesce."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def draws(index: DataFrame, replicates: int, seed: int) -> DataFrame:
    """``resample.COUNTED``: every class is resampled to its own size, and how often each position is drawn.

    A draw needs its replicate, class, position and the class size, and no row of the index:
    tasks get (replicate, class, window of positions) and make and count the draws on their own, so
    only counts are shuffled, on clusters of any size.  Replicate -1 has every row once.
    """
    sizes = index.groupBy(F.col("target").cast("int").alias("target")).agg(
        (F.max("k") + 1).cast("bigint").alias("n_c")
    )
    each = F.explode(F.sequence(F.lit(OBSERVED), F.lit(replicates - 1))).alias("rep")
    windows = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_c") - 1) / resample.WINDOW))
    slots = (
        sizes.select("*", each)
        .select("rep", "target", F.explode(windows).alias("window"), "n_c")
        .repartition(4 * width(index.sparkSession), "rep", "target", "window")
    )
    return slots.mapInArrow(resample.count_draws(seed), resample.COUNTED)


def rank_blocks(index: RankIndex, replicates: int, seed: int) -> DataFrame:
    """``(rep, side, block, groups)``, side by number: tie groups ``(rank, n, p, ok)`` of every block, in rank order.

    The index is cut into ranges of positions. The counts of a range come to it from all replicates, at two bits
    a position; ranges are gone through one after the other, a replicate at a time, and give counts per rank. One
    shuffle then brings blocks together, each of at most ``RANK_BLOCK`` tie groups.
    """
    numbered = [
        F.col(f"{name}_{kind}").cast("int").alias(f"{kind}_{number}")
        for number, name in enumerate(index.sides)
        for kind in ("rank", "ok")
    ]
    at = F.floor(F.col("k") / resample.RANGE).cast("bigint").alias("range")
    ranges = (
        index.table.select(F.col("target").cast("int").alias("target"), at, F.struct("k", *numbered).alias("row"))
        .groupBy("target", "range")
        .agg(F.collect_list("row").alias("index"))
        .withColumn("rep", F.lit(resample.INDEX))
    )
    met = (
        draws(index.table, replicates, seed)
        .unionByName(ranges, allowMissingColumns=True)
        .repartition(width(index.table.sparkSession), "target", "range")
        .sortWithinPartitions("target", "range", "rep")
        .mapInArrow(resample.meet_ranges(len(index.sides), RANK_BLOCK), resample.GROUPED)
    )
    # The partitioning by (rep, side, block) serves both aggregations: rows are opened behind the shuffle.
    opened = met.repartition(width(index.table.sparkSession), "rep", "side", "block").select(
        "rep", "side", "block", "target", F.inline(F.arrays_zip("rank", "n", "ok"))
    )
    groups = opened.groupBy("rep", "side", "block", "rank").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("target") == 1, F.col("n")).otherwise(0)).alias("p"),
        F.sum("ok").alias("ok"),
    )
    return groups.groupBy("rep", "side", "block").agg(
        F.array_sort(F.collect_list(F.struct("rank", "n", "p", "ok"))).alias("groups")
    )


SUMMARY = "struct<background:bigint,signal:bigint,pairs:bigint,ok:bigint>"


def merged(left: Column, right: Column) -> Column:
    """The summary of two neighbouring rank ranges; ``pairs`` is doubled."""
    return F.struct(
        (left["background"] + right["background"]).alias("background"),
        (left["signal"] + right["signal"]).alias("signal"),
        (left["pairs"] + right["pairs"] + 2 * right["signal"] * left["background"]).alias("pairs"),
        (left["ok"] + right["ok"]).alias("ok"),
    )


def empty_summary() -> Column:
    zero = F.lit(0).cast("bigint")
    return F.struct(*[zero.alias(c) for c in ("background", "signal", "pairs", "ok")]).cast(SUMMARY)


def group_summary(group: Column) -> Column:
    """A tie group: its own pairs are ties, half each."""
    background = group["n"] - group["p"]
    return F.struct(
        background.alias("background"),
        group["p"].alias("signal"),
        (group["p"] * background).alias("pairs"),
        group["ok"].alias("ok"),
    )


def folded(parts: Column) -> Column:
    return F.aggregate(parts, empty_summary(), lambda done, part: merged(done, part).cast(SUMMARY))


def crossings(parts: Column, total: Column, efficiencies: Sequence[float]) -> Column:
    """Per target the part, and the counts above it, in which signal efficiency first reaches it.

    ``parts`` are ``(at, signal, background)`` in rank order; the walk goes from high ranks down.
    """
    kind = "struct<signal:bigint,background:bigint,found:array<struct<goal:int,at:int,signal:bigint,background:bigint>>>"
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("signal"), zero.alias("background"), F.array().alias("found")).cast(kind)

    def step(state: Column, part: Column) -> Column:
        found = state["found"]
        for number, efficiency in enumerate(efficiencies):
            here = (state["signal"] / total < efficiency) & (
                (state["signal"] + part["signal"]) / total >= efficiency
            )
            mark = F.struct(
                F.lit(number).alias("goal"),
                part["at"].cast("int").alias("at"),
                state["signal"].alias("signal"),
                state["background"].alias("background"),
            )
            found = F.when(here, F.array_append(found, mark)).otherwise(found)
        return F.struct(
            (state["signal"] + part["signal"]).alias("signal"),
            (state["background"] + part["background"]).alias("background"),
            found.alias("found"),
        ).cast(kind)

    return F.aggregate(F.reverse(parts), start, step)["found"]


def replicate_metrics(
    index: RankIndex,
    replicates: int,
    seed: int,
    efficiencies: Sequence[float] = EFFICIENCIES,
    accuracy: bool = False,
) -> DataFrame:
    """``(rep, side, roc_auc, [accuracy], background_rejection_..)``; replicate -1 is the observed one."""
    # Read for the sums and for the blocks with a crossing: drawn once.
    with small_batches(index.table.sparkSession, BATCH_ROWS):
        blocks = stored(rank_blocks(index, replicates, seed))
    summed = blocks.select(
        "rep", "side", "block", folded(F.transform("groups", group_summary)).alias("sum")
    )
    ordered = F.array_sort(F.collect_list(F.struct("block", "sum")))
    whole = summed.groupBy("rep", "side").agg(ordered.alias("parts"))
    done = whole.withColumn("all", folded(F.transform("parts", lambda part: part["sum"])))
    signal, background = F.col("all.signal"), F.col("all.background")
    both = (signal > 0) & (background > 0)
    auc = F.col("all.pairs") / (F.lit(2.0) * signal * background)
    names = F.array(*[F.lit(name) for name in index.sides])
    made = done.select(
        "rep",
        F.get(names, F.col("side")).alias("side"),
        F.when(both, auc).alias("roc_auc"),
        *([(F.col("all.ok") / (signal + background)).alias("accuracy")] if accuracy else []),
    )
    if not efficiencies:
        return made
    parts = F.transform(
        "parts",
        lambda part: F.struct(
            part["block"].alias("at"),
            part["sum"]["signal"].alias("signal"),
            part["sum"]["background"].alias("background"),
        ),
    )
    places = done.filter(both).select(
        "rep",
        "side",
        signal.alias("signals"),
        background.alias("backgrounds"),
        F.inline(crossings(parts, signal, efficiencies)),
    )
    inside = blocks.join(places.withColumnRenamed("at", "block"), ["rep", "side", "block"])
    rejection = inside.groupBy("rep", F.get(names, F.col("side")).alias("side")).agg(
        *[
            F.max(F.when(F.col("goal") == number, _background_efficiency(efficiency))).alias(
                f"e_{label_of(efficiency)}"
            )
            for number, efficiency in enumerate(efficiencies)
        ]
    )
    columns = made.columns
    joined = made.join(rejection, ["rep", "side"], "left")
    return joined.select(
        *columns,
        *[
            F.when(F.col(f"e_{label_of(e)}") > 0, F.lit(1.0) / F.col(f"e_{label_of(e)}")).alias(
                f"background_rejection_{label_of(e)}"
            )
            for e in efficiencies
        ],
    )


def _background_efficiency(efficiency: float) -> Column:
    """Interpolated at the tie group in which signal efficiency first reaches the target."""
    kind = "struct<signal:bigint,background:bigint,value:double>"
    signals, backgrounds = F.col("signals"), F.col("backgrounds")

    def step(state: Column, group: Column) -> Column:
        passed, false = state["signal"] + group["p"], state["background"] + group["n"] - group["p"]
        tpr, tpr_above = passed / signals, state["signal"] / signals
        fpr, fpr_above = false / backgrounds, state["background"] / backgrounds
        here = (tpr >= efficiency) & (tpr_above < efficiency)
        between = fpr_above + (F.lit(efficiency) - tpr_above) / (tpr - tpr_above) * (fpr - fpr_above)
        value = F.when(here, F.when(tpr == efficiency, fpr).otherwise(between)).otherwise(state["value"])
        return F.struct(
            passed.alias("signal"), false.alias("background"), value.alias("value")
        ).cast(kind)

    start = F.struct(
        F.col("signal"), F.col("background"), F.lit(None).cast("double").alias("value")
    ).cast(kind)
    return F.aggregate(F.reverse("groups"), start, step)["value"]


def paired_bootstrap(
    rows: DataFrame,
    left: str,
    right: str,
    replicates: int,
    seed: int,
    thresholds: tuple[float, float] | None = None,
    efficiencies: Sequence[float] = EFFICIENCIES,
) -> DataFrame:
    """Observed difference and 95 % interval per metric; ``rows(jet_id, target, left, right)``.

    Replicate ``-1`` carries the observed rows, so observed and resampled values come out
    of one aggregation.  ``status`` tells what the interval is worth; a row without both scores
    and both classes in the test set are preconditions of any.
    """
    check_policy(replicates, seed)
    limits = None if thresholds is None else {"l": thresholds[0], "r": thresholds[1]}
    index = rank_index(rows, seed, {"l": left, "r": right}, limits)
    made = replicate_metrics(index, replicates, seed, efficiencies, accuracy=limits is not None)
    names = ["roc_auc", *(["accuracy"] if limits else [])]
    names += [f"background_rejection_{label_of(e)}" for e in efficiencies]
    pair = made.groupBy("rep").agg(
        *[
            (
                F.max(F.when(F.col("side") == "l", F.col(m)))
                - F.max(F.when(F.col("side") == "r", F.col(m)))
            ).alias(m)
            for m in names
        ]
    )
    long = pair.select(
        "rep",
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("delta")) for m in names])
        ).alias("d"),
    ).select("rep", "d.metric", "d.delta")
    drawn = F.col("rep") >= 0
    value = F.when(drawn, F.col("delta"))
    done = long.groupBy("metric").agg(
        F.max(F.when(~drawn, F.col("delta"))).alias("observed_delta"),
        F.percentile(value, F.array(F.lit(0.025), F.lit(0.975))).alias("q"),
        F.count_if(drawn & F.col("delta").isNull()).alias("discarded_count"),
    )
    return done.select(
        "metric",
        "observed_delta",
        F.col("q")[0].alias("low"),
        F.col("q")[1].alias("high"),
        F.lit(replicates).alias("replicate_count"),
        "discarded_count",
        F.lit(seed).alias("bootstrap_seed"),
        F.when(F.lit(index.unpaired > 0), F.lit("METRIC_BOOTSTRAP_ALIGNMENT"))
        .when(F.lit(index.classes < 2), F.lit("METRIC_BOOTSTRAP_CLASSES"))
        .when(F.col("observed_delta").isNull(), F.lit("METRIC_BOOTSTRAP_OBSERVED"))
        .when(F.col("discarded_count") == replicates, F.lit("METRIC_BOOTSTRAP_EMPTY"))
        .when(F.col("discarded_count") > 0.01 * replicates, F.lit("METRIC_BOOTSTRAP_DISCARDS"))
        .otherwise(F.lit("ok"))
        .alias("status"),
    )


def shuffled_labels(rows: DataFrame, seed: int, id_col: str = "jet_id") -> DataFrame:
    """Labels permuted by a seeded rank: the P rows of smallest rank become the positives.

    For binary labels this is a uniform permutation, and it needs no second ordering.
    """
    positives = rows.agg(F.sum(F.col("target").cast("bigint"))).scalar()
    placed = hash_ordinal(rows, id_col, seed, name="_at")
    return placed.withColumn(
        "target", F.when(F.col("_at") <= positives, F.lit(1)).otherwise(F.lit(0)).cast("tinyint")
    ).drop("_at")


def auc_interval(rows: DataFrame, score: str, replicates: int, seed: int) -> DataFrame:
    """AUC and its 95 % bootstrap interval for one score column."""
    check_policy(replicates, seed)
    index = rank_index(rows, seed, {"one": score})
    made = replicate_metrics(index, replicates, seed, ())
    value = F.when(F.col("rep") >= 0, F.col("roc_auc"))
    return made.agg(
        F.max(F.when(F.col("rep") < 0, F.col("roc_auc"))).alias("auc"),
        F.percentile(value, F.array(F.lit(0.025), F.lit(0.975))).alias("q"),
    ).select(
        "auc",
        F.col("q")[0].alias("low"),
        F.col("q")[1].alias("high"),
        ((F.col("q")[0] <= 0.5) & (F.col("q")[1] >= 0.5)).alias("contains_half"),
    )


def gap_fraction(
    rows: DataFrame, small: str, large: str, replicates: int, seed: int, floor: float = 0.01
) -> DataFrame:
    """``(AUC_n - .5) / (AUC_max - .5)`` with the bootstrap stability rule.

    Unstable when the central denominator is at most ``floor`` or when more than 5 % of
    the paired replicates have such a denominator; then only the raw difference is given.
    """
    check_policy(replicates, seed)
    index = rank_index(rows, seed, {"s": small, "m": large})
    made = replicate_metrics(index, replicates, seed, ())
    pair = made.groupBy("rep").agg(
        F.max(F.when(F.col("side") == "s", F.col("roc_auc"))).alias("auc_n"),
        F.max(F.when(F.col("side") == "m", F.col("roc_auc"))).alias("auc_max"),
    )
    central = F.col("rep") < 0
    low = (F.col("auc_max") - 0.5 <= floor).cast("double")
    done = pair.agg(
        F.max(F.when(central, F.col("auc_n"))).alias("auc_n"),
        F.max(F.when(central, F.col("auc_max"))).alias("auc_max"),
        F.avg(F.when(~central, low)).alias("small_denominators"),
    )
    unstable = (F.col("auc_max") - 0.5 <= floor) | (F.col("small_denominators") > 0.05)
    return done.select(
        "auc_n",
        "auc_max",
        "small_denominators",
        unstable.alias("unstable"),
        F.when(~unstable, (F.col("auc_n") - 0.5) / (F.col("auc_max") - 0.5)).alias(
            "auc_gap_fraction"
        ),
        (F.col("auc_n") - F.col("auc_max")).alias("auc_difference"),
    )
