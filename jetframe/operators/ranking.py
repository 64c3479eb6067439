"""Exact global order without one task holding it all.

Rows are cut into bins whose order is known, the bins are counted (a map-side combined
aggregate with few rows), the counts are accumulated over the bins, and only the rows of
one bin are sorted together.  Seeded ranks are SHA-256 texts, so their leading hex digits
give bins of equal size whatever the keys look like, also when one key holds a third of
all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jetframe.functions.identity import named_split, seeded_rank
from jetframe.operators.ordered import range_bounds, with_bin
from jetframe.rules import union_all
from jetframe.session import stored


def binned_ordinal(
    df: DataFrame,
    keys: Sequence[str],
    bin_col: str,
    order: Sequence[str],
    name: str = "ordinal",
    limit: int | None = None,
) -> DataFrame:
    """Add the 1-based position of every row inside ``keys`` in ``(bin_col, order)`` order.

    With ``limit`` only the first ``limit`` rows per key are returned; bins that start
    beyond it are dropped before their rows are shuffled or sorted.
    """
    before = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy(bin_col)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        df.groupBy(*keys, bin_col)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            *keys, bin_col, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
        )
    )
    if limit is not None:
        offsets = offsets.filter(F.col("_before") < limit)
    inside = Window.partitionBy(*keys, bin_col).orderBy(*order)
    placed = df.join(offsets, [*keys, bin_col]).withColumn(
        name, F.row_number().over(inside) + F.col("_before")
    )
    if limit is not None:
        placed = placed.filter(F.col(name) <= limit)
    return placed.drop("_before")


def dense_positions(df: DataFrame, order: str, name: str = "pos") -> DataFrame:
    """Add the 0-based position in the order of a column; ranges of it are counted, then placed."""
    ranged = with_bin(df, order, range_bounds(df, order))
    placed = binned_ordinal(ranged, [], "_bin", [order], name)
    return placed.withColumn(name, F.col(name) - 1).drop("_bin")


def hash_ordinal(
    df: DataFrame,
    id_col: str,
    seed: int | Column,
    keys: Sequence[str] = (),
    name: str = "ordinal",
    limit: int | None = None,
    digits: int = 3,
) -> DataFrame:
    """Position of every row in ``(sha256(seed, NUL, id), id)`` order inside ``keys``.

    ``16 ** digits`` bins per key: three digits hold ten billion rows of one key at
    about 2.4 million rows a bin.
    """
    ranked = df.withColumn("_rank", seeded_rank(seed, F.col(id_col))).withColumn(
        "_bin", F.substring("_rank", 1, digits)
    )
    return binned_ordinal(ranked, keys, "_bin", ["_rank", id_col], name, limit).drop(
        "_rank", "_bin"
    )


def check_sizes(sizes: Sequence[int]) -> list[int]:
    grid = list(sizes)
    if not grid or grid[0] <= 0 or any(b <= a for a, b in zip(grid, grid[1:])):
        raise ValueError("subset sizes must be positive and strictly increasing")
    return grid


def turn_places(sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, _lane, _lo, _hi, _small, _reach, _place)``: where a lane's turns stand when lanes take turns.

    ``sizes`` has the ``size`` of every lane.  Between two neighbouring sizes the same lanes are still taking
    turns, so with ``_lo < turn <= _hi`` the place of a row is
    ``_small + (turn - 1) * _reach + _place``: all rows of the lanes that have run out, the earlier turns of
    those that have not, and the lanes that come before in this turn.  A row per lane and size.
    """
    lane = sizes.select(*keys, "_lane", "size")
    steps = lane.groupBy(*keys, "size").agg(F.count("*").alias("_lanes"))
    by_size = Window.partitionBy(*keys).orderBy("size")
    earlier, later = (
        by_size.rowsBetween(Window.unboundedPreceding, -1),
        by_size.rowsBetween(Window.currentRow, Window.unboundedFollowing),
    )
    zero = F.lit(0).cast("bigint")
    bounded = steps.select(
        *keys,
        F.coalesce(F.lag("size").over(by_size), zero).alias("_lo"),
        F.col("size").alias("_hi"),
        F.coalesce(F.sum(F.col("size") * F.col("_lanes")).over(earlier), zero).alias("_small"),
        F.sum("_lanes").over(later).alias("_reach"),
    )
    among = Window.partitionBy(*keys, "_hi").orderBy("_lane")
    met = lane.join(bounded, list(keys))
    return (
        met.filter(F.col("_hi") <= F.col("size"))
        .withColumn("_place", F.row_number().over(among))
        .drop("size")
    )


def balanced_order(
    rows: DataFrame,
    limit: int,
    seed: int | Column,
    by: Sequence[str] = (),
    label: str = "label",
    record: str = "record_id",
    id_col: str = "jet_id",
    digits: int = 3,
) -> DataFrame:
    """The first ``limit`` rows of each class in selection order, as column ``pos``.

    Class 1 is one queue in seeded order.  Class 0 has one queue per record, and the
    queues take turns in ascending record order; a row's turn is its position in its
    own queue, so the overall order is ``(turn, record)``.  Rows are counted once per queue and bin of
    their rank; both the turn and the place follow from these counts, so the rows are read twice and ordered
    once, whatever the limit.
    """
    keys = [*by, label]
    lanes = rows.withColumn(
        "_lane", F.when(F.col(label) == 1, F.lit(-1).cast("bigint")).otherwise(F.col(record))
    )
    ranked = lanes.withColumn("_rank", seeded_rank(seed, F.col(id_col))).withColumn(
        "_bin", F.substring("_rank", 1, digits)
    )
    counted = stored(ranked.groupBy(*keys, "_lane", "_bin").agg(F.count("*").alias("_rows")))
    before = (
        Window.partitionBy(*keys, "_lane").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counted.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).filter(
        F.col("_before") < limit
    )
    inside = Window.partitionBy(*keys, "_lane", "_bin").orderBy("_rank", id_col)
    queued = ranked.join(offsets.drop("_rows"), [*keys, "_lane", "_bin"]).withColumn(
        "_turn", F.row_number().over(inside) + F.col("_before")
    )
    sizes = counted.groupBy(*keys, "_lane").agg(F.least(F.sum("_rows"), F.lit(limit)).alias("size"))
    placed = queued.filter(F.col("_turn") <= limit).join(turn_places(sizes, keys), [*keys, "_lane"])
    turn = F.col("_turn")
    found = placed.filter((turn > F.col("_lo")) & (turn <= F.col("_hi"))).withColumn(
        "pos", (F.col("_small") + (turn - 1) * F.col("_reach") + F.col("_place")).cast("bigint")
    )
    made = ["_lane", "_rank", "_bin", "_before", "_turn", "_lo", "_hi", "_small", "_reach", "_place"]
    return found.filter(F.col("pos") <= limit).drop(*made)


def subset_members(
    ordered: DataFrame, sizes: Sequence[int], by: Sequence[str] = (), label: str = "label"
) -> DataFrame:
    """``(subset_id, label, pos, jet_id)``: each size is a prefix of the same order."""
    grid = check_sizes(sizes)
    size = F.explode(F.filter(F.array(*[F.lit(n) for n in grid]), lambda n: n >= F.col("pos")))
    return ordered.select(*by, label, "pos", "jet_id", size.alias("size")).select(
        *by,
        F.concat(F.lit("n"), F.col("size").cast("string")).alias("subset_id"),
        F.col("size"),
        label,
        "pos",
        "jet_id",
    )


def yield_violations(
    members: DataFrame, sizes: Sequence[int], by: Sequence[str] = (), label: str = "label"
) -> DataFrame:
    """Classes that hold fewer rows than a subset asks for."""
    found = members.groupBy(*by, "subset_id", "size").agg(
        F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")
    )
    short = found.filter((F.col("n0") < F.col("size")) | (F.col("n1") < F.col("size")))
    listed = short.select(
        F.lit("SPLIT_INSUFFICIENT_CLASS_YIELD").alias("rule"),
        F.concat_ws(":", *[F.col(c).cast("string") for c in by], F.col("subset_id")).alias("key"),
        F.format_string("class0=%d class1=%d", "n0", "n1").alias("detail"),
    )
    if by:
        return listed
    # A subset with no row at all does not show up in the counts.
    present = members.agg(F.collect_set("size").alias("have"))
    absent = present.select(
        F.explode(F.array_except(F.array(*[F.lit(n) for n in sizes]), F.col("have"))).alias("n")
    ).select(
        F.lit("SPLIT_INSUFFICIENT_CLASS_YIELD").alias("rule"),
        F.concat(F.lit("n"), F.col("n").cast("string")).alias("key"),
        F.lit("class0=0 class1=0").alias("detail"),
    )
    return union_all([listed, absent])


def nested_violations(members: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Positions at which two subset sizes name different rows (there must be none)."""
    return (
        members.groupBy(*by, label, "pos")
        .agg(F.min("jet_id").alias("lo"), F.max("jet_id").alias("hi"))
        .filter(F.col("lo") != F.col("hi"))
        .select(
            F.lit("SPLIT_NOT_NESTED").alias("rule"),
            F.concat_ws(":", *[F.col(c).cast("string") for c in (*by, label, "pos")]).alias("key"),
            F.concat_ws(",", "lo", "hi").alias("detail"),
        )
    )


def named_or_ratio_split(
    files: DataFrame, name_col: str, seed: int, ratios: tuple[float, float, float]
) -> DataFrame:
    """The split the file names tell; a seeded split by ratio only where no name tells one.

    If any name does, files without such a name are in no split.
    """
    told = files.withColumn("split", named_split(F.substring_index(name_col, "/", -1)))
    named = told.agg(F.count("split")).scalar()
    drawn = ratio_split(files, name_col, seed, ratios).filter(named == 0)
    return told.filter("split IS NOT NULL").unionByName(drawn)


def ratio_split(
    files: DataFrame, name_col: str, seed: int, ratios: tuple[float, float, float]
) -> DataFrame:
    """Seeded split of a file list by ratio; sizes round half to even."""
    if abs(sum(ratios) - 1.0) > 1e-8:
        raise ValueError("ratios must sum to one")
    placed = hash_ordinal(files, name_col, seed, name="_at")
    total = files.agg(F.count(F.lit(1)).cast("double")).scalar()
    n_train = F.bround(total * F.lit(float(ratios[0])))
    n_val = F.least(F.bround(total * F.lit(float(ratios[1]))), total - n_train)
    return placed.withColumn(
        "split",
        F.when(F.col("_at") <= n_train, F.lit("train"))
        .when(F.col("_at") <= n_train + n_val, F.lit("validation"))
        .otherwise(F.lit("test")),
    ).drop("_at")
