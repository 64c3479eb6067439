"""Truth matching in angle space, decay graphs and the selection cut-flow."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from jetframe.functions.particles import delta_r
from jetframe.operators.ranking import binned_ordinal
from jetframe.session import Shelf, stored

# Selection window and match radius.
PT_MIN, PT_MAX, ETA_MAX = 500.0, 1000.0, 2.0
MATCH_RADIUS = 0.8
TOP, BOTTOM, W_BOSON = 6, 5, 24

PHI_CELLS = int(2.0 * math.pi / MATCH_RADIUS)


def kinematic(pt: Column, eta: Column) -> Column:
    return (pt >= PT_MIN) & (pt < PT_MAX) & (F.abs(eta) < ETA_MAX)


def eta_cell(eta: Column) -> Column:
    return F.floor(eta / F.lit(MATCH_RADIUS)).cast("int")


def phi_cell(phi: Column) -> Column:
    """One of seven cells around the circle, each at least a match radius wide."""
    at = F.floor((phi + F.lit(math.pi)) / F.lit(2.0 * math.pi / PHI_CELLS)).cast("int")
    return F.pmod(at, F.lit(PHI_CELLS))


def event_index(jets: DataFrame, keys: Sequence[str], source: str, block: int = 4096) -> DataFrame:
    """0-based index of kept jets inside their event, in source order.

    Source positions are cut into blocks, so an event with very many rows is numbered by
    many tasks.
    """
    blocks = jets.withColumn("_block", F.floor(F.col(source) / block))
    placed = binned_ordinal(blocks, keys, "_block", [source], "_at")
    return placed.withColumn("jet_index", (F.col("_at") - 1).cast("int")).drop("_at", "_block")


def truth_matches(
    jets: DataFrame,
    tops: DataFrame,
    event: Sequence[str],
    jet_key: Sequence[str],
    radius: float = MATCH_RADIUS,
) -> DataFrame:
    """``(jet_key..., matches)`` for jets with at least one eligible top.

    A top matches when it and its three daughters lie within ``radius``.  Jets are placed
    in their angular cell and the eight around it, so only neighbours in the same event
    meet, whatever the size of the event; both coordinates of a match differ by less than
    a cell.
    """
    if radius > MATCH_RADIUS:
        raise ValueError("the cells are made for radii up to the match radius")
    around = [F.struct(F.lit(i).alias("de"), F.lit(j).alias("dp")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    wide = (
        jets.select(*event, *[c for c in jet_key if c not in event], "eta", "phi")
        .withColumn("d", F.explode(F.array(*around)))
        .withColumns(
            {
                "_e": eta_cell(F.col("eta")) + F.col("d.de"),
                "_p": F.pmod(phi_cell(F.col("phi")) + F.col("d.dp"), F.lit(PHI_CELLS)),
            }
        )
        .drop("d")
    )
    placed = tops.withColumns({"_e": eta_cell(F.col("t_eta")), "_p": phi_cell(F.col("t_phi"))})
    near = [
        delta_r(F.col("eta"), F.col("phi"), F.col(f"{p}_eta"), F.col(f"{p}_phi")) < radius
        for p in ("t", "b", "q1", "q2")
    ]
    return (
        wide.join(placed, [*event, "_e", "_p"])
        .filter(near[0] & near[1] & near[2] & near[3])
        .groupBy(*jet_key)
        .agg(F.count(F.lit(1)).alias("matches"))
    )


def match_status(matches: Column, is_signal: Column) -> Column:
    """Signal: one match is kept, none is dropped (never background), more is an error.

    Background samples are not matched: their jets are kept as they are.
    """
    return (
        F.when(~is_signal, F.lit("background"))
        .when(matches == 1, F.lit("matched"))
        .when(matches > 1, F.lit("EXTRACT_AMBIGUOUS_TRUTH"))
        .otherwise(F.lit("dropped"))
    )


def cutflow(jets: DataFrame, by: str, event: Sequence[str], flags: dict[str, Column]) -> DataFrame:
    """Events, jets and jets passing each stage, per record.

    Stages are counted per event first, so distinct events need no second pass.
    """
    per_event = jets.groupBy(by, *[c for c in event if c != by]).agg(
        F.count(F.lit(1)).alias("jets"),
        *[F.count_if(flag).alias(name) for name, flag in flags.items()],
    )
    return per_event.groupBy(by).agg(
        F.count(F.lit(1)).alias("events"),
        F.sum("jets").alias("jets"),
        *[F.sum(name).alias(name) for name in flags],
    )


def next_copy(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, next)``: the first daughter that carries the same code."""
    mother = nodes.select(F.col("node").alias("mother"), F.col("code").alias("m_code"))
    child = nodes.select(F.col("node").alias("daughter"), F.col("code").alias("d_code"))
    same = edges.join(mother, "mother").join(child, "daughter").filter("m_code = d_code")
    return same.groupBy(F.col("mother").alias("node")).agg(F.min_by("daughter", "ord").alias("next"))


def terminal_copies(edges: DataFrame, nodes: DataFrame, max_rounds: int = 32) -> DataFrame:
    """``(node, terminal)`` for every node.

    Pointer doubling: each round replaces a pointer by the pointer of its target, so a
    chain of length n takes log2(n) rounds.  Only chains that still move are joined; a node whose target
    points nowhere is finished and leaves.  Rounds are tables in the shared folder, and a round's table
    of moving chains goes when the next is written.  A target that very many chains share stands
    once on its side of the join, so the other side can be split.
    A chain that is still moving after ``max_rounds`` is a cycle.
    """
    shelf = Shelf(nodes.sparkSession)
    moving = shelf.put(next_copy(edges, nodes).select("node", F.col("next").alias("ptr")))
    known, finished = moving, None
    for _ in range(max_rounds):
        hop = known.select(F.col("node").alias("ptr"), F.col("ptr").alias("hop"))
        seen = Observation()
        step = moving.join(hop, "ptr", "left").select(
            "node", F.coalesce("hop", "ptr").alias("ptr"), F.col("hop").isNotNull().alias("moved")
        )
        parts = shelf.put(
            step.observe(seen, F.count_if("moved").alias("moved"), F.count("*").alias("rows"))
        )
        ended = shelf.put(parts.filter("NOT moved").select("node", "ptr"))
        still = shelf.put(parts.filter("moved").select("node", "ptr"), parts, moving)
        finished = ended if finished is None else finished.union(ended)
        moving, known = still, finished.union(still)
        if not seen.get["moved"]:
            break
    else:
        shelf.close()
        raise ValueError("copy chain does not end: the graph has a cycle")
    return nodes.select("node").join(finished, "node", "left").select(
        "node", F.coalesce("ptr", "node").alias("terminal")
    )


def decay_signature(edges: DataFrame, nodes: DataFrame, terminal: DataFrame) -> DataFrame:
    """Terminal tops that decay to a b and a W whose daughters are exactly two light codes.

    Returns ``(top, bottom, q1, q2)``, each followed to its terminal copy.
    """
    size = F.abs(F.col("code"))
    # Read for the decay of the top and of the W.
    coded = stored(edges.join(nodes.select(F.col("node").alias("daughter"), "code"), "daughter"))
    tops = nodes.filter(size == TOP).join(terminal.filter("node = terminal"), "node").select("node")
    first = (
        coded.filter(size.isin(BOTTOM, W_BOSON))
        .join(tops.withColumnRenamed("node", "mother"), "mother", "left_semi")
        .groupBy(F.col("mother").alias("top"))
        .agg(
            F.max_by(F.when(size == BOTTOM, F.col("daughter")), F.when(size == BOTTOM, F.col("ord"))).alias("b"),
            F.max_by(F.when(size == W_BOSON, F.col("daughter")), F.when(size == W_BOSON, F.col("ord"))).alias("w"),
        )
        .filter("b IS NOT NULL AND w IS NOT NULL")
    )

    def followed(df: DataFrame, column: str) -> DataFrame:
        end = terminal.select(F.col("node").alias(column), F.col("terminal").alias(f"{column}_end"))
        return df.join(end, column).drop(column).withColumnRenamed(f"{column}_end", column)

    ends = followed(followed(first, "b"), "w")
    quarks = (
        coded.filter(size.between(1, 5))
        .groupBy(F.col("mother").alias("w"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min_by("daughter", "ord").alias("q1"),
            F.max_by("daughter", "ord").alias("q2"),
        )
        .filter("n = 2")
    )
    found = ends.join(quarks, "w").select("top", F.col("b").alias("bottom"), "q1", "q2")
    return followed(followed(found, "q1"), "q2").select("top", "bottom", "q1", "q2")
