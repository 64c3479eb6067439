"""Content digests of tables and of grouped files."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from jetframe.session import stored

# Names the rule, so a digest is only compared with one made the same way.
CANONICALIZATION = "row-sha256-lane-sum-v1"
LANES = 8


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 of the row as a JSON object with sorted names; nulls are kept."""
    named = [F.col(c).alias(c) for c in sorted(columns)]
    return F.sha2(F.to_json(F.struct(*named), {"ignoreNullFields": "false"}), 256)


def content_digest(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), counts: Mapping[str, Column] | None = None
) -> DataFrame:
    """Digest of the multiset of rows, per ``keys``; ``counts`` are conditions whose rows the same pass counts.

    Every row digest is cut into eight 32-bit lanes and the lanes are added up; the sums
    and the row count are hashed.  Addition combines on the map side, does not depend on
    order or partitioning, and unlike xor sees repeated rows.  Where order has a meaning,
    put the position column into ``columns``.
    """
    counts = counts or {}
    held = [condition.alias(name) for name, condition in counts.items()]
    digest = df.select(*keys, row_digest(columns).alias("_d"), *held)
    sums = digest.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), *_lanes(), *[F.count_if(F.col(name)).alias(name) for name in counts]
    )
    text = F.concat_ws(
        ":",
        F.lit(CANONICALIZATION),
        F.col("rows").cast("string"),
        *[F.coalesce(F.col(f"_l{i}").cast("string"), F.lit("0")) for i in range(LANES)],
    )
    return sums.select(*keys, "rows", F.sha2(text, 256).alias("digest"), *counts)


def _lanes() -> list[Column]:
    return [
        F.sum(F.conv(F.substring("_d", 1 + 8 * i, 8), 16, 10).cast("decimal(18,0)")).alias(f"_l{i}")
        for i in range(LANES)
    ]


class ObservedDigest:
    """Digest of the rows that pass through a write; nothing is read again.

    ``watch`` gives the table to write. After the write, ``result`` is what :func:`content_digest` gives for
    the same columns.
    """

    def __init__(self) -> None:
        self._seen = Observation()

    def watch(self, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        marked = df.withColumn("_d", row_digest(columns))
        return marked.observe(self._seen, F.count(F.lit(1)).alias("rows"), *_lanes()).drop("_d")

    def result(self) -> tuple[int, str]:
        found = self._seen.get
        sums = [str(int(found[f"_l{i}"] or 0)) for i in range(LANES)]
        text = ":".join([CANONICALIZATION, str(found["rows"]), *sums])
        return found["rows"], hashlib.sha256(text.encode()).hexdigest()


# Modulus and base of the order digest: products of two residues fit 64 bits.
ORDER_RULE = "polynomial-mod-2147483647-pair-v1"
MODULUS = 2_147_483_647
BASES = (1_000_003, 69_069)


# Exponents are read in digits of so many bits, which look up their powers: few products, so the generated method
# stays below the size beyond which the JVM does not compile it.
DIGIT_BITS, DIGITS = 8, 5


def _power(base: int, exponent: Column) -> Column:
    """``base ** exponent`` modulo the modulus, by the digits of the exponent; 1 where it is null or negative."""
    out = F.lit(1).cast("bigint")
    for digit in range(DIGITS):
        at = DIGIT_BITS * digit
        powers = ",".join(f"{pow(base, n << at, MODULUS)}L" for n in range(1 << DIGIT_BITS))
        index = (F.shiftright(exponent.cast("bigint"), at) % (1 << DIGIT_BITS)).cast("int")
        out = out * F.coalesce(F.get(F.expr(f"array({powers})"), index), F.lit(1)) % MODULUS
    return out


def order_digest(df: DataFrame, value: str, pos: str, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, rows, order_digest)`` of the values in the order of their 0-based positions.

    The digest of a sequence is ``sum(hash(value) * base ** position)`` for two bases, which adds up from any
    parts: rows are combined where they are, and nothing is sorted.  Moved, missing, repeated and
    exchanged values change it.
    """
    number = F.conv(F.substring(F.sha2(F.col(value).cast("string"), 256), 1, 12), 16, 10).cast("bigint")
    value_of = (number % (MODULUS - 1)) + 1
    terms = df.select(
        *keys,
        *[
            (value_of * _power(base, F.col(pos)) % MODULUS).alias(f"_t{i}")
            for i, base in enumerate(BASES)
        ],
    )
    sums = terms.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(f"_t{i}").alias(f"_s{i}") for i in range(len(BASES))],
    )
    residues = [(F.col(f"_s{i}") % MODULUS).cast("string") for i in range(len(BASES))]
    return sums.select(
        *keys, "rows", F.concat_ws(":", F.lit(ORDER_RULE), F.col("rows").cast("string"), *residues).alias("order_digest")
    )


def artifact_key(name: Column) -> Column:
    """Logical file of a shard: the name without ``.index`` or ``.data-NNNNN-of-NNNNN``.

    Null for a bare ``checkpoint`` pointer file, which belongs to no artifact.
    """
    base = F.regexp_replace(name, r"(?i)(\.index|\.data-\d{5}-of-\d{5})$", "")
    return F.when(F.lower(F.element_at(F.split(name, "/"), -1)) == "checkpoint", F.lit(None)).otherwise(base)


# Leading hex digits of a name's hash that make the smallest ranges of a digest tree.
TREE_DIGITS = 4
TREE_RULE = "sha256-name-range-tree-v1"


def name_range(name: Column, digits: int = TREE_DIGITS) -> Column:
    return F.substring(F.sha2(name, 256), 1, digits)


def _combined(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, "\n"), 256)


def smallest_ranges(members: DataFrame, key: str, name: str, facts: Sequence[str]) -> DataFrame:
    """``(key, range, members, digest)`` of the smallest ranges: their members' lines in name order.

    Ranges are of equal size whatever the names look like, so a set that holds most members is spread
    over ``16 ** TREE_DIGITS`` groups.
    """
    line = F.concat_ws("\t", F.col(name), *[F.col(c).cast("string") for c in facts])
    return (
        members.select(key, name_range(F.col(name)).alias("range"), line.alias("line"))
        .groupBy(key, "range")
        .agg(F.count("*").alias("members"), _combined(F.array_sort(F.collect_list("line"))).alias("digest"))
    )


def next_ranges(level: DataFrame, key: str) -> DataFrame:
    """The level above: a range is its at most sixteen parts, each with its digest, in order."""
    part = F.concat_ws(":", "range", "digest")
    return (
        level.withColumn("part", part)
        .withColumn("range", F.substring("range", F.lit(1), F.length("range") - 1))
        .groupBy(key, "range")
        .agg(
            F.sum("members").alias("members"),
            _combined(F.array_sort(F.collect_list("part"))).alias("digest"),
        )
    )


def digest_tree(
    members: DataFrame, key: str, name: str, facts: Sequence[str], keep: bool = False
) -> list[DataFrame]:
    """All levels, the smallest ranges first; the last has one row per ``key``, with range ''.

    With ``keep`` the smallest ranges are stored: for trees of which several levels are read.
    """
    smallest = smallest_ranges(members, key, name, facts)
    levels = [stored(smallest) if keep else smallest]
    for _ in range(TREE_DIGITS):
        levels.append(next_ranges(levels[-1], key))
    return levels


def artifact_digest(files: DataFrame, key: str, name: str, sha: str) -> DataFrame:
    """``(artifact, members, digest)``: the root over the names and digests of an artifact's members.

    Partial digests are combined level by level, so the members of one artifact are never together.
    """
    members = files.select(
        F.col(key).alias("artifact"), F.col(name).alias("name"), F.col(sha).alias("sha")
    ).filter(F.col("artifact").isNotNull())
    return digest_tree(members, "artifact", "name", ["sha"])[-1].select("artifact", "members", "digest")


def differing_ranges(left: list[DataFrame], right: list[DataFrame], key: str) -> DataFrame:
    """``(key, range)`` of the smallest ranges that differ, found from the roots down.

    A level is compared only inside the ranges that differ above it, so trees that were stored are read
    along the paths to what changed.
    """
    at = None
    for mine, other in zip(reversed(left), reversed(right), strict=True):
        both = []
        for level, as_name in ((mine, "mine"), (other, "other")):
            part = level.select(key, "range", F.col("digest").alias(as_name))
            if at is not None:
                above = F.substring("range", F.lit(1), F.length("range") - 1)
                part = part.withColumn("above", above).join(
                    at.withColumnRenamed("range", "above"), [key, "above"], "left_semi"
                ).drop("above")
            both.append(part)
        at = (
            both[0]
            .join(both[1], [key, "range"], "full_outer")
            .filter(~F.col("mine").eqNullSafe(F.col("other")))
            .select(key, "range")
        )
    return at


def changed_members(
    recorded: DataFrame, observed: DataFrame, key: str, name: str, facts: Sequence[str]
) -> DataFrame:
    """``(key, name, state)``: missing, extra and changed members, by descending two digest trees.

    Members are compared only in ranges whose digests differ.
    """
    trees = [digest_tree(side, key, name, facts, keep=True) for side in (recorded, observed)]
    at = differing_ranges(trees[0], trees[1], key)
    sides = []
    for side, as_name in ((recorded, "was"), (observed, "is")):
        ranged = side.withColumn("range", name_range(F.col(name)))
        inside = ranged.join(at, [key, "range"], "left_semi")
        sides.append(inside.select(key, name, F.struct(*facts).alias(as_name)))
    state = (
        F.when(F.col("is").isNull(), F.lit("missing"))
        .when(F.col("was").isNull(), F.lit("extra"))
        .when(~F.col("was").eqNullSafe(F.col("is")), F.lit("changed"))
    )
    both = sides[0].join(sides[1], [key, name], "full_outer")
    return both.withColumn("state", state).filter("state IS NOT NULL").select(key, name, "state")
