"""Scans of text tables: command lines, links, corpora of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jetframe.functions import text
from jetframe.functions.identity import DOI_FORMAT
from jetframe.rules import broken_rules, repeated_keys, union_all

# Commands, flags and forbidden fragments.
COMMANDS = ("dataloader", "train", "evaluate")
SWITCHES = ("--use-add", "--use-pid")
VALUE_FLAGS = (
    "--revision",
    "--data-path",
    "--output-dir",
    "--feature-config",
    "--model-size",
    "--train-size-per-class",
    "--model-seed",
    "--checkpoint",
    "--num-add",
    "--pid_idx",
)
FORBIDDEN_PARTS = ("conditional", "global", "cond_", "use-cond", "use-global")


def command_violations(commands: DataFrame, key: str, argv: str, revision: str) -> DataFrame:
    """Rules for logged command lines, an array of arguments per row.

    Whether an argument is a flag or the value of the flag before it depends on all
    arguments before it, so one fold over the (short) array marks flags and values.
    """
    rest = F.slice(argv, F.lit(3), F.greatest(F.size(argv) - 2, F.lit(0)))
    takes_value = F.aggregate(
        rest,
        F.struct(F.lit(False).alias("open"), F.array().cast("array<string>").alias("flags")),
        lambda acc, arg: F.when(
            acc["open"], F.struct(F.lit(False).alias("open"), acc["flags"].alias("flags"))
        ).otherwise(
            F.struct(
                arg.isin(*VALUE_FLAGS).alias("open"),
                F.concat(acc["flags"], F.array(arg)).alias("flags"),
            )
        ),
    )
    marked = commands.select(F.col(key), F.col(argv).alias("argv"), takes_value.alias("s"))
    flags = F.col("s.flags")
    forbidden = F.exists(
        flags, lambda a: F.lower(a).rlike("|".join(FORBIDDEN_PARTS)) & a.startswith("--")
    )
    known = (*SWITCHES, *VALUE_FLAGS)
    count = F.size(F.filter("argv", lambda a: a == "--revision"))
    at = F.array_position("argv", F.lit("--revision"))
    pinned = F.get(F.col("argv"), at.cast("int"))
    return broken_rules(
        marked,
        F.col(key),
        {
            "RUN_ARGV_TYPE": (F.size("argv") < 2) | F.exists("argv", lambda a: F.coalesce(a, F.lit("")) == ""),
            "RUN_COMMAND_NOT_ALLOWED": ~F.get(F.col("argv"), F.lit(1)).isin(*COMMANDS),
            "RUN_ARGUMENT_INVALID": F.col("s.open")
            | F.exists(flags, lambda a: ~a.startswith("--"))
            | F.exists(rest_of("argv"), lambda a: a.rlike(r"[\r\n\x00]")),
            "RUN_FLAG_FORBIDDEN": forbidden,
            "RUN_FLAG_NOT_ALLOWED": F.exists(
                flags,
                lambda a: a.startswith("--")
                & ~a.isin(*known)
                & ~F.lower(a).rlike("|".join(FORBIDDEN_PARTS)),
            ),
            "RUN_REVISION_REQUIRED": count != 1,
            "RUN_REVISION_MISMATCH": (count == 1) & ~pinned.eqNullSafe(F.lit(revision)),
        },
    )


def rest_of(argv: str):
    return F.slice(argv, F.lit(3), F.greatest(F.size(argv) - 2, F.lit(0)))


def references(df: DataFrame, key: str, column: str, pattern: str) -> DataFrame:
    """``(key, target, n)``: local link targets with their number of uses per row."""
    raw = F.explode(text.link_targets(F.col(column), pattern)).alias("raw")
    return (
        df.select(key, raw)
        .select(key, text.local_target(F.col("raw")).alias("target"))
        .filter("target <> ''")
        .groupBy(key, "target")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def dangling(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """References whose target is not in the catalog."""
    return refs.join(catalog.select("target").distinct(), "target", "left_anti")


def corpus_violations(
    sources: DataFrame,
    key: str,
    unique: Sequence[str],
    required: Sequence[str],
    folded: Sequence[str] = (),
) -> DataFrame:
    """Repeated keys, case-folded titles and DOIs; blank required values; bad DOIs; unverified."""
    rows = sources.withColumns({c: F.lower(F.col(c)) for c in folded})
    repeats = [
        repeated_keys(rows.filter(F.coalesce(F.col(c), F.lit("")) != ""), [c], f"CORPUS_REPEATED:{c}")
        for c in unique
    ]
    blank = {
        f"CORPUS_BLANK:{c}": F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
        for c in required
    }
    doi = F.coalesce(F.col("doi"), F.lit(""))
    return union_all(
        [
            broken_rules(
                rows,
                F.col(key),
                {
                    **blank,
                    "CORPUS_DOI": (doi != "") & ~doi.rlike(DOI_FORMAT),
                    "CORPUS_UNVERIFIED": ~F.col("verification_status").eqNullSafe(F.lit("verified")),
                },
            ),
            *repeats,
        ]
    )


def uncovered(sources: DataFrame, column: str, wanted: Sequence[str]) -> DataFrame:
    """Groups of a fixed list that no source belongs to, and groups outside the list."""
    names = F.array(*[F.lit(w) for w in wanted])
    seen = sources.groupBy(column).agg(F.count(F.lit(1)).alias("n")).agg(
        F.collect_set(F.when(F.col(column).isin(*wanted), F.col(column))).alias("have"),
        F.count_if(~F.coalesce(F.col(column).isin(*wanted), F.lit(False))).alias("other"),
    )
    return seen.select(
        F.array_join(F.array_sort(F.array_except(names, "have")), ",").alias("absent"), "other"
    )
