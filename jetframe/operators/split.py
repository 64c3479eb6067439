"""Hash splits, provenance joins, partition reports and disjointness checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jetframe.functions import identity
from jetframe.rules import as_text, broken_rules, repeated_keys, union_all
from jetframe.schema import ROLES, SPLITS

EVENT_KEY = ("record_id", "run", "lumi", "event")


def with_source(files: DataFrame) -> DataFrame:
    """Add ``pfn_sha256``, ``bucket`` and ``split``: what follows from the file alone."""
    hashed = files.withColumn("pfn_sha256", identity.file_hash(F.col("canonical_pfn")))
    return hashed.withColumn("bucket", identity.bucket10(F.col("pfn_sha256"))).select(
        "*", identity.split_of_bucket(F.col("bucket")).alias("split")
    )


def with_jet_id(jets: DataFrame) -> DataFrame:
    """Add ``jet_id`` to jets that have their file's hash."""
    return jets.select(
        "*",
        identity.stable_id(
            F.col("record_id"),
            F.col("pfn_sha256"),
            F.col("run"),
            F.col("lumi"),
            F.col("event"),
            F.col("jet_index"),
        ).alias("jet_id"),
    )


def with_identity(jets: DataFrame) -> DataFrame:
    """Add ``pfn_sha256``, ``bucket``, ``split`` and ``jet_id``."""
    return with_jet_id(with_source(jets))


def source_pair_gaps(jets: DataFrame, manifest: DataFrame) -> DataFrame:
    """Both directions of "observed sources equal the manifest".

    Jets are reduced to their distinct sources first, so the anti joins see one row
    per file however many jets a file holds.
    """
    pair = ["record_id", "canonical_pfn"]
    seen = jets.groupBy(*pair).agg(F.count(F.lit(1)).alias("n"))
    known = manifest.select(*pair)
    key = F.concat_ws(":", as_text(F.col("record_id")), F.col("canonical_pfn"))
    absent = seen.join(known, pair, "left_anti").select(
        F.lit("DATA_PROVENANCE_UNKNOWN_SOURCE").alias("rule"),
        key.alias("key"),
        F.concat(F.lit("jets="), F.col("n").cast("string")).alias("detail"),
    )
    unused = known.join(seen.select(*pair), pair, "left_anti").select(
        F.lit("DATA_PROVENANCE_NO_JETS").alias("rule"), key.alias("key"), F.lit("").alias("detail")
    )
    return union_all([absent, unused])


def source_rules(jets: DataFrame, manifest: DataFrame, roles: DataFrame) -> DataFrame:
    """Jet joined to its manifest row by file: record must agree, role fixes the class.

    The joins run on distinct (file, record, class) rows, not on jets.
    """
    seen = jets.groupBy("canonical_pfn", "record_id", "target").agg(F.count(F.lit(1)).alias("n"))
    source = manifest.select("canonical_pfn", F.col("record_id").alias("manifest_record"))
    joined = seen.join(source, "canonical_pfn", "left").join(
        roles.select("record_id", "role"), "record_id", "left"
    )
    key = F.concat_ws(":", as_text(F.col("record_id")), F.col("canonical_pfn"))
    return broken_rules(
        joined,
        key,
        {
            "SPLIT_SOURCE_IDENTITY": F.col("manifest_record").isNull()
            | (F.col("manifest_record") != F.col("record_id")),
            "SPLIT_TARGET_MISMATCH": F.col("role").isNotNull()
            & (F.col("target") != identity.class_of_role(F.col("role"))),
            "CONFIG_VALUE": ~F.coalesce(F.col("role").isin(*ROLES), F.lit(True)),
        },
    )


def partition_report(jets: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files, distinct events and jets by class for every split."""
    events = (
        jets.groupBy("split", *EVENT_KEY)
        .agg(
            F.count_if(F.col("target") == 0).alias("n0"),
            F.count_if(F.col("target") == 1).alias("n1"),
        )
        .groupBy("split")
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.sum("n0").alias("background_jets"),
            F.sum("n1").alias("signal_jets"),
        )
    )
    files = (
        manifest.select(identity.assign_split(F.col("canonical_pfn")).alias("split"))
        .groupBy("split")
        .agg(F.count(F.lit(1)).alias("file_count"))
    )
    names = jets.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(s) for s in SPLITS])).alias("split")
    )
    zero = F.lit(0).cast("bigint")
    return (
        names.join(files, "split", "left")
        .join(events, "split", "left")
        .select(
            "split",
            *[
                F.coalesce(F.col(c), zero).alias(c)
                for c in ("file_count", "event_count", "background_jets", "signal_jets")
            ],
        )
    )


def record_counts(jets: DataFrame, keys: Sequence[str] = ("split", "record_id")) -> DataFrame:
    return jets.groupBy(*keys).agg(F.count(F.lit(1)).alias("jets"))


def event_overlaps(jets: DataFrame) -> DataFrame:
    """Events found in more than one split; min and max combine before the shuffle."""
    return (
        jets.groupBy(*EVENT_KEY)
        .agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
        .filter(F.col("lo") != F.col("hi"))
        .select(
            F.lit("SPLIT_EVENT_OVERLAP").alias("rule"),
            F.concat_ws(":", *[as_text(F.col(c)) for c in EVENT_KEY]).alias("key"),
            F.concat_ws(",", "lo", "hi").alias("detail"),
        )
    )


def repeated_files(assignments: DataFrame) -> DataFrame:
    """A file may be assigned once only, even inside one split."""
    return repeated_keys(assignments, ["canonical_pfn"], "SPLIT_PFN_OVERLAP")


def repeated_ids(jets: DataFrame) -> DataFrame:
    return repeated_keys(jets, ["jet_id"], "SPLIT_IDENTITY_DUPLICATE")


def training_pool(jets: DataFrame, roles: DataFrame) -> DataFrame:
    """Rows that may enter subsets: train split, and background of active records only."""
    return (
        jets.filter(F.col("split") == "train")
        .join(roles.select("record_id", "role"), "record_id")
        .filter((F.col("target") == 1) | (F.col("role") == "qcd_active"))
    )


def set_difference(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Members of exactly one of two sets, with the side they are missing from."""
    a = left.select(*columns).distinct()
    b = right.select(*columns).distinct()
    return union_all(
        [
            a.join(b, list(columns), "left_anti").withColumn("missing_in", F.lit("right")),
            b.join(a, list(columns), "left_anti").withColumn("missing_in", F.lit("left")),
        ]
    )
