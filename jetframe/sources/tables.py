"""Readers and writers of jets, canonical rows, predictions, inventories and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jetframe.functions import identity
from jetframe.operators import canonical, contracts, digest
from jetframe.rules import RuleViolation, broken_rules
from jetframe.schema import INVENTORY, JETS, PARALLEL_JETS, PREDICTIONS

FORMAT_VERSION = "1.0.0"


def require_columns(df: DataFrame, schema: T.StructType) -> None:
    """Missing and unknown columns fail at once: schemas are closed."""
    have, want = set(df.columns), set(schema.names)
    if have != want:
        raise RuleViolation(
            [
                ("DATA_SCHEMA", name, "missing" if name in want else "unknown")
                for name in sorted(have ^ want)
            ]
        )


def read_jets(spark: SparkSession, paths: Sequence[str], parallel: bool = False) -> DataFrame:
    """Nested jets from one or more Parquet paths, or jets with eleven parallel arrays.

    The stored columns are compared with the closed schema from the file footers; the
    read itself uses the explicit schema, so nested pruning and pushdown apply.
    """
    if not paths:
        raise ValueError("at least one input path is required")
    schema = PARALLEL_JETS if parallel else JETS
    require_columns(spark.read.parquet(*paths), schema)
    jets = spark.read.schema(schema).parquet(*paths)
    return canonical.zip_parallel(jets) if parallel else jets


def write_canonical(
    rows: DataFrame, path: str, feature_version: str, manifest_sha256: str, partitions: int | None = None
) -> DataFrame:
    """Partitioned canonical table at ``path/data`` and its one-row description.

    Rows are written where they are; ``partitions`` may bring many small tasks together.  The write observes
    the digest of its rows, so nothing is read again for the description.
    """
    if "split" not in rows.columns:
        raise ValueError("canonical rows need a split column")
    out = rows.coalesce(partitions) if partitions else rows
    observed = digest.ObservedDigest()
    watched = observed.watch(out, out.columns)
    watched.write.partitionBy("split").option("compression", "zstd").parquet(f"{path}/data")
    count, sha256 = observed.result()
    spark = rows.sparkSession
    about = spark.createDataFrame(
        [(FORMAT_VERSION, feature_version, manifest_sha256, digest.CANONICALIZATION, count, sha256)],
        "schema_version string, feature_version string, source_manifest_sha256 string, digest_rule string, "
        "rows bigint, content_sha256 string",
    )
    about.coalesce(1).write.json(f"{path}/about")
    return spark.read.parquet(f"{path}/data")


def verify_canonical(spark: SparkSession, path: str) -> DataFrame:
    """Stored and recomputed digest side by side, one row."""
    stored = spark.read.parquet(f"{path}/data")
    now = digest.content_digest(stored, stored.columns).select(
        F.col("rows").alias("rows_now"), F.col("digest").alias("digest_now")
    )
    about = spark.read.schema("rows bigint, content_sha256 string").json(f"{path}/about")
    return about.select(
        "content_sha256",
        now.select("digest_now").scalar().alias("digest_now"),
        (F.col("content_sha256") == now.select("digest_now").scalar()).alias("valid"),
    )


def write_ordered(rows: DataFrame, path: str, pos: str, partitions: int) -> None:
    """Rows in the order of ``pos`` over ``partitions`` files at ``path/data``, and where each file starts.

    Rows are dealt out by ranges of the position, so that file after file, line after line, is the order.
    ``path/offsets`` has ``(file, first, last, rows)``.
    """
    dealt = rows.repartitionByRange(partitions, pos).sortWithinPartitions(pos)
    dealt.write.parquet(f"{path}/data")
    stored = rows.sparkSession.read.parquet(f"{path}/data")
    offsets = stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.min(pos).alias("first"), F.max(pos).alias("last"), F.count("*").alias("rows")
    )
    offsets.coalesce(1).write.json(f"{path}/offsets")


def read_in_files(spark: SparkSession, path: str) -> DataFrame:
    """All rows with ``file`` and ``line``, their 0-based place in it, as they are stored."""
    found = spark.read.parquet(f"{path}/data")
    at = found.select(
        "*",
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    first = at.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    earlier = Window.partitionBy("file").orderBy("block")
    starts = first.withColumn("before", F.sum("held").over(earlier) - F.col("held"))
    placed = at.join(starts.drop("held"), ["file", "block"])
    return placed.withColumn("line", F.col("at") - F.col("first") + F.col("before")).drop(
        "at", "first", "before", "block"
    )


def order_violations(spark: SparkSession, path: str, pos: str) -> DataFrame:
    """Rows out of their place: inside a file, and between files by their offsets.

    Positions are 0-based and dense, so the row at line n of a file has its first position plus n, and a
    file starts where the one before it ends.
    """
    offsets = spark.read.schema("file string, first bigint, last bigint, rows bigint").json(f"{path}/offsets")
    inside = (
        read_in_files(spark, path)
        .select("file", "line", F.col(pos).cast("bigint").alias("pos"))
        .join(offsets, "file", "left")
        .filter(F.col("first").isNull() | (F.col("pos") != F.col("first") + F.col("line")))
        .select(
            F.lit("ORDER_POSITION").alias("rule"),
            F.concat_ws(":", "file", F.col("line").cast("string")).alias("key"),
            F.concat(F.lit("pos="), F.col("pos").cast("string")).alias("detail"),
        )
    )
    by_first = Window.orderBy("first")
    between = offsets.withColumn("expected", F.coalesce(F.lag("last").over(by_first) + 1, F.lit(0))).filter(
        (F.col("expected") != F.col("first")) | (F.col("last") - F.col("first") + 1 != F.col("rows"))
    )
    return inside.union(
        between.select(
            F.lit("ORDER_OFFSET").alias("rule"),
            F.col("file").alias("key"),
            F.concat(F.lit("first="), F.col("first").cast("string")).alias("detail"),
        )
    )


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Identity inventories, one JSON document per file, as rows of jets.

    Jets keep their position in the document; documents of any number are read in parallel.
    """
    docs = spark.read.schema(INVENTORY).option("multiLine", True).json(path)
    return inventory_rows(docs.withColumn("source", F.input_file_name()))


def inventory_rows(docs: DataFrame) -> DataFrame:
    """One row per jet; a document without jets has one row without a position."""
    return docs.select(
        "source",
        "schema_version",
        F.col("canonical_dataset").alias("dataset"),
        F.posexplode_outer("jets").alias("pos", "jet"),
    ).select("source", "schema_version", "dataset", "pos", "jet.*")


def inventory_violations(rows: DataFrame) -> DataFrame:
    """Per-jet and per-document rules; fields that do not parse are null."""
    d = F.col("dataset")
    held = F.col("pos").isNotNull()
    per_jet = {
        "CONTRACT_VALUE:canonical_pfn": F.coalesce(F.col("canonical_pfn"), F.lit("")) == "",
        "CONTRACT_VALUE:target": ~F.coalesce(F.col("target").isin(0, 1), F.lit(False)),
        **identity.coordinate_rules(),
    }
    return broken_rules(
        rows,
        F.concat_ws(":", "source", F.coalesce(F.col("pos").cast("string"), F.lit("-"))),
        {
            "CONTRACT_UNSUPPORTED_MAJOR": ~F.col("schema_version").eqNullSafe(F.lit(FORMAT_VERSION)),
            "CONTRACT_VALUE:canonical_dataset": F.coalesce(d["path"], F.lit("")).eqNullSafe(F.lit(""))
            | ~F.coalesce(d["sha256"].rlike(identity.SHA256_FORMAT), F.lit(False))
            | F.coalesce(d["byte_size"] < 0, F.lit(True)),
            "CONTRACT_EMPTY:jets": ~held,
            **{rule: held & bad for rule, bad in per_jet.items()},
        },
    )


# The keys of an identity inventory and of its jets.
INVENTORY_FIELDS = {
    "schema_version": contracts.Text(allowed=("1.0.0",)),
    "canonical_dataset": contracts.Object(
        {
            "path": contracts.ANY,
            "sha256": contracts.SHA,
            "byte_size": contracts.Integer(0),
        }
    ),
    "jets": contracts.Free("ARRAY"),
}
INVENTORY_JET = {
    "record_id": contracts.Integer(1),
    "canonical_pfn": contracts.ANY,
    "run": contracts.Integer(1),
    "lumi": contracts.Integer(1),
    "event": contracts.Integer(1),
    "jet_index": contracts.Integer(0),
    "target": contracts.Integer(0, 1),
}


def read_inventory_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``(source, v)``: inventories as they are written, one per file, or one per line with ``lines``."""
    reader = spark.read.option("singleVariantColumn", "v").option("multiLine", not lines)
    return reader.json(path).select(F.col("_metadata.file_path").alias("source"), "v")


def inventory_contract(documents: DataFrame) -> DataFrame:
    """Exact keys and types of inventories ``(source, v)``: unknown and missing keys, booleans, decimals and
    texts in place of whole numbers, values out of range; per document and per jet (``source:position``)."""
    v = F.col("v")
    jets = F.try_variant_get(v, "$.jets", "array<variant>")
    empty = {"CONTRACT_EMPTY:jets": F.size(jets) == 0}
    whole = contracts.variant_violations(documents.select(F.col("source").alias("key"), "v"), INVENTORY_FIELDS, empty)
    each = documents.select("source", F.posexplode(jets).alias("pos", "v")).select(
        F.concat_ws(":", "source", F.col("pos").cast("string")).alias("key"), "v"
    )
    return whole.unionByName(contracts.variant_violations(each, INVENTORY_JET))


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Scores stored as float, like the published payload; partitioned by run."""
    stored = predictions.select(
        "run_id", "pos", "jet_id", F.col("target").cast("tinyint"), F.col("score").cast("float")
    )
    stored.write.partitionBy("run_id").parquet(f"{path}/payload")
    spark = predictions.sparkSession
    about = prediction_metadata(read_predictions(spark, path))
    about.write.json(f"{path}/about")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.parquet(f"{path}/payload")
    require_columns(found, PREDICTIONS)
    return found.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in PREDICTIONS.fields]
    )


def prediction_metadata(predictions: DataFrame) -> DataFrame:
    """Rows, class counts and the digest of the ordered ids per run, in one pass."""
    classes = {"background_count": F.col("target") == 0, "signal_count": F.col("target") == 1}
    made = digest.content_digest(predictions, ["jet_id", "pos"], ["run_id"], classes)
    return made.select(
        "run_id", F.col("rows").alias("row_count"), *classes, F.col("digest").alias("row_order_digest")
    )


def metadata_violations(predictions: DataFrame, metadata: DataFrame) -> DataFrame:
    """Stored metadata against what the payload holds now."""
    now = prediction_metadata(predictions)
    names = [c for c in now.columns if c != "run_id"]
    joined = now.join(
        metadata.select("run_id", *[F.col(c).alias(f"m_{c}") for c in names]), "run_id", "full_outer"
    )
    return broken_rules(
        joined,
        F.col("run_id"),
        {f"PREDICTION_METADATA:{c}": ~F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in names},
    )


def expected_order_violations(predictions: DataFrame, expected: DataFrame) -> DataFrame:
    """Runs whose ids are not the expected ids in the expected order; ``expected`` has (jet_id, pos).

    The two sequences meet as one digest each; a run with another number of rows is named as such.
    """
    want = digest.order_digest(expected, "jet_id", "pos").select(
        F.col("rows").alias("want_rows"), F.col("order_digest").alias("want")
    )
    only = want.agg(F.struct(F.first("want_rows").alias("rows"), F.first("want").alias("digest"))).scalar()
    have = digest.order_digest(predictions, "jet_id", "pos", ["run_id"])
    return broken_rules(
        have,
        F.col("run_id"),
        {
            "PREDICTION_ROW_COUNT": ~F.col("rows").eqNullSafe(only["rows"]),
            "PREDICTION_ROW_ORDER": ~F.col("order_digest").eqNullSafe(only["digest"]),
        },
    )


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """Every result table of a report as JSON rows under its own name."""
    for name, table in sections.items():
        table.write.json(f"{path}/{name}")
