"""File inventories: discovery, hashing, verification and provenance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import partial
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jetframe.functions import sha256
from jetframe.operators import digest
from jetframe.rules import broken_rules
from jetframe.session import Shelf

# Data suffixes and mutable revision names.
DATA_SUFFIXES = ("h5", "hdf5", "hdf")
MUTABLE_REVISIONS = ("latest", "main", "master", "pretrain_s")

# Bytes of a file that is one value, of one that can be, of a task's range of a longer one, and of a read.
ROW_LIMIT = 1 << 28
VALUE_LIMIT = 1 << 30
SPAN = 1 << 28
BLOCK = 1 << 20

TURN = "path string, length bigint, at bigint, state binary, sha256 string"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length, modificationTime)`` below ``root``; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.select("path", "length", "modificationTime")


def discover(
    files: DataFrame, suffixes: Sequence[str] = DATA_SUFFIXES, excluded: Sequence[str] = ()
) -> DataFrame:
    """Files with a data suffix outside the excluded folders."""
    pattern = r"\.(" + "|".join(suffixes) + ")$"
    out = files.filter(F.lower("path").rlike(pattern))
    for folder in excluded:
        out = out.filter(~F.col("path").startswith(folder.rstrip("/") + "/"))
    return out


def relative(path: Column, root: str) -> Column:
    """Path below ``root`` whatever the URI scheme is written like."""
    at = F.position(F.lit(root.rstrip("/") + "/"), path)
    return F.substring(path, at + len(root.rstrip("/")) + 1, F.length(path))


def file_inventory(
    spark: SparkSession, root: str, row_limit: int = ROW_LIMIT, span: int = SPAN
) -> DataFrame:
    """``(path, sha256, byte_size)`` with paths relative to ``root``.

    Files up to ``row_limit`` bytes are hashed as one binary value; longer ones by one task after
    another, each of which reads ``span`` bytes. Where Python cannot open the file system of the longer
    ones, files that fit a row are values as well.
    """
    if span <= 0 or span % sha256.BLOCK:
        raise ValueError(f"span must be a positive multiple of {sha256.BLOCK}")
    source = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    some = source.filter(F.col("length") > row_limit).agg(F.max("path")).first()[0]
    if some is not None and not _opens(some):
        row_limit = max(row_limit, VALUE_LIMIT)
    out = source.filter(F.col("length") <= row_limit).select(
        "path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("byte_size")
    )
    if some is not None:
        out = out.unionByName(_hash_in_turn(spark, source.filter(F.col("length") > row_limit), span))
    return out.withColumn("path", relative(F.col("path"), root))


def _hash_in_turn(spark: SparkSession, files: DataFrame, span: int) -> DataFrame:
    """``(path, sha256, byte_size)``, a round per range: a file's SHA-256 is one chain, its reading is not."""
    shelf = Shelf(spark)
    turn = shelf.put(
        files.select(
            "path",
            "length",
            F.lit(0).cast("bigint").alias("at"),
            F.lit(None).cast("binary").alias("state"),
            F.lit(None).cast("string").alias("sha256"),
        )
    )
    while left := turn.filter("sha256 IS NULL").count():
        turn = shelf.put(next_turn(turn, left, span), turn)
    shelf.close(turn)
    return turn.select("path", "sha256", F.col("length").alias("byte_size"))


def next_turn(turn: DataFrame, left: int, span: int) -> DataFrame:
    """``(path, length, at, state, sha256)`` after ``span`` more bytes of the ``left`` unfinished files, a task each."""
    unfinished = turn.filter("sha256 IS NULL").repartitionByRange(left, "path")
    read = unfinished.mapInPandas(partial(_hash_range, span=span), TURN)
    return turn.filter("sha256 IS NOT NULL").unionByName(read)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(quote(path, safe="/:@"))


def _opens(path: str) -> bool:
    try:
        _open(path)
    except (OSError, ValueError, NotImplementedError):
        return False
    return True


def _hash_range(batches: Iterator[pd.DataFrame], span: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        given = zip(batch["path"], batch["length"], batch["at"], batch["state"])
        rows = [(path, length, *_hash_on(path, length, at, state, span)) for path, length, at, state in given]
        yield pd.DataFrame(rows, columns=batch.columns)


def _hash_on(path: str, length: int, at: int, state: bytes | None, span: int) -> tuple[int, bytes | None, str | None]:
    """``(at, state, sha256)`` after the range from ``at``; without OpenSSL's states, after the whole file."""
    library = sha256.library()
    if library:
        chain, end = sha256.Chain(library, state, at), min(length, at + span)
    else:
        chain, at, end = hashlib.sha256(), 0, length
    system, name = _open(path)
    with system.open_input_file(name) as file:
        file.seek(at)
        while at < end:
            block = file.read(min(BLOCK, end - at))
            if not block:
                raise EOFError(f"{path} ends at byte {at}, not at {length}")
            chain.update(block)
            at += len(block)
    return (at, None, chain.hexdigest()) if at == length else (at, chain.state(), None)


def inventory_differences(recorded: DataFrame, observed: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Missing, extra and changed files of two inventories."""
    a = recorded.select(*keys, F.col("sha256").alias("a_sha"), F.col("byte_size").alias("a_size"))
    b = observed.select(*keys, F.col("sha256").alias("b_sha"), F.col("byte_size").alias("b_size"))
    state = (
        F.when(F.col("b_sha").isNull(), F.lit("missing"))
        .when(F.col("a_sha").isNull(), F.lit("extra"))
        .when((F.col("a_sha") != F.col("b_sha")) | (F.col("a_size") != F.col("b_size")), F.lit("changed"))
    )
    return (
        a.join(b, list(keys), "full_outer")
        .withColumn("state", state)
        .filter("state IS NOT NULL")
        .select(*keys, "state")
    )


RECORD = ["sha256", "byte_size"]


def completion_markers(files: DataFrame, request: DataFrame) -> DataFrame:
    """``(artifact, members, artifact_sha256, input_hashes, config_sha256)``: what a finished artifact records.

    ``request`` has the hashes of the inputs, as a map by name, and of the configuration, per artifact.
    """
    root = digest.digest_tree(files, "artifact", "path", RECORD)[-1]
    return root.select("artifact", "members", F.col("digest").alias("artifact_sha256")).join(
        request.select("artifact", "input_hashes", "config_sha256"), "artifact", "left"
    )


def artifact_violations(markers: DataFrame, observed: DataFrame, request: DataFrame) -> DataFrame:
    """Completion markers against the files there are now and against what is asked for now.

    A marker of no files, files without a marker, inputs or a configuration other than the recorded
    ones, and a digest over the sorted records that is not the recorded one.
    """
    now = digest.digest_tree(observed, "artifact", "path", RECORD)[-1]
    now = now.select("artifact", F.col("digest").alias("now"))
    asked = request.select(
        "artifact",
        F.map_entries("input_hashes").alias("asked_inputs"),
        F.col("config_sha256").alias("asked_config"),
    )
    had = markers.select(
        "artifact",
        "artifact_sha256",
        F.map_entries("input_hashes").alias("inputs"),
        F.col("config_sha256").alias("config"),
        F.lit(True).alias("marked"),
    )
    joined = had.join(now, "artifact", "full_outer").join(asked, "artifact", "left")
    marked = F.coalesce("marked", F.lit(False))
    same_request = F.array_sort("inputs").eqNullSafe(F.array_sort("asked_inputs")) & F.col(
        "config"
    ).eqNullSafe(F.col("asked_config"))
    return broken_rules(
        joined,
        F.col("artifact"),
        {
            "ARTIFACT_INCOMPLETE": ~marked,
            "ARTIFACT_EMPTY": marked & F.col("now").isNull(),
            "ARTIFACT_RESUME_MISMATCH": marked & ~same_request,
            "ARTIFACT_HASH_MISMATCH": marked & (F.col("now") != F.col("artifact_sha256")),
        },
    )


def provenance_violations(
    metadata: DataFrame, observed: DataFrame, required: Sequence[str], key: str = "artifact"
) -> DataFrame:
    """Metadata rows of published files against the files' observed names and digests."""
    seen = observed.select(
        key, F.col("filename").alias("seen_name"), F.col("sha256").alias("seen_sha")
    )
    joined = metadata.join(seen, key, "left")
    blank = F.lit(False)
    for name in required:
        blank = blank | (F.trim(F.coalesce(F.col(name), F.lit(""))) == "")
    return broken_rules(
        joined,
        F.col(key),
        {
            "CHECKPOINT_METADATA_MISSING": blank,
            "CHECKPOINT_MUTABLE_ID": F.col("immutable_revision").isin(*MUTABLE_REVISIONS),
            "CHECKPOINT_MISSING": F.col("seen_name").isNull(),
            "CHECKPOINT_FILENAME": F.col("seen_name") != F.col("filename"),
            "CHECKPOINT_HASH": F.col("seen_sha") != F.col("sha256"),
        },
    )


def index_violations(
    records: DataFrame, observed: DataFrame, revision: str, key: str = "artifact"
) -> DataFrame:
    """Completion records of published indexes against payload digests and view facts.

    ``observed`` has ``payload_digest, view_sha256, view_rows`` per index.
    """
    joined = records.join(
        observed.select(
            key,
            F.col("payload_digest").alias("o_digest"),
            F.col("view_sha256").alias("o_view"),
            F.col("view_rows").alias("o_rows"),
        ),
        key,
        "left",
    )
    return broken_rules(
        joined,
        F.col(key),
        {
            "INDEX_REVISION_MISMATCH": ~F.col("dependency_revision").eqNullSafe(F.lit(revision)),
            "INDEX_STALE_VIEW": ~F.col("source_view_sha256").eqNullSafe(F.col("o_view")),
            "INDEX_ROW_COUNT": ~F.col("row_count").eqNullSafe(F.col("o_rows")),
            "INDEX_PAYLOAD_HASH": ~F.col("payload_sha256").eqNullSafe(F.col("o_digest")),
            "INDEX_SMOKE_REQUIRED": ~F.coalesce(F.col("official_smoke_loaded"), F.lit(False)),
        },
    )
