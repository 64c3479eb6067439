"""Stable identities, hash splits and seeded ranks, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text formats.
ID_PREFIX = "cms"
SHA256_FORMAT = "^[0-9a-f]{64}$"
CHECKSUM_FORMAT = "^[0-9a-fA-F]{8}$"
SLUG_FORMAT = "^[a-z0-9][a-z0-9._-]{2,127}$"
UTC_FORMAT = "Z$"
DOI_FORMAT = r"^10\.\d{4,9}/\S+$"


def file_hash(name: Column) -> Column:
    """SHA-256 of the exact UTF-8 bytes, lower hex."""
    return F.sha2(name, 256)


def bucket10(hex_digest: Column) -> Column:
    """The 256-bit digest modulo 10.

    A power 16^k, k >= 1, leaves 6 modulo 10, so the digest may be cut into pieces that
    fit a bigint: ``low + 6 * (sum of the others)``, and no big integer is needed.
    """
    cuts = ((1, 15), (16, 15), (31, 15), (46, 15), (61, 4))
    pieces = [
        F.conv(F.substring(hex_digest, at, n), 16, 10).cast("bigint") % F.lit(10) for at, n in cuts
    ]
    others = pieces[0] + pieces[1] + pieces[2] + pieces[3]
    return ((pieces[4] + F.lit(6) * others) % F.lit(10)).cast("int")


def split_of_bucket(bucket: Column) -> Column:
    return (
        F.when(bucket == 0, F.lit("test"))
        .when(bucket == 1, F.lit("validation"))
        .otherwise(F.lit("train"))
    )


def assign_split(name: Column) -> Column:
    return split_of_bucket(bucket10(file_hash(name)))


def stable_id(
    record_id: Column, hash_hex: Column, run: Column, lumi: Column, event: Column, index: Column
) -> Column:
    return F.concat_ws(
        ":",
        F.lit(ID_PREFIX),
        record_id.cast("string"),
        hash_hex,
        run.cast("string"),
        lumi.cast("string"),
        event.cast("string"),
        index.cast("string"),
    )


def coordinate_rules() -> dict[str, Column]:
    """Bad-row predicates for identity coordinates."""
    positive = {
        f"SPLIT_IDENTITY_VALUE:{name}": F.col(name).isNull() | (F.col(name) < 1)
        for name in ("record_id", "run", "lumi", "event")
    }
    index = F.col("jet_index")
    return {**positive, "SPLIT_IDENTITY_VALUE:jet_index": index.isNull() | (index < 0)}


def seeded_rank(seed: int | Column, identity: Column) -> Column:
    """SHA-256 of seed, NUL, id; its hex text sorts as the unsigned integer does."""
    text = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.sha2(F.concat(text, F.lit("\0"), identity), 256)


def class_of_role(role: Column) -> Column:
    return F.when(role == "signal", F.lit(1)).otherwise(F.lit(0)).cast("tinyint")


def named_split(file_name: Column) -> Column:
    """train > validation > test by the words in a file name; null when none occurs."""
    name = F.lower(file_name)
    return (
        F.when(name.contains("train"), F.lit("train"))
        .when(name.contains("val"), F.lit("validation"))
        .when(name.contains("test"), F.lit("test"))
    )
