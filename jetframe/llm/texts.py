"""Reading text columns batch by batch into numpy, in pieces of bounded size.

Null texts count as empty everywhere. A piece holds whole rows: at least one, and otherwise no more
than ``budget`` bytes of text, so the memory of a task follows the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jetframe.session import Shelf

PIECE_BYTES = 2 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(column, modulus: int):
    """crc32 of the number as text, modulo ``modulus``; null counts as the empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus


def pieces(
    batch: pa.RecordBatch, column: str = "text", budget: int = PIECE_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """(rows, their texts in UTF-8) for slices of the batch of at most ``budget`` bytes."""
    texts = batch.column(column).cast(pa.binary()).fill_null(b"")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if row > start and total + size > budget:
            yield batch.slice(start, row - start), texts.slice(start, row - start).to_pylist()
            start, total = row, 0
        total += size
    if len(texts) > start:
        yield batch.slice(start), texts.slice(start).to_pylist()


def joined(texts: list[bytes], sep: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, a separator after each, and the bounds of each (with it)."""
    data = np.frombuffer(sep.join(texts) + sep, dtype=np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + len(sep) for t in texts), np.int64, len(texts)))
    return data, np.concatenate([[0], ends])


def mix(values: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on unsigned 64-bit values."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def bounds_of(owners: np.ndarray, count: int) -> np.ndarray:
    """Start of each owner's run in an ascending array of owners, and the end of the last."""
    return np.searchsorted(owners, np.arange(count + 1))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, rows: int, shelf: Shelf
) -> DataFrame:
    """(key, label, text) of at most ``rows`` labelled ones of ``docs`` outside the held-out remainder.

    Labels of other documents take no place. First come the ids with the smallest hashes, at most ``rows``; then,
    as an id may stand on many rows, the rows with the smallest hash of id and text, their ``key``: the same
    at every run and for any partitioning. Rows equal in id and text count once; an id labelled
    twice has its largest label. The table is on the ``shelf``.
    """
    chosen = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .filter(remainder("doc_id", modulus) != held)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    keyed = found.select(F.xxhash64("doc_id", "text").alias("key"), "label", "text")
    single = shelf.put(
        keyed.groupBy("key").agg(F.first("label").alias("label"), F.first("text").alias("text"))
    )
    first = single.select("key").orderBy("key").limit(rows)
    return shelf.put(single.join(F.broadcast(first), "key", "left_semi"), single)


SEPARATORS = np.zeros(256, dtype=bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
_STEP = np.uint64(0xD1342543DE82EF95)


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, 64-bit hash) of every run of bytes that are no separators.

    The hash is a polynomial over random byte values with 64-bit overflow, mixed with the length.
    """
    inside = ~SEPARATORS[data]
    edges = np.diff(np.concatenate([[False], inside, [False]]).view(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    lengths = ends - starts
    if not len(starts):
        return starts, lengths, np.zeros(0, np.uint64)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    powers = np.multiply.accumulate(
        np.concatenate([[np.uint64(1)], np.full(int(lengths.max()), _STEP)]).astype(np.uint64)
    )
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    terms = _BYTE_VALUES[data[inside]] * powers[place]
    return starts, lengths, mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64) * GOLDEN)


_GRAM_STEPS = mix(np.arange(1001, 1101, dtype=np.uint64)) | np.uint64(1)


def word_grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` words in a row."""
    count = max(0, len(hashes) - size + 1)
    total = np.full(count, size, dtype=np.uint64) * GOLDEN
    for k in range(size):
        total += mix(hashes[k : k + count] + _GRAM_STEPS[k]) * _GRAM_STEPS[k]
    return mix(total)
