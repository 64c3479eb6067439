"""SimHash fingerprints and their near duplicates, by the generalised pigeonhole principle.

Words are runs of bytes other than space and tab to carriage return, A-Z lower-cased; a text's shingles
are its three-word sequences, repeats included, joined by a space (fewer words: the whole sequence as one).
A bit of the fingerprint is set if more than half of the shingles' XXH64 values (seed 42) have it set; without
words, or without a text, the fingerprint is zero and links like any other. Fingerprints link at two or
fewer differing bits. Rows get the smallest doc_id they reach by links.

1. *Partitions.* Agreement of every two bits is counted over all distinct fingerprints (a 64 x 64 table,
   added up from one per task). Correlated bits are grouped, so that what is common to many
   fingerprints falls into as few partitions as possible. How many partitions there are follows from
   the estimated cost of probing.
2. *Thresholds.* Partition i gets a threshold t(i) >= -1 with sum of (t(i) + 1) = 3; then every fingerprint within
   two bits differs in at most t(i) bits of some partition i. Each fingerprint has its own thresholds,
   from a dynamic program over the partitions: the members of its own cells are counted exactly, those of
   the cells one bit away are estimated by the mean cell. The whole fingerprint as one partition with
   threshold 2 is a choice too; it costs 65 probes, whatever the data.
3. *Probe.* A threshold of 0 looks up one cell of the partition, 1 also the cells one bit away, -1 none. All
   fingerprints stand in the cells of all partitions, so it is enough that one of two linked ones probes.
   By the choice made no probed cell holds more than ``CELL`` members, where the estimate
   fails the fingerprint takes the whole as its partition. Those that do meet one another in the
   words one bit away from them: of the at most 65 fingerprints that share such a word all differ by at
   most two bits, so they are linked to the smallest of them, not in pairs.
4. *Verify.* Candidates are compared bit by bit.

So work is at most 65 candidates or probes per distinct fingerprint, also in a group of near copies that
holds a third of the table, and nothing is left out. Copies are one fingerprint from the start.

Null doc_ids keep their row and take part, but name no component (null where a component has no other);
repeated rows are repeated in the result; an empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from jetframe.llm.components import connected_components
from jetframe.llm.texts import LOWER, pieces
from jetframe.session import Shelf, lean_shuffles

SHINGLE = 3
SEED = 42
RADIUS = 2
WHOLE = 65
CELL = 65
CHUNK_WORDS = 1 << 16
LOWER_BYTES = LOWER.tobytes()


def shingle_bits(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """How many shingles have each of the 64 bits set, and last how many shingles there are."""
    found = text.translate(LOWER_BYTES).split()
    total = np.zeros(65, dtype=np.int64)
    if not found:
        return total
    size = min(size, len(found))
    for start in range(0, len(found) - size + 1, CHUNK_WORDS):
        part = found[start : start + CHUNK_WORDS + size - 1]
        shingles = list(map(b" ".join, zip(*(part[k:] for k in range(size)))))
        hashes = np.fromiter(
            map(xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=len(shingles)
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total[:64] += bits.sum(axis=0, dtype=np.int64)
        total[64] += len(shingles)
    return total


def fingerprint(text: bytes) -> int:
    """The fingerprint as a signed number."""
    total = shingle_bits(text)
    ones = 2 * total[:64] > total[64]
    return int(np.packbits(ones, bitorder="little").view("<i8")[0])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in pieces(batch):
            prints = pa.array([fingerprint(t) for t in texts], pa.int64())
            yield pa.record_batch([rows.column("doc_id"), prints], names=["doc_id", "fp"])


def bit_counts(prints: DataFrame) -> np.ndarray:
    """(64, 64): in how many of the fingerprints both bits are set. One small table per task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64), dtype=np.int64)
        for batch in batches:
            values = batch.column("fp").to_numpy().astype("<i8")
            for start in range(0, len(values), 1 << 16):
                some = np.ascontiguousarray(values[start : start + (1 << 16)])
                bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                total += (bits.T.astype(np.float32) @ bits.astype(np.float32)).astype(np.int64)
        if total.any():
            yield pa.record_batch(
                [pa.array(np.arange(4096), pa.int64()), pa.array(total.ravel())], names=["at", "n"]
            )

    table = np.zeros(4096, dtype=np.int64)
    summed = prints.select("fp").mapInArrow(count, "at bigint, n bigint").groupBy("at").sum("n")
    for at, n in summed.collect():
        table[at] = n
    return table.reshape(64, 64)


def correlations(both: np.ndarray, rows: int) -> np.ndarray:
    """Absolute correlation of every two bits; 0 where a bit is constant."""
    share = both.diagonal() / max(rows, 1)
    spread = np.sqrt(share * (1 - share))
    scale = np.outer(spread, spread)
    moved = both / max(rows, 1) - np.outer(share, share)
    return np.abs(np.divide(moved, scale, out=np.zeros_like(moved), where=scale > 0))


def group_bits(near: np.ndarray, groups: int) -> list[list[int]]:
    """Partitions of nearly equal width: each grows by the bit most correlated with those it has."""
    left = list(range(64))
    found = []
    for number in range(groups, 0, -1):
        width = math.ceil(len(left) / number)
        total = near[np.ix_(left, left)].sum(axis=1)
        group = [left[int(total.argmax())]]
        while len(group) < width:
            rest = [b for b in left if b not in group]
            group.append(rest[int(near[np.ix_(rest, group)].sum(axis=1).argmax())])
        left = [b for b in left if b not in group]
        found.append(sorted(group))
    return found


def mean_cells(groups: list[list[int]], both: np.ndarray, rows: int) -> np.ndarray:
    """Estimated members of a fingerprint's cell in each partition, itself included."""
    share = both.diagonal() / max(rows, 1)
    agree = share**2 + (1 - share) ** 2
    return np.array([1 + (rows - 1) * np.prod(agree[g]) for g in groups])


def thresholds(members: np.ndarray, widths: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds (n, m) of least estimated cost, and that cost; ``members`` (n, m) of the own cells.

    Dynamic program over the partitions; its state is how much of 3 has been spent on t(i) + 1.
    """
    rows, parts = members.shape
    units = RADIUS + 1
    best = np.full((rows, units + 1), np.inf)
    best[:, 0] = 0
    chosen = np.zeros((parts, rows, units + 1), dtype=np.int8)
    for part in range(parts):
        exact = 1 + members[:, part]
        prices = (0 * exact, exact, exact + widths[part] * (1 + mean[part]))
        following = best.copy()
        for spent in range(1, len(prices)):
            price = best[:, : units + 1 - spent] + prices[spent][:, None]
            better = price < following[:, spent:]
            following[:, spent:] = np.where(better, price, following[:, spent:])
            chosen[part][:, spent:] = np.where(better, spent, chosen[part][:, spent:])
        best = following
    result = np.zeros((rows, parts), dtype=np.int8)
    at = np.full(rows, units)
    for part in range(parts - 1, -1, -1):
        result[:, part] = chosen[part][np.arange(rows), at]
        at = at - result[:, part]
    return result - 1, best[:, units]


def partitions(both: np.ndarray, rows: int) -> tuple[list[list[int]], np.ndarray]:
    """Bit groups and their mean cells for the number of partitions that is estimated cheapest."""
    near = correlations(both, rows)
    options = []
    for number in (2, 3, 4):
        groups = group_bits(near, number)
        mean = mean_cells(groups, both, rows)
        widths = np.array([len(g) for g in groups])
        options.append((float(thresholds(mean[None, :], widths, mean)[1][0]), number, groups, mean))
    _, _, groups, mean = min(options, key=lambda option: option[:2])
    return groups, mean


def signed_mask(bits: list[int]) -> int:
    return int(np.array([sum(1 << b for b in bits)], dtype=np.uint64).view(np.int64)[0])


def neighbours(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """(n, 1 + bits): the values and all that differ from them in one of the bits."""
    flips = np.array([0] + [signed_mask([b]) for b in bits], dtype=np.int64)
    return values[:, None] ^ flips[None, :]


def probes(counted: DataFrame, groups: list[list[int]], mean: np.ndarray) -> DataFrame:
    """(fp, part, key): the cells a fingerprint looks up; part -1 has the words it meets others in."""
    widths = np.array([len(g) for g in groups])
    masks = [signed_mask(g) for g in groups]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column("fp").to_numpy()
            members = np.stack([batch.column(f"n{k}").to_numpy() for k in range(len(groups))], axis=1)
            level, cost = thresholds(members, widths, mean)
            whole = cost > WHOLE
            out = [(-1, values[whole], neighbours(values[whole], list(range(64))))]
            for part, bits in enumerate(groups):
                for size in (0, 1):
                    rows = values[(level[:, part] == size) & ~whole]
                    keys = neighbours(rows & masks[part], bits if size else [])
                    out.append((part, rows, keys))
            for part, rows, keys in out:
                for start in range(0, len(rows), 1 << 12):
                    some = keys[start : start + (1 << 12)]
                    yield pa.record_batch(
                        [
                            pa.array(np.repeat(rows[start : start + (1 << 12)], some.shape[1])),
                            pa.array(np.full(some.size, part, dtype=np.int32)),
                            pa.array(some.ravel()),
                        ],
                        names=["fp", "part", "key"],
                    )

    return counted.mapInArrow(choose, "fp bigint, part int, key bigint")


def links(prints: DataFrame, shelf: Shelf) -> DataFrame:
    """(a, b): links that join all distinct fingerprints within two bits, directly or through others."""
    rows = prints.count()
    groups, mean = partitions(bit_counts(prints), rows)
    cells = [
        F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(signed_mask(g))).alias("key"))
        for k, g in enumerate(groups)
    ]
    postings = prints.select("fp", F.inline(F.array(*cells)))
    sizes = postings.groupBy("part", "key").agg(F.count("*").alias("n"))
    index = shelf.put(postings.join(sizes, ["part", "key"]))
    own = [F.max(F.when(F.col("part") == k, F.col("n"))).alias(f"n{k}") for k in range(len(groups))]
    asked = shelf.put(probes(index.groupBy("fp").agg(*own), groups, mean))
    looked_up = asked.filter("part >= 0")
    crowded = index.filter(F.col("n") > CELL).select("part", "key").distinct()
    misjudged = looked_up.join(crowded, ["part", "key"], "left_semi").select("fp").distinct()
    flips = F.array(*[F.lit(signed_mask([b] if b >= 0 else [])) for b in range(-1, 64)])
    late = misjudged.select("fp", F.explode(flips).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("key")
    )
    meeting = asked.filter("part < 0").select("fp", "key").union(late)
    met = (
        meeting.groupBy("key")
        .agg(F.collect_set("fp").alias("fps"))
        .filter(F.size("fps") > 1)
        .select(F.explode("fps").alias("a"), F.array_min("fps").alias("b"))
    )
    found = looked_up.withColumnRenamed("fp", "a").join(
        index.filter(F.col("n") <= CELL).select("part", "key", F.col("fp").alias("b")), ["part", "key"]
    )
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    return found.filter("a <> b").filter(near).select("a", "b").union(met.filter("a <> b"))


def simhash(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row."""
    spark = docs.sparkSession
    shelf = Shelf(spark)
    given = docs.select(docs[id_column].cast("bigint").alias("doc_id"), docs[text_column].alias("text"))
    with lean_shuffles(spark):
        signed = shelf.put(given.mapInArrow(_signed, "doc_id bigint, fp bigint"))
        prints = shelf.put(signed.groupBy("fp").agg(F.min("doc_id").alias("least")))
        components = connected_components(links(prints.select("fp"), shelf), shelf)
        named = prints.join(components.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
            "component", F.coalesce("component", "fp")
        )
        least = named.groupBy("component").agg(F.min("least").alias("component_id"))
        of_print = shelf.put(named.join(least, "component").select("fp", "component_id"))
    shelf.close(signed, of_print)
    return signed.join(of_print, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )
