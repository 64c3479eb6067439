"""Placement of documents on shards by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a table of prime size, given by two hashes of its
name. The shards take turns; in its turn a shard claims the first slot of its permutation that is still
free. All shards own the same number of slots up to one, and a shard that joins or leaves moves few
slots besides its own. A document's slot is a hash of its id modulo the table size.

The table is fixed by shard names and size, not by the data, and is filled once on the driver. It is
broadcast (table size times 16 bytes), so placement is one lookup without a shuffle.

A null id has a slot like any other value; repeated ids share a shard; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65_537
SHARDS = tuple(f"shard-{n:03d}" for n in range(128))


def _number(name: str, purpose: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{purpose}:{name}".encode()).digest()[:8], "big")


def fill_table(names: tuple[str, ...], size: int = TABLE_SIZE) -> np.ndarray:
    """Index of the owning shard for every slot."""
    if not names or len(set(names)) != len(names):
        raise ValueError("shards need different names")
    if size < len(names) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be a prime not below the number of shards")
    place = [_number(n, "offset") % size for n in names]
    skip = [_number(n, "skip") % (size - 1) + 1 for n in names]
    owner = [-1] * size
    claimed = 0
    while True:
        for shard in range(len(names)):
            slot = place[shard]
            while owner[slot] >= 0:
                slot = (slot + skip[shard]) % size
            owner[slot] = shard
            place[shard] = (slot + skip[shard]) % size
            claimed += 1
            if claimed == size:
                return np.array(owner, dtype=np.int32)


def assign_shards(
    docs: DataFrame,
    names: tuple[str, ...] = SHARDS,
    size: int = TABLE_SIZE,
    id_column: str = "doc_id",
) -> DataFrame:
    """(doc_id, slot, shard, shard_name), one row per input row."""
    owner = fill_table(names, size).tolist()
    table = docs.sparkSession.createDataFrame(
        [(slot, shard, names[shard]) for slot, shard in enumerate(owner)],
        "slot int, shard int, shard_name string",
    )
    keyed = docs.select(
        docs[id_column].alias("doc_id"),
        F.pmod(F.xxhash64(docs[id_column]), F.lit(size)).cast("int").alias("slot"),
    )
    return keyed.join(F.broadcast(table), "slot").select("doc_id", "slot", "shard", "shard_name")
