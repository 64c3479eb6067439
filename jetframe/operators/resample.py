"""How often every position of a class is drawn, and what that makes per score rank.

A draw is ``hex12(md5("seed|replicate|class|position")) % n``. A task makes all draws of a replicate and class
and counts them by position, a byte each, so what is shuffled is the counts of ranges of positions, at two bits a
position and a byte more for those drawn three times or more often. Nothing here holds the index of rows: a range of
it meets the counts of its positions, range by range.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa

# Positions of a range: counts of all replicates meet one range of the index at a time.
RANGE = 1 << 18
# Positions that one task counts. A larger class is counted window by window, its draws made once for each.
WINDOW = 1 << 27
OBSERVED = -1
# Stands for the rows of the index among the replicates: comes before all of them.
INDEX = -2
# Draws made at a time; numbers that share all but their last digits differ in two words of the hashed block.
CHUNK = 20_000
TAILS = {4: 10_000, 5: 100_000}

SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
PLACES = [(i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16)[i // 16] for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
# The four two-bit numbers in a byte.
QUARTERS = np.array([[b >> s & 3 for s in (0, 2, 4, 6)] for b in range(256)], np.uint8)

COUNTED = "target int, range bigint, rep int, counts binary, more binary"


@cache
def digits_table(digits: int) -> np.ndarray:
    """The texts of all numbers of so many digits, as little-endian integers of eight bytes."""
    texts = np.char.zfill(np.arange(TAILS[digits]).astype("S"), digits)
    return texts.astype("S8").view("<u8")


def hashed(prefix: bytes, tails: np.ndarray, digits: int) -> np.ndarray:
    """The leading 48 bits of ``md5(prefix + tail)`` for every tail of so many digits; one block of 64 bytes."""
    at, size, n = len(prefix), len(prefix) + digits, len(tails)
    if size > 55:
        raise ValueError("the text of a draw fits one block")
    block = prefix + bytes(digits) + b"\x80" + bytes(55 - size) + struct.pack("<Q", 8 * size)
    words: list = list(struct.unpack("<16I", block))
    word = at // 4
    halves = (tails << np.uint64(at % 4 * 8)).view("<u4").reshape(n, 2)
    for half in (0, 1):
        words[word + half] = np.ascontiguousarray(halves[:, half]) | np.uint32(words[word + half])
    a, b, c, d = (np.full(n, s, "<u4") for s in START)
    f = np.empty(n, "<u4")
    for i in range(64):
        turn = i // 16
        if turn == 0:
            np.bitwise_xor(c, d, f)
            f &= b
            f ^= d
        elif turn == 1:
            np.bitwise_xor(b, c, f)
            f &= d
            f ^= c
        elif turn == 2:
            np.bitwise_xor(b, c, f)
            f ^= d
        else:
            np.invert(d, f)
            f |= b
            f ^= c
        a += f
        own = words[PLACES[i]]
        if isinstance(own, int):
            a += np.uint32((own + SINES[i]) & 0xFFFFFFFF)
        else:
            a += own
            a += np.uint32(SINES[i])
        left = SHIFTS[turn][i % 4]
        np.left_shift(a, np.uint32(left), f)
        a >>= np.uint32(32 - left)
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    a += np.uint32(START[0])
    b += np.uint32(START[1])
    low = b.view("<u2")[::2].byteswap()
    return (a.byteswap().astype(np.uint64) << np.uint64(16)) | low


def drawn(seed: int, rep: int, target: int, n: int) -> Iterator[np.ndarray]:
    """The positions drawn by positions 0 to ``n - 1`` of a class, some thousands at a time, in order."""
    text = f"{seed}|{rep}|{target}|".encode()
    first = min(n, 1000)
    heads = [hashlib.md5(text + str(k).encode()).digest()[:6] for k in range(first)]
    yield np.array([int.from_bytes(h, "big") % n for h in heads], np.int64)
    size = np.uint64(n)
    k = first
    while k < n:
        digits = 4 if k < 10_000 else 5
        whole = TAILS[digits]
        high, low = divmod(k, whole)
        last = min(n - high * whole, low + CHUNK, whole)
        prefix = text + (str(high).encode() if high else b"")
        number = hashed(prefix, digits_table(digits)[low:last], digits)
        yield (number - number // size * size).astype(np.int64)
        k += last - low


def counts_of(seed: int, rep: int, target: int, n: int, window: int) -> np.ndarray:
    """How often each position of a window is drawn; the observed replicate has every row once."""
    first = window * WINDOW
    size = min(n - first, WINDOW)
    if rep == OBSERVED:
        return np.ones(size, np.uint8)
    counts, one, seen = np.zeros(size, np.uint8), np.uint8(1), 0
    for places in drawn(seed, rep, target, n):
        if n > WINDOW:
            places = places[(places >= first) & (places < first + size)] - first
        np.add.at(counts, places, one)
        seen += len(places)
    if int(counts.sum(dtype=np.int64)) != seen:
        raise OverflowError("a position is drawn more than 255 times")
    return counts


def packed(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Two bits a position, and a byte for each position that has three or more."""
    few = np.minimum(counts, 3)
    few = np.concatenate([few, np.zeros(-len(few) % 4, np.uint8)]).reshape(-1, 4)
    made = few[:, 0] | few[:, 1] << 2 | few[:, 2] << 4 | few[:, 3] << 6
    return made.tobytes(), counts[counts >= 3].tobytes()


def unpacked(made: bytes, more: bytes, n: int) -> np.ndarray:
    counts = QUARTERS[np.frombuffer(made, np.uint8)].reshape(-1)[:n]
    counts[np.flatnonzero(counts == 3)] = np.frombuffer(more, np.uint8)
    return counts


def count_draws(seed: int):
    """For ``mapInArrow`` over ``(rep, target, window, n_c)``: rows of ``COUNTED``, a row per range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in batch.to_pylist():
                counts = counts_of(seed, unit["rep"], unit["target"], unit["n_c"], unit["window"])
                first = unit["window"] * (WINDOW // RANGE)
                cuts = range(0, len(counts), RANGE)
                parts = [packed(counts[at : at + RANGE]) for at in cuts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([unit["target"]] * len(parts), pa.int32()),
                        pa.array([first + i for i in range(len(parts))], pa.int64()),
                        pa.array([unit["rep"]] * len(parts), pa.int32()),
                        pa.array([p[0] for p in parts], pa.binary()),
                        pa.array([p[1] for p in parts], pa.binary()),
                    ],
                    ["target", "range", "rep", "counts", "more"],
                )

    return run


class RankedRange:
    """A range of the index, sorted by the rank of every side: counts by position become counts by rank."""

    def __init__(self, rows: pa.StructArray, sides: int, block: int) -> None:
        at = np.argsort(rows.field("k").to_numpy(), kind="stable")
        self.size = len(at)
        self.sides = []
        for side in range(sides):
            rank = rows.field(f"rank_{side}").to_numpy()[at]
            right = rows.field(f"ok_{side}").to_numpy()[at]
            order = np.argsort(rank, kind="stable")
            ranks, starts = np.unique(rank[order], return_index=True)
            self.sides.append((order, starts, ranks, right[order][starts], ranks // block))

    def counted(self, counts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """``(side, block, rank, n, ok)`` of the ranks drawn; a rank of a class is right or wrong as a whole."""
        for side, (order, starts, ranks, right, blocks) in enumerate(self.sides):
            n = np.add.reduceat(counts[order], starts, dtype=np.int64)
            kept = np.flatnonzero(n)
            if not len(kept):
                continue
            n, rank, ok, block = n[kept], ranks[kept], right[kept] * n[kept], blocks[kept]
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(kept)]
            for lo, hi in zip(cuts, cuts[1:]):
                yield side, int(block[lo]), rank[lo:hi], n[lo:hi], ok[lo:hi]


GROUPED = "rep int, side int, block int, target int, rank array<int>, n array<bigint>, ok array<bigint>"


def meet_ranges(sides: int, block: int, limit: int = 1 << 20):
    """For ``mapInArrow`` over rows of a range and the counts of its replicates, the index first: rows of ``GROUPED``."""

    def lists(values: Sequence[np.ndarray], kind: pa.DataType) -> pa.ListArray:
        ends = np.cumsum([0, *[len(v) for v in values]])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values), kind))

    def table(rows: list) -> pa.RecordBatch:
        rep, side, at, target, rank, n, ok = zip(*rows)
        arrays = [pa.array(c, pa.int32()) for c in (rep, side, at, target)]
        arrays += [lists(rank, pa.int32()), lists(n, pa.int64()), lists(ok, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["rep", "side", "block", "target", "rank", "n", "ok"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, rows, held = None, [], 0
        for batch in batches:
            reps = batch.column("rep").to_pylist()
            for i, rep in enumerate(reps):
                if rep == INDEX:
                    index = RankedRange(batch.column("index").slice(i, 1).flatten(), sides, block)
                    continue
                target = batch.column("target")[i].as_py()
                made, more = (batch.column(c)[i].as_py() for c in ("counts", "more"))
                for found in index.counted(unpacked(made, more, index.size)):
                    rows.append((rep, found[0], found[1], target, *found[2:]))
                    held += len(found[2])
                if held >= limit:
                    yield table(rows)
                    rows, held = [], 0
        if rows:
            yield table(rows)

    return run
