"""Best-fit packing of documents into token sequences, planned on a histogram of lengths.

1. Every text is tokenised where it is read (null counts as empty) and closed with one end token. Only
   documents longer than a sequence are cut, into pieces of full length of which the first takes the
   remainder. A piece is a small row: place, length and CRC-32 of its ids.
2. The plan sees counts alone: best-fit decreasing over at most ``capacity`` different lengths. A run of
   sequences with the same content is one group. Placing a length splits at most two groups, and a
   group's free space at least halves whenever it is used, so the plan has at most
   6 * log2(capacity) * capacity rows, whatever the number of documents. That is what is broadcast.
3. Documents take the planned slots by their rank within their length. The rank is built from counts
   per (length, lane) and a window inside each lane, so that a length shared by most documents is
   spread over many tasks.

Repeated rows are packed once each; ids of any value and null ids keep their pieces; an empty table
gives an empty result; further columns are ignored. The ids equal those of the ``tokenizers`` library
with ``byte_bpe_50k.json``. Its added tokens (``default_added``, which the query and the pipeline give) are
one id wherever a text holds them; without ``added`` they are ordinary text, as under the library's
``encode_special_tokens``. The same vocabulary is applied by ``tiktoken``, which is four times as fast here. Its regex takes no more than about a million spaces in a
row, so a run of ``LONG_RUN`` of them is split off where the pattern splits it and merged by itself.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jetframe.llm.texts import pieces
from jetframe.session import checkpoint

CAPACITY = 2048
END_ID = 0
LONG_RUN = 1 << 16
LANES = 64
#: The pattern's whitespace (Unicode White_Space; that of ``re`` has four control characters more).
SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
RUN = re.compile(f"(?<!{SPACE}){SPACE}{{{LONG_RUN},}}")
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
SLOTS = (
    "length bigint, first_rank bigint, slots bigint, sequence bigint, per_sequence bigint, base bigint"
)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_added() -> dict[str, int]:
    """Text and id of the added tokens of the vocabulary."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    if any(t[flag] for t in tokens for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that look at their surroundings are not supported")
    return {t["content"]: t["id"] for t in tokens}


@lru_cache(maxsize=2)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def encode(encoder, text: str, added: dict[str, int]) -> list[int]:
    """The ids of ``text``; what lies between added tokens is encoded by itself."""
    if not any(token in text for token in added):
        return encode_ordinary(encoder, text)
    ids: list[int] = []
    start = 0
    for token in re.finditer("|".join(map(re.escape, sorted(added, key=len, reverse=True))), text):
        ids += encode_ordinary(encoder, text[start : token.start()])
        ids.append(added[token.group()])
        start = token.end()
    return ids + encode_ordinary(encoder, text[start:])


def encode_ordinary(encoder, text: str) -> list[int]:
    """The ids of ``text``, whitespace runs of any length included."""
    if len(text) < LONG_RUN:
        return encoder.encode_ordinary(text)
    ids: list[int] = []
    start = 0
    for run in RUN.finditer(text):
        # The pattern leaves the last of a run to the word after it, if there is one.
        end = run.end() - (run.end() < len(text))
        ids += encoder.encode_ordinary(text[start : run.start()])
        ids += encoder._encode_single_piece(text[run.start() : end])
        start = end
    return ids + encoder.encode_ordinary(text[start:])


def piece_lengths(total: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of ``total`` tokens; only the first may be shorter."""
    full, first = divmod(total, capacity)
    return ([first] if first else []) + [capacity] * full


def token_pieces(
    docs: DataFrame,
    ranks: str | None = None,
    capacity: int = CAPACITY,
    id_column: str = "doc_id",
    text_column: str = "text",
    added: dict[str, int] | None = None,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece."""
    ranks = ranks or default_ranks()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(ranks)
        for batch in batches:
            for rows, texts in pieces(batch):
                out: list[tuple] = []
                for doc_id, text in zip(rows.column("doc_id").to_pylist(), texts, strict=True):
                    ids = np.asarray(encode(encoder, text.decode(), added or {}) + [END_ID], "<u4")
                    start = 0
                    for piece, length in enumerate(piece_lengths(len(ids), capacity)):
                        crc = zlib.crc32(ids[start : start + length].tobytes())
                        out.append((doc_id, piece, start, length, crc))
                        start += length
                columns = list(zip(*out, strict=True))
                yield pa.record_batch(
                    [
                        pa.array(columns[0], pa.int64()),
                        pa.array(columns[1], pa.int32()),
                        *(pa.array(c, pa.int64()) for c in columns[2:]),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    chosen = docs.select(
        docs[id_column].cast("bigint").alias("doc_id"), docs[text_column].alias("text")
    )
    return chosen.mapInArrow(cut, PIECES)


def plan_slots(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple]:
    """Best-fit decreasing over counts; rows of ``SLOTS``.

    A row says: ranks first_rank .. first_rank + slots - 1 of this length fill sequences from
    ``sequence`` on, ``per_sequence`` in each, the first at offset ``base``.
    """
    groups: dict[int, list[tuple[int, int]]] = {}
    rows: list[tuple] = []
    sequences = 0

    def fill(length: int, rank: int, left: int, free: int, first: int, count: int) -> int:
        """Put up to ``left`` pieces into ``count`` sequences with ``free`` places; returns how many."""
        each = free // length
        full = min(count, left // each)
        rest = min(each, left - full * each) if full < count else 0
        for number, offset, times in ((full, 0, each), (1 if rest else 0, full, rest)):
            if number:
                begun = rank + offset * each
                rows.append((length, begun, number * times, first + offset, times, capacity - free))
                groups.setdefault(free - times * length, []).append((first + offset, number))
        untouched = count - full - (1 if rest else 0)
        if untouched:
            groups.setdefault(free, []).append((first + full + (1 if rest else 0), untouched))
        return full * each + rest

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        for free in sorted(f for f in groups if f >= length):
            for first, count in groups.pop(free) if left else ():
                if left:
                    done = fill(length, rank, left, free, first, count)
                    rank, left = rank + done, left - done
                else:
                    groups.setdefault(free, []).append((first, count))
        if left:
            needed = -(-left // (capacity // length))
            fill(length, rank, left, capacity, sequences, needed)
            sequences += needed
    return rows


def ranked(cut: DataFrame, lanes: int = LANES) -> DataFrame:
    """``cut`` with ``rank``: 0, 1, ... within each length, built lane by lane."""
    laned = cut.withColumn("lane", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(lanes)).cast("int"))
    sizes = laned.groupBy("length", "lane").agg(F.count("*").alias("size"))
    before = Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "length", "lane", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before")
    )
    within = Window.partitionBy("length", "lane").orderBy("doc_id", "piece")
    return (
        laned.join(offsets, ["length", "lane"])
        .withColumn("rank", F.col("before") + F.row_number().over(within) - 1)
        .drop("lane", "before")
    )


def pack(
    docs: DataFrame,
    ranks: str | None = None,
    capacity: int = CAPACITY,
    id_column: str = "doc_id",
    text_column: str = "text",
    added: dict[str, int] | None = None,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    spark = docs.sparkSession
    cut = checkpoint(token_pieces(docs, ranks, capacity, id_column, text_column, added))
    counts = cut.groupBy("length").agg(F.count("*").alias("pieces")).collect()
    plan = plan_slots({r["length"]: r["pieces"] for r in counts}, capacity)
    slots = spark.createDataFrame(plan, SLOTS).withColumnRenamed("length", "slot_length")
    place = F.col("rank") - F.col("first_rank")
    return (
        ranked(cut)
        .join(
            F.broadcast(slots),
            (F.col("length") == F.col("slot_length"))
            & (F.col("rank") >= F.col("first_rank"))
            & (F.col("rank") < F.col("first_rank") + F.col("slots")),
        )
        .select(
            "doc_id",
            "piece",
            "start",
            "length",
            "ids_crc32",
            (F.col("sequence") + F.floor(place / F.col("per_sequence"))).alias("sequence_id"),
            (F.col("base") + (place % F.col("per_sequence")) * F.col("length")).alias("offset"),
        )
    )
