"""Exact Jaccard join of word-shingle sets in the metric space of the Jaccard distance.

Words are runs of bytes other than space and tab to carriage return, A-Z lower-cased; a document's set
holds its distinct five-word shingles (fewer words: the whole sequence as one; none: empty, linked with
nothing). Two documents link when 100 * |intersection| >= 75 * |union|, a distance of at most r = 0.25.
Every document gets the smallest doc_id it reaches by links.

In this space unrelated documents all have distance 1 from each other, so no document can serve as a
pivot for them: every window of width r would hold everything. The regions are therefore built in two
steps, both exact:

1. *Cover.* Shingles have a global order, common ones last (from a counting table of fixed size over all
   texts). Two linked sets share a shingle within the first |x| - ceil(0.75 |x|) + 1 of each, so the
   documents meeting in such a shingle, the cells, cover all links. A cell's pivot is its smallest
   member by (size, set hash). The documents of all cells with one pivot are that pivot's region; a
   document on a boundary stands in several regions.
2. *Pivots.* Only distances to pivots are computed, on whole sets. A bitmap of four bits per shingle
   bounds an intersection from above, so that clear cases need no set (they are far, whatever the set). A member within r of its pivot is
   linked. Cells whose members are all in one component by then are finished: this ends groups of near
   copies of any size after n - 1 instead of n (n - 1) / 2 comparisons.
3. *Recursion.* In a cell that is not finished, further pivots are drawn, a few at first and then
   ``MORE_PIVOTS`` times as many each round, and compared with members of other components inside the windows the triangle inequality leaves:
   |d(x, p) - d(y, p)| <= r for the cell's pivot p, and sizes and places that allow the threshold. Of two
   linked sets one has the first shared shingle in its first seventh, so only such members are drawn.
   Pivots used are done with; the rounds end when no cell is unfinished.

No round emits all pairs of a large cell, and nothing is capped: a cell stays until it is finished.
Copies with the same set are one node (its 64-bit hash and size) from the start.

Shingles are compared by 64-bit hashes. Null doc_ids keep their row and take part; repeated rows are
repeated in the result; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from jetframe.llm.components import connected_components
from jetframe.llm.texts import GOLDEN, LOWER, bounds_of, joined, mix, pieces, word_grams, words
from jetframe.session import Shelf, checkpoint, lean_shuffles

SHINGLE = 5
PERCENT = 75
RADIUS = 1.0 - PERCENT / 100
COUNTERS = 1 << 22
CHUNK = 1 << 16
FLUSH = 1 << 21
BLOOM_BITS = 1 << 24
PIVOTS, MORE_PIVOTS = 4, 8
PIECE_BYTES = 1 << 18
SEEN_SETS = 1 << 18


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """The ascending distinct 64-bit shingle hashes of every text."""
    data, bounds = joined(texts)
    starts, _, hashes = words(LOWER[data])
    owner = np.searchsorted(bounds, starts, side="right") - 1
    edges = bounds_of(owner, len(texts))
    grams = word_grams(hashes, size)
    sets = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a >= size:
            one = np.sort(grams[a : b - size + 1])
            sets.append(one[np.concatenate([[True], one[1:] != one[:-1]])])
        elif b > a:
            sets.append(word_grams(hashes[a:b], b - a))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def set_hash(members: np.ndarray) -> int:
    """64-bit hash of a set as a signed number; 0 for the empty set."""
    if not len(members):
        return 0
    total = np.add.reduce(mix(members + GOLDEN)) ^ np.bitwise_xor.reduce(mix(members ^ GOLDEN))
    return int(mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def prefix_length(size):
    """How many first shingles two linked sets must share one of: n - ceil(0.75 n) + 1."""
    return size + (-size * PERCENT) // 100 + 1


def bitmap(members: np.ndarray) -> bytes:
    """Bits of the set's low hash bits; a power of two of at least four bits per member."""
    size = max(64, 1 << (4 * len(members) - 1).bit_length()) if len(members) else 64
    bits = np.zeros(size, dtype=bool)
    bits[(members & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def most_common(n: int, x: bytes, m: int, y: bytes) -> int:
    """An upper bound of the intersection of sets of n and m members with these bitmaps.

    A bit of one set that the other lacks stands for at least one member the other lacks.
    """
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(p), len(q))
    p = np.bitwise_or.reduce(p.reshape(-1, size), axis=0)
    q = np.bitwise_or.reduce(q.reshape(-1, size), axis=0)
    return min(n - int(np.bitwise_count(p & ~q).sum()), m - int(np.bitwise_count(q & ~p).sum()))


class Counters:
    """Counting table of one task: a shingle adds to the counter its low bits name."""

    def __init__(self) -> None:
        self.table = np.zeros(COUNTERS, dtype=np.int64)
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, sets: list[np.ndarray]) -> None:
        self.waiting += [(s & np.uint64(COUNTERS - 1)).astype(np.int32) for s in sets]
        self.held += sum(map(len, sets))
        if self.held > FLUSH:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            self.table += np.bincount(np.concatenate(self.waiting), minlength=COUNTERS)
        self.waiting, self.held = [], 0

    def chunks(self) -> Iterator[tuple[int, bytes]]:
        self.flush()
        for number, part in enumerate(self.table.reshape(-1, CHUNK)):
            if part.any():
                yield number, packed(part)


def packed(counts: np.ndarray) -> bytes:
    """Counters of a chunk, compressed; only those in use if they are few (a task with little text)."""
    counts = np.minimum(counts, np.iinfo(np.uint32).max).astype("<u4")
    used = np.flatnonzero(counts)
    if len(used) * 8 > len(counts):
        return b"d" + zlib.compress(counts.tobytes(), 1)
    return b"s" + zlib.compress(used.astype("<u2").tobytes() + counts[used].tobytes(), 1)


def unpacked(counts: bytes) -> np.ndarray:
    data = zlib.decompress(counts[1:])
    if counts[:1] == b"d":
        return np.frombuffer(data, dtype="<u4").astype(np.int64)
    found = len(data) // 6
    table = np.zeros(CHUNK, dtype=np.int64)
    table[np.frombuffer(data, "<u2", found)] = np.frombuffer(data, "<u4", found, found * 2)
    return table


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, then the task's counting table in chunks."""
    names = ["doc_id", "n", "node", "bits", "chunk", "counts"]
    counters = Counters()
    for batch in batches:
        for rows, texts in pieces(batch, budget=PIECE_BYTES):
            sets = shingle_sets(texts)
            counters.add(sets)
            yield pa.record_batch(
                [
                    rows.column("doc_id").cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_hash(s) for s in sets], pa.int64()),
                    pa.array([bitmap(s) for s in sets], pa.binary()),
                    pa.nulls(len(sets), pa.int32()),
                    pa.nulls(len(sets), pa.binary()),
                ],
                names=names,
            )
    for number, counts in counters.chunks():
        empty = [pa.nulls(1, pa.int64())] * 3 + [pa.nulls(1, pa.binary())]
        chunk = [pa.array([number], pa.int32()), pa.array([counts], pa.binary())]
        yield pa.record_batch([*empty, *chunk], names=names)


def _add_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the chunks of this partition: at most as many rows as there are chunks."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(
            batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True
        ):
            total[chunk] = total.get(chunk, 0) + unpacked(counts)
    for chunk, counts in total.items():
        yield pa.record_batch(
            [pa.array([chunk], pa.int32()), pa.array([packed(counts)], pa.binary())],
            names=["chunk", "counts"],
        )


def common_table(chunks: DataFrame) -> np.ndarray:
    """How common the shingles of each counter are: 0 for what chance explains, then rising.

    ``COUNTERS`` numbers whatever the input; they only shape the order, never the result. Tasks' tables
    are added by chunk, first in groups of tasks, then over the groups.
    """
    kind = "chunk int, counts binary"
    once = chunks.withColumn("lane", F.spark_partition_id() % 16)
    once = once.repartition("chunk", "lane").drop("lane").mapInArrow(_add_chunks, kind)
    table = np.zeros(COUNTERS, dtype=np.float64)
    for row in once.repartition("chunk").mapInArrow(_add_chunks, kind).collect():
        start = row["chunk"] * CHUNK
        table[start : start + CHUNK] = unpacked(row["counts"])
    typical = np.median(table)
    return np.maximum(0, (table - typical) / (2 * np.sqrt(typical + 1))).astype(np.uint32)


def cells(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """(cell, node, n, place): first shingles of every set with at least three members.

    Smaller sets link with equal sets alone, which are the same node.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        seen: set[int] = set()
        for batch in batches:
            for _, texts in pieces(batch, budget=PIECE_BYTES):
                keys, nodes, sizes, places = [], [], [], []
                for members in shingle_sets(texts):
                    if len(members) < 3:
                        continue
                    node = set_hash(members)
                    if node in seen:
                        continue
                    if len(seen) >= SEEN_SETS:
                        seen.clear()
                    seen.add(node)
                    count = prefix_length(len(members))
                    rank = common[(members & np.uint64(COUNTERS - 1)).astype(np.int64)]
                    order = np.lexsort((mix(members), rank))[:count]
                    keys.append(members[order])
                    nodes.append(np.full(count, node, dtype=np.int64))
                    sizes.append(np.full(count, len(members), dtype=np.int64))
                    places.append(np.arange(count))
                if keys:
                    size, place = np.concatenate(sizes), np.concatenate(places)
                    yield pa.record_batch(
                        [
                            pa.array(np.concatenate(keys).view(np.int64)),
                            pa.array(np.concatenate(nodes)),
                            pa.array((size << 32) | place),
                        ],
                        names=["cell", "node", "shape"],
                    )

    return docs.select("text").mapInArrow(first, "cell bigint, node bigint, shape bigint")


def regions(postings: DataFrame) -> DataFrame:
    """(cell, node, n, place, pivot, pivot_n, pivot_place) of cells with several nodes.

    One shuffle and sort by cell; a task then streams over its cells, holding one batch and the pivot
    of the cell at hand, so a cell may be of any size.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_cell, last_node, last_shape = None, 0, 0
        announced = False
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column("cell").to_numpy()
            node = batch.column("node").to_numpy()
            shape = batch.column("shape").to_numpy()
            new = np.concatenate([[last_cell is None or cell[0] != last_cell], cell[1:] != cell[:-1]])
            group = np.cumsum(new)
            heads = np.flatnonzero(new)
            first = np.concatenate([[-1], heads])[group]
            pivot = np.where(first >= 0, node[first], last_node)
            pivot_shape = np.where(first >= 0, shape[first], last_shape)
            met = node != pivot
            busy = np.zeros(group[-1] + 1, dtype=bool)
            busy[group[met]] = True
            head_rows = heads[busy[group[heads]]]
            late = bool(busy[0]) and not announced
            rows = np.sort(np.concatenate([np.flatnonzero(met), head_rows]))
            out = [
                (cell[rows], node[rows], shape[rows], pivot[rows], pivot_shape[rows]),
            ]
            if late:
                value = (last_cell, last_node, last_shape, last_node, last_shape)
                out.append(tuple(np.array([v], dtype=np.int64) for v in value))
            last = int(group[-1])
            announced = bool(busy[last]) or (last == 0 and announced)
            last_cell, last_node, last_shape = int(cell[-1]), int(pivot[-1]), int(pivot_shape[-1])
            for columns in out:
                if len(columns[0]):
                    yield pa.record_batch([pa.array(c) for c in columns], names=NAMES)

    sized = postings.repartition("cell").sortWithinPartitions("cell", "shape", "node")
    found = sized.mapInArrow(stream, ", ".join(f"{n} bigint" for n in NAMES))
    low = F.lit((1 << 32) - 1)
    return found.select(
        "cell",
        "node",
        F.shiftright("shape", 32).alias("n"),
        F.col("shape").bitwiseAND(low).alias("place"),
        "pivot",
        F.shiftright("pivot_shape", 32).alias("pivot_n"),
        F.col("pivot_shape").bitwiseAND(low).alias("pivot_place"),
    )


NAMES = ["cell", "node", "shape", "pivot", "pivot_shape"]


def possible(n, place, m, other_place):
    """Whether sets of sizes n and m that share the shingle at these places can reach the threshold."""
    small, large = F.least(n, m), F.greatest(n, m)
    needed = F.ceil((n + m) * PERCENT / (100.0 + PERCENT) - 1e-9)
    return (small * 100 >= large * PERCENT) & (
        F.least(n - place, m - other_place) >= needed
    )


def bloom_bit(node: int) -> int:
    """Nodes are hashes already: their low bits serve."""
    return node & (BLOOM_BITS - 1)


def bloom(nodes: DataFrame) -> np.ndarray:
    """Bit table of fixed size over the nodes, to leave out sets that are certainly not asked for."""
    low = F.col("node").bitwiseAND(F.lit(BLOOM_BITS - 1))
    found = (
        nodes.select(F.shiftright(low, 6).alias("word"), low.bitwiseAND(F.lit(63)).alias("bit"))
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("bits"))
        .toPandas()
    )
    table = np.zeros(BLOOM_BITS // 64, dtype=np.int64)
    table[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64)
    return table


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, members) of these nodes and, by chance, a few others; read from the texts once more."""
    table = docs.sparkSession.sparkContext.broadcast(bloom(nodes))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        seen: set[int] = set()
        for batch in batches:
            for _, texts in pieces(batch, budget=PIECE_BYTES):
                found, members = [], []
                for one in shingle_sets(texts):
                    node = set_hash(one)
                    if len(one) < 3 or node in seen:
                        continue
                    bit = bloom_bit(node)
                    if (int(bits[bit // 64]) >> (bit % 64)) & 1:
                        if len(seen) >= SEEN_SETS:
                            seen.clear()
                        seen.add(node)
                        found.append(node)
                        members.append(one.tobytes())
                if found:
                    yield pa.record_batch(
                        [pa.array(found, pa.int64()), pa.array(members, pa.binary())],
                        names=["node", "members"],
                    )

    every = docs.select("text").mapInArrow(emit, "node bigint, members binary")
    return every.dropDuplicates(["node"])


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, a_n, b_n, common) of pairs (a, b): sizes and exact intersection."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = batch.column("left").to_pylist()
            right = batch.column("right").to_pylist()
            numbers = np.zeros((3, len(left)), dtype=np.int64)
            for row, (x, y) in enumerate(zip(left, right, strict=True)):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                small, large = (p, q) if len(p) <= len(q) else (q, p)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                numbers[:, row] = len(p), len(q), int((large[at] == small).sum())
            yield pa.record_batch(
                [batch.column("a"), batch.column("b"), *(pa.array(v) for v in numbers)],
                names=["a", "b", "a_n", "b_n", "common"],
            )

    left = sets.select(F.col("node").alias("a"), F.col("members").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("right"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select("a", "b", "left", "right")
        .mapInArrow(count, "a bigint, b bigint, a_n bigint, b_n bigint, common bigint")
    )


def plausible(pairs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bitmaps leave a link possible."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("a_n", "a_bits", "b_n", "b_bits")]
            good = []
            for n, x, m, y in zip(*columns, strict=True):
                common = most_common(n, x, m, y)
                good.append(100 * common >= PERCENT * (n + m - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    for side in ("a", "b"):
        named = bitmaps.select(
            F.col("node").alias(side), F.col("n").alias(f"{side}_n"), F.col("bits").alias(f"{side}_bits")
        )
        pairs = pairs.join(named, side)
    ready = pairs.select("a", "b", "a_n", "a_bits", "b_n", "b_bits")
    return ready.mapInArrow(keep, "a bigint, b bigint")


def linked(found: DataFrame) -> DataFrame:
    return found.filter("100 * common >= {0} * (a_n + b_n - common)".format(PERCENT)).select("a", "b")


def ordered_pairs(frame: DataFrame, x: str, y: str) -> DataFrame:
    return frame.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def pair_distances(
    pairs: DataFrame, docs: DataFrame, bitmaps: DataFrame, shelf: Shelf
) -> DataFrame | None:
    """Exact sizes and intersections of the plausible ones of the pairs; None if there is none."""
    near = shelf.put(plausible(pairs, bitmaps))
    if near.isEmpty():
        shelf.drop(near)
        return None
    ends = near.select(F.explode(F.array("a", "b")).alias("node"))
    # Both ends of the pairs read the sets: one pass over the texts.
    sets = shelf.put(sets_of(docs, ends))
    return shelf.put(measured(near, sets), near, sets)


def set_links(docs: DataFrame, table: np.ndarray, bitmaps: DataFrame, shelf: Shelf) -> DataFrame:
    """(node, component) of all nodes with a link."""
    met = shelf.put(regions(cells(docs, table)))
    first = met.filter("node <> pivot").filter(
        possible(F.col("n"), F.col("place"), F.col("pivot_n"), F.col("pivot_place"))
    )
    # Cells in which a link between two members other than the pivot is possible at all.
    other = F.when(F.col("node") != F.col("pivot"), F.col("node"))
    wide = met.groupBy("cell").agg(
        F.max((F.col("place") * 7 <= F.col("n")) & other.isNotNull()).alias("front"),
        F.min(other).alias("low"),
        F.max(other).alias("high"),
    )
    wide = wide.filter("front AND low < high").select("cell")
    open_cells = (
        met.join(wide, "cell", "left_semi")
        .filter("node <> pivot")
        .groupBy("cell", "node")
        .agg(F.first("n").alias("n"), F.min("place").alias("place"), F.first("pivot").alias("pivot"))
    )
    done = shelf.put(ordered_pairs(first, "node", "pivot"))
    found = pair_distances(done, docs, bitmaps, shelf)
    components = docs.sparkSession.createDataFrame([], "node bigint, component bigint")
    if found is not None:
        components = connected_components(linked(found), shelf)
    # Drawn in an order that is the same in all cells, so cells of one group draw the same members.
    drawable = F.when(F.col("place") * 7 <= F.col("n"), F.xxhash64("node"))
    turns = Window.partitionBy("cell").orderBy(drawable.asc_nulls_last(), "node")
    open_cells = with_distance(open_cells, found)
    open_cells = still_open(open_cells, components, "max(place * 7 <= n)").withColumn(
        "turn", F.when(drawable.isNotNull(), F.row_number().over(turns))
    )
    members = shelf.put(open_cells, met, found)
    turn, more = 0, PIVOTS
    while not members.isEmpty():
        next_pairs = shelf.put(drawn_pairs(members, done, turn, turn + more))
        turn, more = turn + more, more * MORE_PIVOTS
        found = pair_distances(next_pairs, docs, bitmaps, shelf)
        if found is not None:
            known = components.select(F.col("node").alias("a"), F.col("component").alias("b"))
            before, components = (
                components,
                connected_components(linked(found).union(known), shelf),
            )
            shelf.drop(before, found)
        done = shelf.put(done.union(next_pairs), done, next_pairs)
        members = shelf.put(
            still_open(members.drop("component"), components, f"max(turn) > {turn}"), members
        )
    shelf.drop(members, done)
    return components


def with_distance(members: DataFrame, found: DataFrame | None) -> DataFrame:
    """Adds the distance to the cell's pivot where it was measured; it is over r where it was not."""
    if found is None:
        return members.withColumn("distance", F.lit(None).cast("double"))
    ratio = F.col("common") / (F.col("a_n") + F.col("b_n") - F.col("common"))
    known = found.select("a", "b", (1 - ratio).alias("distance"))
    both = known.union(known.select("b", "a", "distance")).toDF("node", "pivot", "distance")
    return members.join(both, ["node", "pivot"], "left")


def still_open(cells_: DataFrame, components: DataFrame, condition: str) -> DataFrame:
    """Rows, with their component, of cells that meet the condition and span several components."""
    named = cells_.join(components, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    still = named.groupBy("cell").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.expr(condition).alias("left")
    )
    return named.join(still.filter("low < high AND left").select("cell"), "cell", "left_semi")


def drawn_pairs(members: DataFrame, done: DataFrame, after: int, last: int) -> DataFrame:
    """(a, b) of drawn members (turns after + 1 .. last) and members of other components, not yet done.

    Pairs outside the windows of the cell's first pivot, or too different in size, are left out.
    """
    drawn = members.filter((F.col("turn") > after) & (F.col("turn") <= last)).select(
        "cell",
        *(F.col(c).alias(f"drawn_{c}") for c in ("node", "n", "place", "component", "distance")),
    )
    gap = F.abs(F.col("distance") - F.col("drawn_distance"))
    met = (
        members.join(drawn, "cell")
        .filter("component <> drawn_component")
        .filter(possible(F.col("n"), F.col("place"), F.col("drawn_n"), F.col("drawn_place")))
        .filter(F.coalesce(gap, F.lit(0.0)) <= RADIUS + 1e-9)
    )
    return ordered_pairs(met, "node", "drawn_node").join(done, ["a", "b"], "left_anti")


def jaccard_components(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per input row."""
    found = with_components(docs, id_column, text_column)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def with_components(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, n, node, component, component_id), one row per input row; empty sets have no component."""
    shelf = Shelf(docs.sparkSession)
    docs = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"))
    with lean_shuffles(docs.sparkSession):
        every = shelf.put(
            docs.mapInArrow(
                _signatures,
                "doc_id bigint, n bigint, node bigint, bits binary, chunk int, counts binary",
            )
        )
        table = common_table(every.filter("chunk IS NOT NULL").select("chunk", "counts"))
        bitmaps = shelf.put(
            every.filter("n >= 3").select("node", "n", "bits").dropDuplicates(["node"])
        )
        signed = shelf.put(every.filter("chunk IS NULL").select("doc_id", "n", "node"), every)
        components = set_links(docs, table, bitmaps, shelf)
        shelf.drop(bitmaps)
        own = signed.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
        named = own.join(components, "node", "left").withColumn(
            "component", F.coalesce("component", "node")
        )
        least = named.groupBy("component").agg(F.min("least").alias("component_id"))
        of_node = shelf.put(
            named.join(least, "component").select("node", "component", "component_id")
        )
    shelf.close(signed, of_node)
    columns = ["doc_id", "n", "node", "component", "component_id"]
    filled = signed.filter("n > 0").join(of_node, "node").select(*columns)
    empty = signed.filter("n = 0").select(
        "doc_id", "n", "node", F.lit(None).cast("bigint"), F.col("doc_id")
    )
    return filled.union(empty.toDF(*columns))


def with_node(docs: DataFrame, text_column: str) -> DataFrame:
    """``docs`` with ``_node``: the hash of the text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in pieces(batch, text_column, budget=PIECE_BYTES):
                nodes = pa.array([set_hash(s) for s in shingle_sets(texts)], pa.int64())
                yield pa.record_batch([*rows.columns, nodes], names=[*rows.schema.names, "_node"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_node", LongType())]))


def one_of_each(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row of ``docs``, all columns, of every component: one with its smallest id, null the largest.

    Documents with an empty set are components of their own. Ids tell rows apart if none is null or
    repeated; otherwise ids and sets do, and of rows with the same of both one stays. Columns may have
    any names.
    """
    found = with_components(docs, id_column, text_column)
    # Own names for the columns, so that none of the table's can clash with those made here.
    names = docs.columns
    given = docs.toDF(*[f"c{n}" for n in range(len(names))])
    own_id, own_text = (f"c{names.index(c)}" for c in (id_column, text_column))
    keys = ["component", "component_id", "doc_id", "node"]
    pairs = checkpoint(found.groupBy(*keys).agg(F.count("*").alias("rows")))
    unclear = pairs.groupBy("doc_id").agg(F.sum("rows").alias("rows"))
    if unclear.filter("doc_id IS NULL OR rows > 1").isEmpty():
        dropped = checkpoint(
            pairs.filter("doc_id <> component_id").select(F.col("doc_id").alias("_id"))
        )
        return given.join(dropped, F.col(own_id) == F.col("_id"), "left_anti").toDF(*names)
    least = pairs.filter("component IS NOT NULL").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "node")).alias("least")
    )
    named = pairs.join(least, "component")
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("node") == F.col("least.node"))
    marked = checkpoint(named.select("doc_id", "node", "rows", stays.alias("stays")))
    ends = [F.col("doc_id").alias("_id"), F.col("node").alias("_end")]
    dropped = marked.filter("NOT stays").select(*ends)
    marks = with_node(given, own_text)
    same = F.col(own_id).cast("bigint").eqNullSafe(F.col("_id")) & (F.col("_node") == F.col("_end"))
    repeated = marked.filter("stays AND rows > 1").select(*ends)
    single = marks.join(dropped.union(repeated), same, "left_anti").select(*given.columns)
    again = marks.join(repeated, same, "left_semi")
    one = again.groupBy(own_id, "_node").agg(
        F.min_by(F.struct(*given.columns), F.coalesce(own_text, F.lit(""))).alias("_row")
    )
    return single.union(one.select("_row.*")).toDF(*names)
