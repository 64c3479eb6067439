"""Exact dedup, Jaccard join, components and sharding against brute force on small tables."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from jetframe.llm import exact_dedup, jaccard_join, sharding
from jetframe.llm.components import connected_components
from jetframe.session import Shelf

KIND = "doc_id bigint, text string, digest string, place int, node long, cell int, row string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "d", 1, 2, 3, "r") for i, t in rows], KIND).repartition(3)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("support", [0.001, 0.2, 0.5])
def test_exact_dedup(spark, support):
    rows = [(n, "Hot Text" if n % 3 else "hot text") for n in range(60)]
    rows += [(100, "É"), (101, "é"), (102, None), (103, ""), (None, "alone"), (None, "hot TEXT")]
    rows += [(104, "same"), (104, "same"), (105, "x" * 100_000), (106, "X" * 100_000)]
    got = exact_dedup.exact_dedup(table(spark, rows), support=support).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()].append(i)
    assert len(got) == len(rows)
    kept = Counter()
    for r in got:
        ids = groups[r["text_sha256"]]
        largest = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"]) == (largest, len(ids))
        if r["kept"]:
            assert r["doc_id"] == largest
            kept[r["text_sha256"]] += 1
    assert kept == Counter(dict.fromkeys(groups, 1))


def test_dedup_rows_keeps_columns(spark):
    docs = table(spark, [(1, "a"), (2, "A"), (2, "a"), (3, None), (4, "")])
    out = exact_dedup.dedup_rows(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [2, 4]
    empty = docs.limit(0)
    assert exact_dedup.dedup_rows(empty).count() == exact_dedup.exact_dedup(empty).count() == 0


def brute_components(rows):
    sets = []
    for _, t in rows:
        words = [w for w in (t or "").translate(LOWER).split() if w]
        if len(words) < 5:
            sets.append({tuple(words)} if words else set())
        else:
            sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)})
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * union:
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[find(a)] = min(least.get(find(a), i), i)
    return Counter((i, len(sets[a]), least[find(a)]) for a, (i, _) in enumerate(rows))


def mutated(rng, words, share):
    return [f"n{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_components(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PIVOTS", 1)  # several rounds on small cells
    monkeypatch.setattr(jaccard_join, "MORE_PIVOTS", 2)
    rng = random.Random(seed)
    passage = [f"p{n}" for n in range(60)]
    rows = []
    for _ in range(12):  # families whose members drift apart, linked in chains or not at all
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([6, 9, 30, 150]))]
        for _ in range(rng.choice([1, 2, 6])):
            words = mutated(rng, words, rng.choice([0.005, 0.02, 0.06]))
            rows.append(" ".join(words))
    base = [f"b{n}" for n in range(120)]
    rows += [" ".join(mutated(rng, base, 0.02)) for _ in range(25)]
    rows += [" ".join(passage + [f"o{n}-{k}" for k in range(15)]) for n in range(10)]
    rows += [" ".join(passage), "The End", "the END", "a b c d e", "a b c d e f g", "x", "x"]
    rows += [None, "", " \t\n", "rep " * 3000, rows[0], rows[0].upper()]
    ids = rng.sample(range(1000), len(rows))
    rows = list(zip(ids, rows, strict=True))
    rows.append(rows[3])
    got = jaccard_join.jaccard_components(table(spark, rows))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(tuple(r) for r in got.collect()) == brute_components(rows)


def test_jaccard_edges(spark):
    docs = table(spark, [(None, "a b c d e f"), (7, "A b c d e f"), (8, None), (9, "")])
    got = {tuple(r) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {(None, 2, 7), (7, 2, 7), (8, 0, 8), (9, 0, 9)}
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0
    kept = jaccard_join.one_of_each(table(spark, [(1, "a b c d e"), (2, "a b c d E"), (3, None)]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    assert len(kept.columns) == 7


def test_one_of_each_with_shared_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (5, "A b c d e f"), (5, "a clean row of its own"), (5, "")]
    rows += [(7, "two near copies under one"), (7, "Two near copies under one")]
    rows += [(None, "null ids have near copies"), (None, "Null ids have near copies"), (None, None)]
    rows += [(None, "a B c d e f")]
    kept = jaccard_join.one_of_each(table(spark, rows))
    found = Counter((r["doc_id"], (r["text"] or "").lower()) for r in kept.collect())
    wanted = [rows[0], rows[2], rows[3], rows[4], rows[6], (None, "")]
    assert found == Counter(wanted) and len(kept.columns) == 7


def test_one_of_each_keeps_columns_of_any_name(spark):
    kind = "_id int, doc_id bigint, text string, _node string, _row int, _end int, c0 int, component long"
    rows = [(1, 1, "a b c d e f"), (2, 5, "A b c d e f"), (3, 5, "a clean row of its own"), (4, None, None)]
    for some in (rows, rows[:1] + rows[2:3]):
        docs = spark.createDataFrame([(*r, "n", 4, 5, 6, 7) for r in some], kind)
        kept = jaccard_join.one_of_each(docs)
        assert kept.columns == docs.columns
        assert {r["_id"] for r in kept.collect()} == {r[0] for r in some} - {2}


def test_prefix_length_covers_all_links():
    for n in range(1, 400):
        least = -(-n * 75 // 100)
        assert jaccard_join.prefix_length(n) == n - least + 1


def test_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 100 + k) for k in range(1, 200)]
    links += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    parent = {n: n for pair in links for n in pair}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    frame = spark.createDataFrame([p if k % 2 else p[::-1] for k, p in enumerate(links)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(frame, Shelf(spark)).collect()}
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}
    assert connected_components(frame.limit(0), Shelf(spark)).count() == 0


def test_shard_table():
    names = tuple(f"s{n}" for n in range(7))
    owner = sharding.fill_table(names, 1009)
    counts = Counter(owner.tolist())
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.fill_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(owner, fewer, strict=True) if a != 6)
    assert moved < 0.1 * 1009
    for names_, size in ((("a", "a"), 7), ((), 7), (("a",), 8), (("a", "b"), 1)):
        with pytest.raises(ValueError):
            sharding.fill_table(names_, size)


def test_shard_table_by_turns():
    """Brute force: whole permutations, and turns over them."""
    names, size = ("x", "y", "z"), 31
    walks = []
    for n in names:
        offset, skip = (sharding._number(n, p) for p in ("offset", "skip"))
        walks.append([(offset + k * (skip % (size - 1) + 1)) % size for k in range(size)])
    owner = {}
    turn = 0
    while len(owner) < size:
        walk = walks[turn % 3]
        owner[next(s for s in walk if s not in owner)] = turn % 3
        turn += 1
    assert sharding.fill_table(names, size).tolist() == [owner[s] for s in range(size)]


def test_assign_shards(spark):
    docs = table(spark, [(n, None) for n in range(2000)] + [(None, "a"), (5, "b")])
    names = tuple("abcde")
    got = sharding.assign_shards(docs, names, 10_007)
    rows = got.collect()
    owner = sharding.fill_table(names, 10_007)
    assert len(rows) == 2002 and all(owner[r["slot"]] == r["shard"] for r in rows)
    assert all(names[r["shard"]] == r["shard_name"] for r in rows)
    assert len({r["shard"] for r in rows if r["doc_id"] == 5}) == 1
    slots = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(10_007)).alias("s"))
    assert sorted(r["s"] for r in slots.collect()) == sorted(r["slot"] for r in rows)
    assert sharding.assign_shards(docs.limit(0)).count() == 0


def test_counting_tables():
    for share in (0.001, 0.5):
        rng = np.random.default_rng(1)
        counts = np.where(rng.random(jaccard_join.CHUNK) < share, rng.integers(1, 99, jaccard_join.CHUNK), 0)
        assert (jaccard_join.unpacked(jaccard_join.packed(counts)) == counts).all()
    assert not jaccard_join.unpacked(jaccard_join.packed(np.zeros(jaccard_join.CHUNK, int))).any()


def test_bitmaps_bound_intersections():
    rng = np.random.default_rng(2)
    for _ in range(300):
        whole = rng.integers(0, 2**63, rng.integers(3, 900), dtype=np.uint64)
        x = np.unique(whole[rng.random(len(whole)) < 0.9])
        y = np.unique(np.concatenate([whole[rng.random(len(whole)) < rng.random()], rng.integers(0, 2**63, 5, dtype=np.uint64)]))
        common = len(np.intersect1d(x, y))
        bound = jaccard_join.most_common(len(x), jaccard_join.bitmap(x), len(y), jaccard_join.bitmap(y))
        assert common <= bound <= min(len(x), len(y))
