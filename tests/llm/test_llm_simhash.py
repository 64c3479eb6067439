"""SimHash fingerprints and components against plain loops over all pairs."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from jetframe.llm import simhash
from jetframe.session import Shelf

KIND = "doc_id bigint, text string, fp string, part int, key string, n int, component int"


def plain_print(text):
    words = (text or "").encode().translate(simhash.LOWER_BYTES).split()
    if not words:
        return 0
    size = min(3, len(words))
    hashes = [
        xxhash.xxh64_intdigest(b" ".join(words[k : k + size]), 42)
        for k in range(len(words) - size + 1)
    ]
    return sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hashes) > len(hashes))


def components(prints):
    """Smallest index reached by every index."""
    parent = list(range(len(prints)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(a) for a in range(len(prints))]


def expected(rows):
    prints = [plain_print(t) for _, t in rows]
    found = components(prints)
    least = {}
    for (doc_id, _), c in zip(rows, found, strict=True):
        if doc_id is not None:
            least[c] = min(least.get(c, doc_id), doc_id)
    return Counter(
        (doc_id, f"{p:016x}", least.get(c))
        for (doc_id, _), p, c in zip(rows, prints, found, strict=True)
    )


def test_simhash_equals_plain_loops(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for n in range(160):
        text = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 40, 300]))]
        rows.append((n, " ".join(text)))
        for copy in range(n % 4):
            changed = list(text)
            if len(changed) > 20:
                changed[rng.randrange(len(changed))] = "Changed"
            rows.append((1000 + 10 * n + copy, "\t ".join(changed).upper()))
    rows += [(5000, None), (5001, ""), (5002, " \n\t"), (None, rows[0][1]), (None, "all alone here")]
    rows += [(3, rows[3][1]), (3, rows[3][1]), (3, "other text with the same id")]
    rows += [(6000, "é É ç"), (6001, "É é ç"), (6002, "a b c d"), (6003, "long " * 100_000)]
    rows += [(6004, " ".join(f"x{k % 9973}" for k in range(150_000)))]
    docs = spark.createDataFrame([(i, t, "f", 1, "k", 2, 3) for i, t in rows], KIND).repartition(4)
    got = Counter(tuple(r) for r in simhash.simhash(docs).collect())
    assert got == expected(rows)


def test_empty_table(spark):
    assert simhash.simhash(spark.createDataFrame([], KIND)).count() == 0


@pytest.mark.parametrize("crowd", [0, 600, 3000])
def test_links_of_crowded_and_spread_fingerprints(spark, crowd):
    """A ball of near copies shares all cells; its members take the whole fingerprint as partition."""
    rng = np.random.default_rng(crowd)
    prints = set(rng.integers(-(2**63), 2**63, 1500).tolist())
    centre = int(rng.integers(-(2**63), 2**63))
    while len(prints) < 1500 + crowd:
        flips = rng.choice(24, size=int(rng.integers(0, 7)), replace=False)
        prints.add(centre ^ simhash.signed_mask([int(b) for b in flips]))
    for value in list(prints)[:200]:
        flips = rng.choice(64, size=int(rng.integers(1, 5)), replace=False)
        prints.add(value ^ simhash.signed_mask([int(b) for b in flips]))
    prints = sorted(prints)
    shelf = Shelf(spark)
    table = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    pairs = [tuple(r) for r in simhash.links(table, shelf).distinct().collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in pairs)
    place = {p: k for k, p in enumerate(prints)}
    parent = list(range(len(prints)))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in pairs:
        x, y = find(place[a]), find(place[b])
        parent[max(x, y)] = min(x, y)
    values = np.array(prints, dtype=np.int64).view(np.uint64)
    want = list(range(len(prints)))

    def root(a):
        while want[a] != a:
            want[a] = want[want[a]]
            a = want[a]
        return a

    for a in range(len(values)):
        for b in np.flatnonzero(np.bitwise_count(values[:a] ^ values[a]) <= 2).tolist():
            x, y = root(a), root(b)
            want[max(x, y)] = min(x, y)
    assert [find(k) for k in range(len(prints))] == [root(k) for k in range(len(prints))]
    shelf.close()


def test_thresholds_spend_three_at_least_cost():
    rng = np.random.default_rng(1)
    members = rng.integers(1, 300, (200, 4))
    widths, mean = np.array([16] * 4), np.array([2.0, 5.0, 1.0, 9.0])
    found, cost = simhash.thresholds(members, widths, mean)
    assert ((found + 1).sum(axis=1) == 3).all()
    import itertools

    for row in range(200):
        options = []
        for t in itertools.product(range(3), repeat=4):
            if sum(t) == 3:
                prices = [
                    (0, 1 + members[row, k], 1 + members[row, k] + 16 * (1 + mean[k]))[t[k]]
                    for k in range(4)
                ]
                options.append(sum(prices))
        assert cost[row] == pytest.approx(min(options))


def test_correlated_bits_share_a_partition():
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 2, (4000, 64))
    bits[:, [5, 20, 41, 63]] = bits[:, [5]]
    both = bits.T @ bits
    groups = simhash.group_bits(simhash.correlations(both, len(bits)), 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert any({5, 20, 41, 63} <= set(g) for g in groups)
