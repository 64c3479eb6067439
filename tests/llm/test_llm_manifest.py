"""The Merkle manifest against a plain tree on the driver, and against its SQL."""

import hashlib
import zlib
from collections import Counter, defaultdict

import check
import pytest

from jetframe.llm import merkle

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, i int, n int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, extra=0):
    doc_id, text, lang, source, n_chars = row
    if n_chars is not None:
        n_chars += extra
    fields = [doc_id, source, lang, n_chars, text]
    return h(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[k : k + 2]) for k in range(0, len(last), 2)])
    return levels


def path(levels, i):
    steps = []
    for level in levels[:-1]:
        other = i ^ 1
        steps.append((i % 2 == 1, level[other] if other < len(level) else ""))
        i //= 2
    return steps


def expected(rows):
    by_lang = defaultdict(list)
    for row in rows:
        by_lang[row[2]].append(row)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = tree([leaf(r) for r in by_lang[lang]])
    top = tree([trees[lang][-1][0] for lang in langs])
    out = Counter()
    for k, lang in enumerate(langs):
        for i, row in enumerate(by_lang[lang]):
            steps = path(trees[lang], i) + path(top, k)
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node = leaf(row, 1) if hit else leaf(row)
            for left, other in steps:
                node = h(other, node) if left else h(node, other)
            proof = h(*[other for _, other in steps])
            root = top[-1][0]
            out[(row[0], leaf(row), trees[lang][-1][0], root, proof, node, node == root)] += 1
    return out


def got(docs, levels):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(tuple(r) for r in merkle.manifest(docs, levels).select(*names).collect())


ROWS = (
    [(i, f"text {i}", "en" if i % 3 else "fr", f"src{i % 4}", i) for i in range(85)]
    + [(200, None, None, None, None), (201, "", "", "", 0), (202, "é" * 9, "zz", "s", None)]
    + [(None, "nameless", "en", "s", 3), (7, "text 7", "en", "src3", 7), (7, "other", "en", "s", 5)]
    + [(300, "x" * 300_000, "de", None, 300_000), (-5, "minus", "en", "s", 5)]
    + [(400 + i, "many", f"l{i:02d}", "s", 4) for i in range(21)]
)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_equals_a_plain_tree(spark, levels):
    docs = spark.createDataFrame([(*r, "t", 1, 2) for r in ROWS], KIND).repartition(5)
    found = got(docs, levels)
    assert found == expected(ROWS)
    assert any(not row[-1] for row in found) and any(row[-1] for row in found)


def test_every_size_of_one_tree(spark):
    for size in (1, 2, 3, 4, 5, 8, 9, 17):
        rows = [(i, f"t{i}", "en", "s", i) for i in range(size)]
        docs = spark.createDataFrame([(*r, "t", 1, 2) for r in rows], KIND)
        assert got(docs, 2) == expected(rows), size


def test_empty_table(spark):
    assert not got(spark.createDataFrame([], KIND), 6)


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    query = lambda s, d: merkle.manifest(s.read.parquet(f"{d}/documents.parquet"))
    good, text = check.compare(spark, check.duck(sf), sf, "op12", query, merkle.SQL)
    assert good, text
