"""Spelling variants against plain loops, the bit slices against all pairs, and the query against its SQL."""

import random
import re
import zlib
from collections import Counter

import check
import numpy as np
import pytest

from jetframe.llm import spelling
from jetframe.session import Shelf

KIND = "doc_id bigint, text string, word string, n bigint, block string, c int, lo int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def expected(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [x for x in words if one_apart(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = Counter()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[(w, form[w], root, words[w], len(near[w]), words.get(form[w]))] += 1
    return out


def corpus():
    rng = random.Random(5)
    bases = ["colour", "labelled", "aaaaa", "bbbbbbbb", "êtreétait", "nächste", "x×y÷zabc", "thing"]
    pool = []
    for base in bases:
        pool += [base] * 40
        for _ in range(12):
            k = rng.randrange(len(base) + 1)
            letter = rng.choice("abcdezéÿ")
            made = rng.choice([base[:k] + letter + base[k:], base[:k] + letter + base[k + 1 :], base[:k] + base[k + 1 :]])
            pool += [made] * rng.choice([3, 4, 9])
            k = rng.randrange(len(made) + 1)
            pool += [made[:k] + rng.choice("ae") + made[k:]] * 3
    rng.shuffle(pool)
    rows = [(k, ", ".join(w.upper() if n % 5 == 0 and w.isascii() else w for n, w in enumerate(pool[k::40]))) for k in range(40)]
    rows += [(100, None), (101, ""), (102, "12 34 _"), (None, "colour colour thing-thing"), (7, "thing"), (7, "thing")]
    rows += [(110 + k, "q" * 50_000 + " " + "q" * 49_999 + "z " + "q" * 49_999) for k in range(3)]
    return rows


@pytest.mark.parametrize("block, batch", [(1024, 2048), (6, 8)])
def test_spelling_equals_plain_loops(spark, monkeypatch, block, batch):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "BATCH", batch)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "w", 1, "b", 2, 3) for i, t in rows], KIND).repartition(4)
    got = Counter(tuple(r) for r in spelling.spelling(docs).select(
        "word", "form", "root", "n", "n_near", "form_n").collect())
    want = expected(rows)
    assert got == want
    assert any(w != r and f != r for w, f, r, *_ in want), "a chain of two steps"


def test_blocks_are_split_until_they_fit(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 10)
    rng = random.Random(1)
    words = {"common" + "".join(rng.choice("ab") for _ in range(7)) for _ in range(400)}
    words |= {w + rng.choice("ab") for w in list(words)[:80]}
    table = spark.createDataFrame([(w, 3) for w in sorted(words)], "word string, n bigint")
    shelf = Shelf(spark)
    for part in spelling.blocks(table, shelf):
        row = part.selectExpr("max(if(hi - lo > 1, members, 0)) AS wide", "max(members) AS every").first()
        assert (row["wide"] or 0) <= 10 and (row["every"] or 0) <= 2 * 91
    pairs = Counter(tuple(r)[:2] for r in spelling.near_words(table, shelf).collect())
    shelf.close()
    assert pairs == Counter((a, b) for a in words for b in words if one_apart(a, b))


def test_bit_slices_equal_all_pairs():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.choice([5, 6]))) for _ in range(700)})
    block = np.zeros(len(words), dtype=np.int64)
    rows, others, same = spelling.one_edit(words, [""] * len(words), np.full(len(words), 6), block)
    got = Counter(zip(rows.tolist(), others.tolist(), same.tolist(), strict=True))
    want = Counter(
        (a, b, len(words[b]) == 6)
        for a in range(len(words))
        for b in range(len(words))
        if len(words[a]) == 6 and one_apart(words[a], words[b])
    )
    assert got == want


def test_empty_table(spark):
    assert spelling.spelling(spark.createDataFrame([], KIND)).count() == 0


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    query = lambda s, d: spelling.spelling(s.read.parquet(f"{d}/documents.parquet"))
    good, text = check.compare(spark, check.duck(sf), sf, "op11", query, spelling.SQL)
    assert good, text
