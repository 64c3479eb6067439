"""Spelling variants of a corpus vocabulary: words one edit apart, by a bit-sliced position index.

Runs of ``[A-Za-z\\u00C0-\\u00FF]`` are taken from whole texts and A-Z lower-cased. One in 97 runs (by crc32 of
``<doc_id>:<run>``) loses one code point. Words are the results of at least five code points that occur at
least three times. Two words are near if they differ by exactly one inserted, deleted or replaced code
point. A word's form is its near word with the largest count (ties: first in code-point order), if that is
at least twice its own; its root is where forms lead to.

1. *Count.* Tasks count words in a table of bounded size before the shuffle.
2. *Blocks.* Take a pair whose longer word has C code points: its edit is in the first or in the second half
   of these, so the words agree outside that half. A word stands in the classes C = its length and one
   more, and there in a block for each window [lo, hi) of edit places: (C, lo, hi, what is before lo, what is
   after hi). Every near pair meets in exactly one block in which it counts, that of its first differing
   place. Blocks with one word go. Blocks of over ``BLOCK`` words, or with windows too wide, are split
   into the two halves of their window, until they fit: a window of one place has words that differ in one
   letter only, so it can hold no more words than there are letters. No block is cut.
3. *Bit slices.* A task puts whole blocks together into batches. For each (place in the window, letter) the
   index has the set of the batch's words with this letter there, as a bit row. All words of a batch are
   looked up at once: for place k, Z is the set of words that agree so far, S of those with one letter
   replaced, D of those that lack one letter; with M[k] the row of the word's letter at k,

       D = D & M[k-1] | Z & ~M[k]        S = S & M[k] | Z & ~M[k]        Z = Z & M[k]

   so 64 words are compared by one operation. Z starts as the words of the own block, and a letter is
   dropped only where the words first differ, so every pair is found once.
4. *Forms.* Counts travel with the words; the best near word is an aggregation. Roots follow by pointer
   doubling over (word, form): counts at least double with every step, so a few rounds are enough.

A null text has no words; a null doc_id counts as the empty text in ``<doc_id>:<run>``. Repeated rows count
as often as they stand there. Ties go by code-point order. An empty table gives an empty result; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from jetframe.llm.texts import LOWER, pieces
from jetframe.session import Shelf, lean_shuffles

RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
LOWER_BYTES = LOWER.tobytes()
DELETE_MODULUS = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
HELD_WORDS = 1 << 16
LONG_TEXT = 1 << 20
BLOCK = 1024
BATCH = 2048
WIDTH = 32


def text_words(doc_id: int | None, text: bytes) -> Counter[bytes]:
    """Counts of the words of one text, after deletions; only those long enough."""
    lowered = text.translate(LOWER_BYTES)
    if len(lowered) < LONG_TEXT:
        runs = Counter(RUN.findall(lowered))
    else:
        runs = Counter(found.group() for found in RUN.finditer(lowered))
    head = (b"" if doc_id is None else b"%d" % doc_id) + b":"
    start = crc32(head)
    words: Counter[bytes] = Counter()
    for run, count in runs.items():
        hashed = crc32(run, start)
        if hashed % DELETE_MODULUS == 0:
            letters = run.decode()
            at = hashed % len(letters)
            run = (letters[:at] + letters[at + 1 :]).encode()
        # Letters beyond ASCII have two bytes, the first of them 0xC3.
        if len(run) - run.count(b"\xc3") >= LEAST_LENGTH:
            words[run] += count
    return words


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        words = pa.array(list(held), pa.binary()).cast(pa.string())
        counts = pa.array(list(held.values()), pa.int64())
        held.clear()
        return pa.record_batch([words, counts], names=["word", "n"])

    for batch in batches:
        for rows, texts in pieces(batch):
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), texts, strict=True):
                held.update(text_words(doc_id, text))
                if len(held) > HELD_WORDS:
                    yield flush()
    if held:
        yield flush()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of at least five code points with at least three occurrences."""
    counted = docs.select("doc_id", "text").mapInArrow(_counted, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def windows(rows: DataFrame, pairs: list[tuple[Column, Column]]) -> DataFrame:
    """A row per word and window (lo, hi) of its class, with the hash of the block.

    ``after`` is the letter behind the window, which all words of a block share; empty at the end.
    """
    each = rows.withColumn(
        "window", F.explode(F.array(*[F.struct(a.alias("lo"), b.alias("hi")) for a, b in pairs]))
    ).select("word", "n", "c", "window.lo", "window.hi")
    tail = F.col("c") - F.col("hi")
    length = F.char_length("word")
    head = F.substring("word", F.lit(1), F.col("lo"))
    rest = F.when(tail > 0, F.right("word", tail)).otherwise("")
    middle = F.substring("word", F.col("lo") + 1, length - F.col("lo") - tail)
    return each.select(
        "word",
        "n",
        "c",
        "lo",
        "hi",
        middle.alias("middle"),
        F.substring(rest, 1, 1).alias("after"),
        F.xxhash64("c", "lo", "hi", head, rest).alias("block"),
    )


def blocks(words: DataFrame, shelf: Shelf) -> list[DataFrame]:
    """Tables of words by block, all blocks with two words or more and none too large."""
    length = F.char_length("word")
    classes = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("c"))
    half = F.floor(F.col("c") / 2).cast("int")
    current = windows(classes, [(F.lit(0), half), (half, F.col("c"))])
    found = []
    while True:
        sizes = current.groupBy("block").agg(F.count("*").alias("members")).filter("members > 1")
        table = shelf.put(current.join(sizes, "block"))
        width = F.col("hi") - F.col("lo")
        large = ((F.col("members") > BLOCK) | (width > WIDTH)) & (width > 1)
        found.append(table.filter(~large))
        over = table.filter(large)
        if over.isEmpty():
            return found
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        current = windows(over, [(F.col("lo"), middle), (middle, F.col("hi"))])


def letter_table(middles: list[str], after: list[str]) -> tuple[np.ndarray, int]:
    """(words, places) dense numbers of the letters, 0 where there is none; and how many numbers."""
    shown = [m + a for m, a in zip(middles, after, strict=True)]
    sizes = np.fromiter(map(len, shown), np.int64, len(shown))
    points = np.frombuffer("".join(shown).encode("utf-32-le"), dtype="<u4")
    letters, dense = np.unique(points, return_inverse=True)
    table = np.zeros((len(shown), int(sizes.max(initial=0)) + 1), dtype=np.int64)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    table[np.repeat(np.arange(len(shown)), sizes), np.arange(len(points)) - first] = dense + 1
    return table, len(letters) + 1


def bit_rows(members: np.ndarray) -> np.ndarray:
    """(rows, words / 64): a boolean table as rows of 64-bit numbers."""
    lacking = -members.shape[-1] % 64
    padded = np.pad(members, [(0, 0)] * (members.ndim - 1) + [(0, lacking)])
    return np.packbits(padded, axis=-1, bitorder="little").view("<u8")


def set_bits(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bit) of all bits set."""
    row, column = np.nonzero(found)
    bits = np.unpackbits(found[row, column].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, bit = np.nonzero(bits)
    return row[at], column[at] * 64 + bit


def one_edit(
    middles: list[str], after: list[str], width: np.ndarray, block: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(longer or equal word, other, same length) of all pairs of a batch that are one edit apart.

    ``width`` is that of the word's window; a middle is as long, or shorter by one letter.
    """
    table, letters = letter_table(middles, after)
    size = np.fromiter(map(len, middles), np.int64, len(middles))
    full = size == width
    queries = np.flatnonzero(full)
    queries = queries[np.argsort(-width[queries], kind="stable")]
    if not len(queries):
        return queries, queries, queries.astype(bool)
    _, number = np.unique(block, return_inverse=True)
    own = bit_rows(number[None, :] == np.arange(number.max() + 1)[:, None])
    same = own[number[queries]]
    replaced, lacking = np.zeros_like(same), np.zeros_like(same)
    before = None
    for k in range(int(width[queries[0]])):
        # Words with wider windows come first: the others are finished.
        live = int(np.searchsorted(-width[queries], -k, side="left"))
        index = bit_rows(table[:, k][None, :] == np.arange(letters)[:, None])
        asked = table[queries[:live], k]
        match = index[asked]
        parted = same[:live] & ~match
        kept = lacking[:live] & before[asked] if before is not None else np.uint64(0)
        lacking[:live] = kept | parted
        replaced[:live] = (replaced[:live] & match) | parted
        same[:live] &= match
        before = index
    long, short = bit_rows(full[None, :])[0], bit_rows(~full[None, :])[0]
    pairs = [(*set_bits(replaced & long), True), (*set_bits(lacking & short), False)]
    rows = np.concatenate([queries[r] for r, _, _ in pairs])
    others = np.concatenate([o for _, o, _ in pairs])
    return rows, others, np.repeat([True, False], [len(pairs[0][0]), len(pairs[1][0])])


def _agree(word: str, other: str, lo: int, hi: int, c: int) -> bool:
    """Whether the words are equal outside the window (their block is known by a hash only)."""
    tail = c - hi
    return word[:lo] == other[:lo] and word[len(word) - tail :] == other[len(other) - tail :]


def _near(batch: pa.Table) -> pa.RecordBatch:
    word, middle = batch.column("word").to_pylist(), batch.column("middle").to_pylist()
    lo, hi, c, n = (batch.column(k).to_numpy() for k in ("lo", "hi", "c", "n"))
    rows, others, same = one_edit(
        middle, batch.column("after").to_pylist(), hi - lo, batch.column("block").to_numpy()
    )
    sure = np.fromiter(
        (
            _agree(word[a], word[b], int(lo[a]), int(hi[a]), int(c[a]))
            for a, b in zip(rows.tolist(), others.tolist(), strict=True)
        ),
        bool,
        len(rows),
    )
    rows, others, same = rows[sure], others[sure], same[sure]
    # Words of equal length find each other; a longer word speaks for the shorter one too.
    left = np.concatenate([rows, others[~same]])
    right = np.concatenate([others, rows[~same]])
    words = pa.array(word, pa.string())
    return pa.record_batch(
        [words.take(pa.array(left)), words.take(pa.array(right)), pa.array(n[right])],
        names=["word", "near", "near_n"],
    )


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole blocks (rows come sorted by block), together at least ``BATCH`` rows where there are as many."""
    waiting: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        waiting = rows if waiting is None else pa.concat_tables([waiting, rows])
        block = waiting.column("block").to_numpy()
        ends = np.flatnonzero(block[1:] != block[:-1]) + 1
        start = 0
        while len(ends) and ends[-1] - start >= BATCH:
            end = int(ends[np.searchsorted(ends, start + BATCH)])
            yield waiting.slice(start, end - start)
            start = end
        waiting = waiting.slice(start)
    if waiting is not None and waiting.num_rows:
        yield waiting


def near_words(words: DataFrame, shelf: Shelf) -> DataFrame:
    """(word, near, near_n) of all near pairs, each in both directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            yield _near(batch)

    columns = ["block", "word", "n", "c", "lo", "hi", "middle", "after"]
    every = None
    for table in blocks(words, shelf):
        part = table.select(*columns)
        every = part if every is None else every.union(part)
    dealt = every.repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(run, "word string, near string, near_n bigint")


def roots(forms: DataFrame, shelf: Shelf) -> DataFrame:
    """(word, root) of all words with a form: ``forms`` (word, form) followed to the end."""
    now = shelf.put(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        seen = Observation()
        moved = now.join(onward, "root", "left").observe(
            seen, F.count("further").alias("moved")
        )
        now = shelf.put(
            moved.select("word", F.coalesce("further", "root").alias("root")), now
        )
        if not seen.get["moved"]:
            return now


def spelling(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word."""
    shelf = Shelf(docs.sparkSession)
    given = docs.select(docs[id_column].cast("bigint").alias("doc_id"), docs[text_column].alias("text"))
    with lean_shuffles(docs.sparkSession):
        words = shelf.put(vocabulary(given))
        best = near_words(words, shelf).groupBy("word").agg(
            F.count("*").alias("n_near"),
            F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best"),
        )
        form_n = -F.col("best.order")
        enough = form_n >= 2 * F.col("n")
        formed = shelf.put(
            words.join(best, "word", "left").select(
                "word",
                "n",
                F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                F.when(enough, F.col("best.near")).alias("form"),
                F.when(enough, form_n).cast("bigint").alias("form_n"),
            )
        )
        ends = roots(formed.filter("form IS NOT NULL").select("word", "form"), shelf)
    shelf.close(formed, ends)
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


#: Near words over the words with one letter taken out; crc32 bit by bit.
SQL = """
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[a-zÀ-ÿ]+')) AS run FROM documents)
  GROUP BY ALL
), bits AS (
  SELECT run, n, encode(coalesce(doc_id::VARCHAR, '') || ':' || run)::BIT::VARCHAR AS bits FROM runs
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(length(bits)),
      lambda p: substr(bits, (p // 8) * 8 + 8 - p % 8, 1)::BIGINT)),
    lambda c, b: xor(c >> 1, CASE WHEN (xor(c, b) & 1) = 1 THEN 3988292384 ELSE 0 END))) AS h
  FROM bits
), changed AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
         ELSE run END AS word, n
  FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n, length(word) AS size FROM changed WHERE length(word) >= 5
  GROUP BY word HAVING sum(n) >= 3
), without AS (
  SELECT word, n, size, p, substr(word, 1, p) || substr(word, p + 2) AS rest
  FROM words, unnest(range(size)) AS places(p)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM without a JOIN without b
  ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM without a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM without a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, min({'order': -near_n, 'near': near}) AS best FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN -best['order'] >= 2 * w.n THEN best['near'] END AS form,
         CASE WHEN -best['order'] >= 2 * w.n THEN -best['order'] END AS form_n
  FROM words w LEFT JOIN best USING (word)
), steps AS (
  SELECT word, word AS root, 0 AS step FROM formed
  UNION ALL
  SELECT s.word, f.form, step + 1 FROM steps s JOIN formed f ON f.word = s.root
  WHERE f.form IS NOT NULL
), ends AS (SELECT word, arg_max(root, step) AS root FROM steps GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""
