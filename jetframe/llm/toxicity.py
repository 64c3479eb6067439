"""Toxicity from a weighted lexicon matched by Aho-Corasick.

Folding: lower case, look-alike letters of other scripts and digit substitutions become Latin letters,
in learning and in matching alike.

Learning, from at most ``SAMPLE_ROWS`` labelled documents outside the held-out part:
1. Terms are beginnings of words (3 to 16 letters, so stems match with any ending). Their weight is the
   smoothed log odds between toxic and clean documents. A term is dropped for a longer one found in as
   many toxic documents, and for a shorter one with as good a weight. Terms are then taken one by one
   by the toxic documents they explain; a document counts half for each word of it that is already
   explained, so words that merely share documents (or copies of one) with toxic ones drop out.
2. Exception phrases are pairs of neighbouring words, one of them a match, that occur in clean documents
   and in no toxic one. A match inside such a phrase does not count.
3. Weights of all matches, over the root of the length, are calibrated by a logistic curve.

Documents of the sample are learned from whole, as all texts are scored whole. An empty or null text has no match and the base score. Repeated rows are
scored alike; an empty table gives an empty result; without labels of both kinds there is no term and
every score is the share of toxic labels (0 without labels). Further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jetframe.llm.texts import labelled_sample, pieces, remainder
from jetframe.session import Shelf

SAMPLE_ROWS = 10_000
MODULUS, HELD = 5, 0
MIN_TERM, MAX_TERM = 3, 16
MIN_SHARE = 0.01
MIN_DOCUMENTS = 4
MIN_WEIGHT = 1.5
SAME_TERM = 0.95
LENGTH_UNIT = 1_000.0

DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a"}
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѐ": "e", "һ": "h", "і": "i", "ї": "i",
    "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t",
    "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ϲ": "c",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l", "ո": "n", "ս": "u", "օ": "o",
}
FOLD = str.maketrans(
    DIGITS
    | LOOKALIKES
    | {chr(0xFF41 + n): chr(97 + n) for n in range(26)}
    | {chr(0x1D41A + n): chr(97 + n) for n in range(26)}
    | dict.fromkeys("­​‌‍⁠﻿", "")
)
WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    return text.lower().translate(FOLD)


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    slope: float = 0.0
    offset: float = -math.inf

    def automaton(self):
        machine = ahocorasick.Automaton()
        for term in self.weights:
            machine.add_word(term, term)
        machine.make_automaton()
        return machine


def matches(folded: str, machine) -> list[tuple[str, str, str]]:
    """(term, phrase with the word before, phrase with the word after) of each match at a word start."""
    best: dict[int, str] = {}
    for end, term in machine.iter(folded):
        start = end - len(term) + 1
        if start == 0 or not folded[start - 1].isalpha():
            best[start] = term  # ends ascend: the longest term at this start is the last
    out = []
    for start, term in best.items():
        end = start + len(term)
        while end < len(folded) and folded[end].isalpha():
            end += 1
        word = folded[start:end]
        out.append((term, f"{_before(folded, start)} {word}", f"{word} {_after(folded, end)}"))
    return out


def _before(text: str, start: int) -> str:
    """The nearest word before ``start``, whole, however far it is."""
    end = start
    while end > 0 and not text[end - 1].isalpha():
        end -= 1
    first = end
    while first > 0 and text[first - 1].isalpha():
        first -= 1
    return text[first:end]


def _after(text: str, end: int) -> str:
    """The nearest word from ``end`` on, whole."""
    first = end
    while first < len(text) and not text[first].isalpha():
        first += 1
    last = first
    while last < len(text) and text[last].isalpha():
        last += 1
    return text[first:last]


def raw_score(folded: str, model: Model, machine) -> float:
    if not model.weights or not folded:
        return 0.0
    total = sum(
        model.weights[term]
        for term, before, after in matches(folded, machine)
        if before not in model.exceptions and after not in model.exceptions
    )
    return total / math.sqrt(1.0 + len(folded) / LENGTH_UNIT)


def probability(raw: float, model: Model) -> float:
    if model.offset == -math.inf:
        return 0.0
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, model.offset + model.slope * raw))))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in pieces(batch):
            counted = (Counter(), Counter())
            for label, text in zip(rows.column("label").to_pylist(), texts, strict=True):
                terms = set()
                for word in set(WORD.findall(fold(text.decode()))):
                    terms.update(
                        word[:n] for n in range(MIN_TERM, min(len(word), MAX_TERM) + 1)
                    )
                counted[label > 0].update(terms)
            terms = list(counted[0] | counted[1])
            yield pa.record_batch(
                [
                    pa.array(terms, pa.string()),
                    pa.array([counted[1][t] for t in terms], pa.int64()),
                    pa.array([counted[0][t] for t in terms], pa.int64()),
                ],
                names=["term", "toxic", "clean"],
            )


def lexicon(sample: DataFrame, toxic_docs: int, clean_docs: int) -> dict[str, float]:
    """Weights of all terms that enough toxic documents have and few clean ones; counted on the executors.

    Their number is bounded by the words of the sample over ``least``.
    """
    least = max(MIN_DOCUMENTS, MIN_SHARE * toxic_docs)
    weight = F.log((F.col("toxic") + 0.5) / (toxic_docs + 1)) - F.log(
        (F.col("clean") + 0.5) / (clean_docs + 1)
    )
    rows = (
        sample.mapInArrow(_term_counts, "term string, toxic bigint, clean bigint")
        .groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter(F.col("toxic") >= least)
        .withColumn("weight", weight)
        .filter(F.col("weight") >= MIN_WEIGHT)
        .collect()
    )
    toxic = {r["term"]: r["toxic"] for r in rows}
    for term, number in list(toxic.items()):
        for n in range(MIN_TERM, len(term)):
            if number >= SAME_TERM * toxic.get(term[:n], math.inf):
                toxic[term[:n]] = math.inf  # the longer term says the same and is more specific
    weights: dict[str, float] = {}
    for row in sorted(rows, key=lambda r: (len(r["term"]), r["term"])):
        term = row["term"]
        shorter = (weights.get(term[:n], -math.inf) for n in range(MIN_TERM, len(term)))
        if toxic[term] < math.inf and max(shorter, default=-math.inf) < row["weight"] - 0.5:
            weights[term] = float(row["weight"])
    return weights


def _toxic_words(sample: DataFrame, weights: dict[str, float]) -> list[list[tuple[int, int]]]:
    """Of each toxic document: (index of the sorted terms, different words it matches in the whole text).

    Bounded by the rows of the sample and the number of terms.
    """
    index = {t: n for n, t in enumerate(sorted(weights))}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Model(weights).automaton()
        for batch in batches:
            for _, texts in pieces(batch):
                found = []
                for text in texts:
                    hits = matches(fold(text.decode()), machine) if text else []
                    words = {(t, after.split(" ")[0]) for t, _, after in hits}
                    found.append(list(Counter(index[t] for t, _ in words).items()))
                pairs = [[list(p) for p in f] for f in found]
                yield pa.record_batch([pa.array(pairs, KIND)], names=["found"])

    toxic = sample.filter("label > 0").select("text")
    return [r["found"] for r in toxic.mapInArrow(find, "found array<array<int>>").collect()]


KIND = pa.list_(pa.list_(pa.int32()))


def _exceptions(sample: DataFrame, weights: dict[str, float], least: float) -> frozenset[str]:
    """Phrases in at least ``least`` clean documents and in no toxic one; counted on the executors."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Model(weights).automaton()
        for batch in batches:
            for rows, texts in pieces(batch):
                counted = (Counter(), Counter())
                for label, text in zip(rows.column("label").to_pylist(), texts, strict=True):
                    hits = matches(fold(text.decode()), machine) if text else []
                    counted[label > 0].update({p for _, *phrases in hits for p in phrases})
                phrases = list(counted[0] | counted[1])
                yield pa.record_batch(
                    [
                        pa.array(phrases, pa.string()),
                        pa.array([counted[1][p] for p in phrases], pa.int64()),
                        pa.array([counted[0][p] for p in phrases], pa.int64()),
                    ],
                    names=["phrase", "toxic", "clean"],
                )

    seen = (
        sample.mapInArrow(find, "phrase string, toxic bigint, clean bigint")
        .groupBy("phrase")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter((F.col("clean") >= least) & (F.col("toxic") == 0))
    )
    return frozenset(r["phrase"] for r in seen.select("phrase").collect())


def _raw_scores(sample: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(raw scores, labels) of the sample, as scoring has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.automaton()
        for batch in batches:
            for rows, texts in pieces(batch):
                raw = [raw_score(fold(t.decode()), model, machine) for t in texts]
                yield pa.record_batch(
                    [rows.column("label"), pa.array(raw, pa.float64())], names=["label", "raw"]
                )

    rows = sample.mapInArrow(run, "label int, raw double").collect()
    return np.array([r["raw"] for r in rows]), np.array([r["label"] > 0 for r in rows], dtype=float)


def explaining(
    weights: dict[str, float], toxic: list[list[tuple[int, int]]]
) -> dict[str, float]:
    """The terms that explain toxic documents not yet explained by stronger ones.

    Only (document, term) pairs that occur are held, not a table of all terms by all documents.
    """
    terms = sorted(weights)
    hits = [(term, row, number) for row, found in enumerate(toxic) for term, number in found]
    hits.sort()
    term, row, number = np.array(hits, dtype=np.int64).reshape(-1, 3).T
    bounds = np.searchsorted(term, np.arange(len(terms) + 1))
    left = np.ones(len(toxic))
    weight = np.array([weights[t] for t in terms])
    least = max(MIN_DOCUMENTS / 2, MIN_SHARE * len(toxic))
    kept: dict[str, float] = {}
    while True:
        explained = np.bincount(term, left[row], minlength=len(terms))
        explained[[terms.index(t) for t in kept]] = 0
        best = int(np.argmax(explained * weight * (explained >= least)))
        if explained[best] < least:
            return kept
        kept[terms[best]] = float(weight[best])
        own = slice(bounds[best], bounds[best + 1])
        left[row[own]] *= 0.5 ** number[own]


def _log_odds(share: float) -> float:
    if share <= 0:
        return -math.inf
    return math.log(share / (1 - share)) if share < 1 else 30.0


def _calibrate(raw: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton steps with a small ridge."""
    design = np.stack([raw, np.ones_like(raw)], axis=1)
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (p - label) + 0.01 * theta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(theta[0]), float(theta[1])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Model from (doc_id, text) rows and (doc_id, toxic) labels; the sample is at most ``rows``."""
    shelf = Shelf(docs.sparkSession)
    sample = labelled_sample(docs, labels, "toxic", MODULUS, HELD, rows, shelf)
    try:
        return _learned(sample.select("label", "text"))
    finally:
        shelf.close()


def _learned(sample: DataFrame) -> Model:
    kinds = sample.select((F.col("label") > 0).alias("toxic")).groupBy("toxic").count().collect()
    counts = {r["toxic"]: r["count"] for r in kinds}
    toxic, clean = counts.get(True, 0), counts.get(False, 0)
    weights = lexicon(sample, toxic, clean) if toxic and clean else {}
    weights = explaining(weights, _toxic_words(sample, weights)) if weights else {}
    if not weights:
        share = toxic / (toxic + clean) if toxic + clean else 0.0
        return Model(offset=_log_odds(share))
    model = Model(weights, _exceptions(sample, weights, max(3, 0.002 * clean)))
    raw, label = _raw_scores(sample, model)
    model.slope, model.offset = _calibrate(raw, label)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) for (doc_id, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.automaton() if model.weights else None
        for batch in batches:
            for rows, texts in pieces(batch):
                values = [
                    probability(raw_score(fold(t.decode()), model, machine), model) for t in texts
                ]
                yield pa.record_batch(
                    [
                        rows.column("doc_id"),
                        pa.array(values, pa.float64()),
                        pa.array([int(v >= 0.5) for v in values], pa.int32()),
                    ],
                    names=["doc_id", "score", "predicted"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, score double, predicted int"
    )


def keep_clean(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted toxic; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.automaton() if model.weights else None
        for batch in batches:
            for part, texts in pieces(batch, text_column):
                folded = (fold(t.decode()) for t in texts)
                raw = (raw_score(t, model, machine) for t in folded)
                yield part.filter(pa.array([probability(r, model) < 0.5 for r in raw]))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted); learns where crc32(doc_id) mod 5 is not 0."""
    return score(docs, train(docs, labels, rows)).select(
        "doc_id", (remainder("doc_id", MODULUS) == HELD).alias("held_out"), "score", "predicted"
    )
