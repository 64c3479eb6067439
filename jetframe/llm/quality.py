"""Quality classifier: attention-based learning from document labels over passages.

Every document is a bag of passages of ``PASSAGE_WORDS`` words. A passage is encoded by fixed features
(byte and word-shape frequencies, repeated words and repeated five-word runs) and a learned layer. Gated
attention weighs the passages, and the weighted sum is scored:

    h = tanh(W x + b),  a = softmax_passages(w . (tanh(V h) * sigmoid(U h))),  p = sigmoid(c . sum(a h) + d)

All weights are learned together from document labels, on at most ``SAMPLE_ROWS`` labelled documents
outside the held-out part, each with at most ``SAMPLE_PASSAGES`` evenly spaced passages: this bounds what
the driver holds, whatever the input. Scoring takes every passage of every whole text, where it is read.

A null text, an empty one and one of separators only is a bag with one passage of zeros. Without labels
of both kinds all scores are the share of label 1 (1 without labels). Repeated rows are scored alike; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jetframe.llm.texts import (
    joined,
    labelled_sample,
    mix,
    pieces,
    remainder,
    word_grams,
    words,
)
from jetframe.session import Shelf

SAMPLE_ROWS = 4_000
SAMPLE_PASSAGES = 400_000
MODULUS, HELD = 3, 1
PASSAGE_WORDS = 48
BYTE_BINS, SHAPE_BINS, EXTRA = 64, 64, 6
FEATURES = BYTE_BINS + SHAPE_BINS + EXTRA
HIDDEN, GATE = 24, 12
STEPS, RATE, DECAY = 150, 0.02, 1e-3
PIECE_BYTES = 1 << 20

LOWER_CASE, UPPER_CASE, DIGIT, STOP, OTHER, HIGH = range(6)
CLASSES = np.full(256, OTHER, dtype=np.uint8)
CLASSES[97:123], CLASSES[65:91], CLASSES[48:58], CLASSES[128:] = (
    LOWER_CASE,
    UPPER_CASE,
    DIGIT,
    HIGH,
)
CLASSES[[ord(c) for c in ".,;:!?"]] = STOP


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, bounds of each document's passages)."""
    data, bounds = joined(texts)
    starts, lengths, hashes = words(data)
    owner = np.searchsorted(bounds, starts, side="right") - 1
    counts = np.bincount(owner, minlength=len(texts))
    per_doc = np.maximum(1, -(-counts // PASSAGE_WORDS))
    offsets = np.concatenate([[0], np.cumsum(per_doc)])
    total = int(offsets[-1])
    features = np.zeros((total, FEATURES), dtype=np.float32)
    if not len(starts):
        return features, offsets
    first_word = np.concatenate([[0], np.cumsum(counts)[:-1]])
    home = offsets[owner] + (np.arange(len(owner)) - first_word[owner]) // PASSAGE_WORDS
    sizes = np.bincount(home, minlength=total)
    filled = np.maximum(1, sizes)

    inside = np.repeat(home, lengths)
    place = np.arange(len(inside)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    held = data[np.repeat(starts, lengths) + place]
    cells = np.bincount(inside * BYTE_BINS + (held >> 2), minlength=total * BYTE_BINS)
    mass = np.bincount(home, lengths, total)
    share_of = cells.reshape(total, BYTE_BINS) / np.maximum(1, mass)[:, None]
    features[:, :BYTE_BINS] = np.sqrt(share_of)

    kinds = CLASSES[data]
    shape = (
        np.minimum(lengths, 15) * 36 + kinds[starts] * 6 + kinds[starts + lengths - 1]
    ).astype(np.uint64)
    bins = (mix(shape + np.uint64(1)) % np.uint64(SHAPE_BINS)).astype(np.int64)
    cells = np.bincount(home * SHAPE_BINS + bins, minlength=total * SHAPE_BINS)
    features[:, BYTE_BINS : BYTE_BINS + SHAPE_BINS] = np.sqrt(
        cells.reshape(total, SHAPE_BINS) / filled[:, None]
    )

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(home[: len(flags)], flags, total) / filled

    same = np.zeros(len(owner))
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    again = np.zeros(len(owner))
    for size, flags in ((5, again),):
        grams = word_grams(hashes, size)
        inner = owner[: len(grams)] == owner[len(owner) - len(grams) :]
        keys = mix(grams[inner] + owner[: len(grams)][inner].astype(np.uint64))
        seen = np.zeros(len(keys), dtype=bool)
        seen[np.unique(keys, return_index=True)[1]] = True
        flags[: len(grams)][inner] = ~seen
    extra = features[:, BYTE_BINS + SHAPE_BINS :]
    extra[:, 0] = share(same)
    extra[:, 1] = share(again)
    extra[:, 2] = mass / filled / 10.0
    extra[:, 3] = sizes / PASSAGE_WORDS
    extra[:, 4] = share((kinds[starts] == UPPER_CASE).astype(float))
    extra[:, 5] = share((kinds[starts + lengths - 1] == STOP).astype(float))
    return features, offsets


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _segment(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, offsets[:-1], axis=0)


def forward(model: dict, features: np.ndarray, offsets: np.ndarray) -> dict:
    x = (features - model["mean"]) / model["spread"]
    sizes = np.diff(offsets)
    h = np.tanh(x @ model["W"] + model["b"])
    t, g = np.tanh(h @ model["V"]), _sigmoid(h @ model["U"])
    energy = (t * g) @ model["w"]
    energy = energy - np.repeat(np.maximum.reduceat(energy, offsets[:-1]), sizes)
    raised = np.exp(energy)
    attention = raised / np.repeat(_segment(raised, offsets), sizes)
    z = _segment(attention[:, None] * h, offsets)
    p = _sigmoid(z @ model["c"] + model["d"])
    return {"x": x, "h": h, "t": t, "g": g, "a": attention, "z": z, "p": p}


def gradients(model: dict, run: dict, offsets: np.ndarray, label: np.ndarray) -> dict:
    sizes = np.diff(offsets)
    dlogit = (run["p"] - label) / len(label)
    dz = dlogit[:, None] * model["c"]
    dz_rows = np.repeat(dz, sizes, axis=0)
    da = (dz_rows * run["h"]).sum(axis=1)
    de = run["a"] * (da - np.repeat(_segment(run["a"] * da, offsets), sizes))
    dgate = de[:, None] * model["w"]
    dt = dgate * run["g"] * (1 - run["t"] ** 2)
    dg = dgate * run["t"] * run["g"] * (1 - run["g"])
    dh = run["a"][:, None] * dz_rows + dt @ model["V"].T + dg @ model["U"].T
    dh *= 1 - run["h"] ** 2
    return {
        "W": run["x"].T @ dh,
        "b": dh.sum(axis=0),
        "V": run["h"].T @ dt,
        "U": run["h"].T @ dg,
        "w": (run["t"] * run["g"]).T @ de,
        "c": run["z"].T @ dlogit,
        "d": dlogit.sum(),
    }


def fit(features: np.ndarray, offsets: np.ndarray, label: np.ndarray, seed: int = 7) -> dict:
    """Full-batch Adam on the mean log loss with weight decay."""
    rng = np.random.default_rng(seed)

    def start(*shape):
        return (rng.standard_normal(shape) / math.sqrt(shape[0])).astype(np.float32)

    model = {
        "mean": features.mean(axis=0),
        "spread": features.std(axis=0) + 1e-2,
        "W": start(FEATURES, HIDDEN),
        "b": np.zeros(HIDDEN, np.float32),
        "V": start(HIDDEN, GATE),
        "U": start(HIDDEN, GATE),
        "w": start(GATE),
        "c": start(HIDDEN),
        "d": np.float32(0),
    }
    names = ("W", "b", "V", "U", "w", "c", "d")
    first = {n: np.zeros_like(model[n]) for n in names}
    second = {n: np.zeros_like(model[n]) for n in names}
    for step in range(1, STEPS + 1):
        grads = gradients(model, forward(model, features, offsets), offsets, label)
        for n in names:
            g = (grads[n] + (DECAY * model[n] if n not in ("b", "d") else 0)).astype(np.float32)
            first[n] = 0.9 * first[n] + 0.1 * g
            second[n] = 0.999 * second[n] + 0.001 * g * g
            rate = RATE * math.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            model[n] = (model[n] - rate * first[n] / (np.sqrt(second[n]) + 1e-8)).astype(np.float32)
    return model


def constant(share: float) -> dict:
    return {"constant": share}


def train(
    docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most: int = SAMPLE_PASSAGES
) -> dict:
    """Model from (doc_id, text) rows and (doc_id, quality) labels.

    The sample is at most ``rows`` labelled documents, in the order of their hashes, as long as all their
    passages together are at most ``most``; every document of it is learned with all of its passages.
    """
    shelf = Shelf(docs.sparkSession)
    sample = labelled_sample(docs, labels, "quality", MODULUS, HELD, rows, shelf)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, budget=PIECE_BYTES):
                features, offsets = passages(texts)
                bags = [features[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.record_batch(
                    [
                        part.column("key"),
                        part.column("label"),
                        pa.array(np.diff(offsets), pa.int64()),
                        pa.array(bags, pa.binary()),
                    ],
                    names=["key", "label", "n", "bag"],
                )

    encoded = shelf.put(sample.mapInArrow(encode, "key bigint, label int, n bigint, bag binary"), sample)
    sizes = encoded.select("key", "n").toPandas().sort_values("key")
    last = sizes["key"][sizes["n"].cumsum() <= most].max()
    found = [] if np.isnan(last) else encoded.filter(F.col("key") <= int(last)).collect()
    shelf.close()
    found.sort(key=lambda row: row["key"])
    label = np.array([row["label"] > 0 for row in found], dtype=np.float32)
    if not len(label) or label.min() == label.max():
        return constant(float(label.mean()) if len(label) else 1.0)
    bags = [np.frombuffer(row["bag"], np.float32).reshape(-1, FEATURES) for row in found]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    return fit(np.concatenate(bags), offsets, label)


def scores(model: dict, texts: list[bytes]) -> np.ndarray:
    if "constant" in model:
        return np.full(len(texts), model["constant"], dtype=np.float64)
    features, offsets = passages(texts)
    return forward(model, features, offsets)["p"].astype(np.float64)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score, predicted) for (doc_id, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, budget=PIECE_BYTES):
                values = scores(model, texts)
                yield pa.record_batch(
                    [
                        part.column("doc_id"),
                        pa.array(values, pa.float64()),
                        pa.array((values >= 0.5).astype(np.int32), pa.int32()),
                    ],
                    names=["doc_id", "score", "predicted"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, score double, predicted int"
    )


def keep_good(docs: DataFrame, model: dict, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is predicted to have label 1; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, text_column, PIECE_BYTES):
                yield part.filter(pa.array(scores(model, texts) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted); learns where crc32(doc_id) mod 3 is not 1."""
    return score(docs, train(docs, labels, rows)).select(
        "doc_id", (remainder("doc_id", MODULUS) == HELD).alias("held_out"), "score", "predicted"
    )
