"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and everything but letters becomes a space. n-grams of one to three characters
are hashed into ``BINS``. Learning adds up bin counts per language in every task and then over tasks, by
one aggregation over all training documents. The matrix of log probabilities (bins x languages) is
broadcast; scoring is a gather and a segmented sum in numpy over a batch of texts.

``und`` with score 0 for a null text and for one without a letter; the score is the posterior
probability otherwise. Ties go to the smaller language name. Texts of any length count whole. Without
any training document every text is ``und``. Repeated rows are repeated in the result; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jetframe.llm.texts import mix, pieces, remainder

BINS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
UNKNOWN = "und"
MODULUS, HELD = 3, 1
PIECE_BYTES = 1 << 20


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def gram_bins(texts: list[bytes], bins: int = BINS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins of all n-grams, owning text of each in ascending order per order, has a letter)."""
    lowered = [t.decode().lower() for t in texts]
    # Two separators close each text: no n-gram with a letter at its start reaches the next text.
    codes = np.frombuffer("  ".join([*lowered, ""]).encode("utf-32-le"), dtype="<u4")
    ends = np.cumsum(np.fromiter((len(t) + 2 for t in lowered), np.int64, len(lowered)))
    is_letter = letters()[codes]
    codes = np.where(is_letter, codes, 32).astype(np.uint64)
    owner = np.repeat(np.arange(len(lowered)), np.diff(np.concatenate([[0], ends])))
    has = np.zeros(len(lowered), dtype=bool)
    has[owner[is_letter]] = True
    found, owners = [], []
    for order in ORDERS:
        key = np.full(max(0, len(codes) - order + 1), order, dtype=np.uint64)
        for k in range(order):
            key = (key << np.uint64(21)) | codes[k : k + len(key)]
        keep = is_letter[: len(key)]
        found.append((mix(key[keep]) & np.uint64(bins - 1)).astype(np.int32))
        owners.append(owner[: len(key)][keep])
    return np.concatenate(found), np.concatenate(owners), has


def gram_counts(docs: DataFrame, bins: int = BINS) -> DataFrame:
    """(lang, bin, n, rows): n-grams per language and bin; bin -1 holds the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for rows, texts in pieces(batch, budget=PIECE_BYTES):
                names, code = np.unique(
                    np.array(rows.column("lang").to_pylist(), dtype=object), return_inverse=True
                )
                found, owners, _ = gram_bins(texts, bins)
                size = bins + 1
                counted = np.bincount(
                    code[owners].astype(np.int64) * size + found, minlength=size * len(names)
                ).reshape(len(names), size)
                counted[:, bins] = np.bincount(code, minlength=len(names))
                for name, row in zip(names, counted, strict=True):
                    totals[name] = totals.get(name, 0) + row
        for name, row in totals.items():
            used = np.flatnonzero(row)
            yield pa.record_batch(
                [
                    pa.array([name] * len(used), pa.string()),
                    pa.array(np.where(used == bins, -1, used), pa.int32()),
                    pa.array(row[used], pa.int64()),
                ],
                names=["lang", "bin", "n"],
            )

    return (
        docs.mapInArrow(count, "lang string, bin int, n bigint")
        .groupBy("lang", "bin")
        .agg(F.sum("n").alias("n"))
    )


def train(docs: DataFrame, bins: int = BINS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log probabilities bins x languages, log priors) from (text, lang) rows.

    What comes to the driver is the model: at most bins x languages numbers.
    """
    known = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    counts = gram_counts(known, bins).toPandas()
    names = sorted(counts["lang"].unique())
    table = np.zeros((bins + 1, len(names)))
    table[counts["bin"].to_numpy(), counts["lang"].map(names.index).to_numpy(dtype=int)] = counts[
        "n"
    ].to_numpy()
    if not names:
        return [], np.zeros((bins, 0), np.float32), np.zeros(0)
    priors = np.log(table[bins] / table[bins].sum())
    smoothed = table[:bins] + SMOOTHING
    return names, np.log(smoothed / smoothed.sum(axis=0)).astype(np.float32), priors


def score_texts(texts: list[bytes], names, logs, priors) -> tuple[list[str], np.ndarray]:
    found, owners, has = gram_bins(texts, len(logs))
    total = np.empty((len(texts), len(names)))
    for n in range(len(names)):
        total[:, n] = np.bincount(owners, np.ascontiguousarray(logs[:, n])[found], len(texts))
    total += priors
    total -= total.max(axis=1, keepdims=True, initial=-np.inf)
    share = np.exp(total)
    share /= share.sum(axis=1, keepdims=True)
    best = share.argmax(axis=1)
    labels = [names[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
    return labels, np.where(has, share.max(axis=1), 0.0)


def identify(docs: DataFrame, model) -> DataFrame:
    """(doc_id, lang_pred, score) for (doc_id, text) rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs, priors = shared.value
        for batch in batches:
            for rows, texts in pieces(batch, budget=PIECE_BYTES):
                if names:
                    labels, scores = score_texts(texts, names, logs, priors)
                else:
                    labels, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                yield pa.record_batch(
                    [rows.column("doc_id"), pa.array(labels, pa.string()), pa.array(scores)],
                    names=["doc_id", "lang_pred", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        predict, f"doc_id {kind}, lang_pred string, score double"
    )


def language_id(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); learns where crc32(doc_id) mod 3 is not 1."""
    learn = docs.filter(remainder("doc_id", MODULUS) != HELD).select("text", "lang")
    return identify(docs, train(learn)).select(
        "doc_id",
        (remainder("doc_id", MODULUS) == HELD).alias("held_out"),
        "lang_pred",
        "score",
    )
