"""Batch scoring with a masked Deep-Sets network of given weights."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Layer sizes.
PHI_HIDDEN = (64, 64)
LATENT = 64
HEAD_HIDDEN = (64,)

Layers = list[tuple[np.ndarray, np.ndarray]]


def layer_sizes(inputs: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    return (inputs, *PHI_HIDDEN, LATENT), (LATENT, *HEAD_HIDDEN, 1)


def parameter_count(inputs: int) -> int:
    if inputs <= 0:
        raise ValueError("BASELINE_DIMENSION: sizes must be positive")
    return sum(a * b + b for sizes in layer_sizes(inputs) for a, b in zip(sizes, sizes[1:]))


def seeded_weights(inputs: int, seed: int) -> tuple[Layers, Layers]:
    """Weights drawn from a seed; in use they come from a trained model."""
    rng = np.random.default_rng(seed)
    return tuple(
        [
            (rng.normal(0.0, 1.0 / np.sqrt(a), (a, b)), rng.normal(0.0, 0.1, b))
            for a, b in zip(sizes, sizes[1:])
        ]
        for sizes in layer_sizes(inputs)
    )


def check_weights(phi: Layers, head: Layers, inputs: int) -> None:
    held = sum(w.size + b.size for w, b in (*phi, *head))
    if held != parameter_count(inputs):
        raise ValueError(f"expected {parameter_count(inputs)} parameters, got {held}")


def forward(x: np.ndarray, starts: np.ndarray, counts: np.ndarray, phi: Layers, head: Layers) -> np.ndarray:
    """Logits of sets given as one stack of real children with start offsets."""
    for w, b in phi:
        x = np.maximum(x @ w + b, 0.0)
    pooled = np.zeros((len(counts), LATENT))
    filled = counts > 0
    if filled.any():
        pooled[filled] = np.add.reduceat(x, starts[filled], axis=0)
    for i, (w, b) in enumerate(head):
        pooled = pooled @ w + b
        if i < len(head) - 1:
            pooled = np.maximum(pooled, 0.0)
    return pooled[:, 0]


def score_views(view: DataFrame, phi: Layers, head: Layers, inputs: int, id_col: str = "jet_id") -> DataFrame:
    """``(id, logit)`` for rows with ``data`` and ``mask``.

    Real children are gathered by Arrow, not row by row.  Only the weights travel to the
    executors, and their number is fixed by the layer sizes (under 20,000 values).
    """
    check_weights(phi, head, inputs)
    shared = view.sparkSession.sparkContext.broadcast((phi, head))
    real = F.transform(
        F.filter(F.arrays_zip("data", "mask"), lambda s: s["mask"]), lambda s: s["data"]
    )
    ready = view.select(id_col, real.alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phi_, head_ = shared.value
        for batch in batches:
            x = batch.column(1)
            counts = np.asarray(x.value_lengths())
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
            flat = np.asarray(x.flatten().flatten(), dtype=np.float64).reshape(-1, inputs)
            logits = forward(flat, starts, counts, phi_, head_)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(logits, pa.float64())], names=[id_col, "logit"]
            )

    kind = view.schema[id_col].dataType.simpleString()
    return ready.mapInArrow(run, f"{id_col} {kind}, logit double")


def logits_of(rows: Sequence[np.ndarray], phi: Layers, head: Layers) -> np.ndarray:
    """The same network on a list of arrays, for checks."""
    counts = np.array([len(r) for r in rows])
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    flat = np.concatenate([r for r in rows if len(r)]) if counts.sum() else np.zeros((0, 1))
    return forward(flat, starts, counts, phi, head)
