"""Arrow list columns <-> flat NumPy arrays, and sums over ragged segments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .constants import ALPHABET

PAD = len(ALPHABET)

_CODES = np.full(256, 255, dtype=np.uint8)
for _i, _a in enumerate(ALPHABET):
    _CODES[ord(_a)] = _i


def letter_codes(sequences: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all letters back to back, and the length of each sequence."""
    values = [v or "" for v in sequences.to_pylist()]
    lengths = np.array([len(v) for v in values], dtype=np.int64)
    codes = _CODES[np.frombuffer("".join(values).encode("ascii", "replace"), dtype=np.uint8)]
    if (codes == 255).any():
        raise ValueError("sequences hold letters outside the alphabet")
    return codes, lengths


def matrix_rows(column: pa.Array, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``list<list<float>>`` -> (all vectors stacked, vectors per row).

    ``width`` shapes the result when there is no vector to tell.
    """
    lengths = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    vectors = column.flatten()
    flat = np.asarray(vectors.flatten(), dtype=np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, width), lengths


def list_array(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Flat values (n,) or (n, c) -> lists, or lists of lists, of their own type."""
    inner = pa.array(np.ascontiguousarray(values).reshape(-1))
    if values.ndim == 2:
        steps = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
        inner = pa.ListArray.from_arrays(pa.array(steps), inner)
    return pa.ListArray.from_arrays(pa.array(offsets_of(lengths).astype(np.int32)), inner)


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def segment_reduce(op: np.ufunc, values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``op`` over each segment; lengths must be positive."""
    return op.reduceat(values, offsets_of(lengths)[:-1], axis=0)


def spread(per_segment: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.repeat(per_segment, lengths, axis=0)


def segment_softmax(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    top = segment_reduce(np.maximum, values, lengths)
    weights = values - spread(top, lengths)
    np.exp(weights, out=weights)
    weights /= spread(segment_reduce(np.add, weights, lengths), lengths)
    return weights


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))
