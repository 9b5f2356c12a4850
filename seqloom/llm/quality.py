"""Quality scores from gradient-boosted trees over document statistics.

``statistics`` turns whole texts into one row of numbers each. Trees are grown on
histograms of at most ``BINS`` quantile bins per statistic, from a bounded
sample of labelled rows, and kept as flat arrays; scoring walks all documents of
a slice through a tree at once.

Defined results: null and empty texts have the statistics of an empty text, all
0; repeated rows get equal scores; an empty table gives an empty result; with
labels of one class only, every score is that class's share (0.5 without
labels). Other columns are kept by ``keep_good`` and ignored elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow, fitted, labelled_rows, map_texts, sigmoid
from .textops import NOT_SPACE, TEXT_BITS, WORD_BYTE, Hasher, Texts, Words, _table, shingles, slices, words

BINS = 64
DEPTH = 4
TREES = 60
RATE = 0.15
#: At most so many labelled rows of each class, none longer than so many characters, are fitted on.
SAMPLE_ROWS = 4000
SAMPLE_CHARS = 20_000
THRESHOLD = 0.7

_COUNTED = {
    "upper": _table(bytes(range(65, 91))),
    "lower": _table(bytes(range(97, 123))),
    "digit": _table(bytes(range(48, 58))),
    "symbol": _table(b"#*$%&|<>"),
    "bang": _table(b"!?"),
    "stop": _table(b".,;:"),
    "bracket": _table(b"(){}[]/\\_=+~^@"),
    "wide": np.arange(256) >= 128,
    "space": _table(b" \t\x0b\x0c\r"),
    "line": _table(b"\n"),
}
_LINE = ~_table(b"\n")
STATISTICS = (
    *(f"share_{k}" for k in _COUNTED),
    "log_bytes",
    "log_words",
    "word_bytes",
    "word_bytes_spread",
    "distinct_words",
    "top_word",
    "repeated_4grams",
    "repeated_lines",
    "words_per_line",
    "words_per_stop",
    "marked_words",
    "upper_words",
    "byte_entropy",
)


def _per_text(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[of[1:]] - total[of[:-1]]


def _distinct(keys: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys per text, and the count of the most frequent one."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    # The text in the leading bits keeps texts apart; one sort serves all of them.
    bits, rest = np.uint64(TEXT_BITS), np.uint64(64 - TEXT_BITS)
    tagged = np.sort((keys >> bits) | (text.astype(np.uint64) << rest))
    first = np.flatnonzero(np.concatenate([[True], tagged[1:] != tagged[:-1]]))
    owner = (tagged[first] >> rest).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, owner, np.diff(np.append(first, len(tagged))))
    return np.bincount(owner, minlength=n).astype(float), top


def statistics(texts: Texts) -> np.ndarray:
    """[text, statistic], in the order of STATISTICS; every value is finite."""
    n = len(texts)
    data, starts = texts.data, texts.starts
    size = np.diff(starts).astype(float)
    safe = np.maximum(size, 1)
    at = np.repeat(np.arange(n) * 256, np.diff(starts)) + data
    held = np.bincount(at, minlength=n * 256).reshape(n, 256) / safe[:, None]
    cols = {f"share_{k}": held @ t for k, t in _COUNTED.items()}
    cols["log_bytes"] = np.log1p(size)

    found = words(texts, NOT_SPACE)
    n_words = np.diff(found.of).astype(float)
    some = np.maximum(n_words, 1)
    length = (found.end - found.start).astype(float)
    cols["log_words"] = np.log1p(n_words)
    mean = cols["word_bytes"] = _per_text(length, found.of) / some
    spread = _per_text(length**2, found.of) / some - mean**2
    cols["word_bytes_spread"] = np.sqrt(np.maximum(spread, 0))
    hasher = Hasher(data)
    hashes = hasher(found.start, found.end)
    distinct, top = _distinct(hashes, found.text(), n)
    cols["distinct_words"] = distinct / some
    cols["top_word"] = top / some
    gram, owner = shingles(hashes, found.of, 4)
    n_grams = np.maximum(np.bincount(owner, minlength=n), 1)
    cols["repeated_4grams"] = 1 - np.maximum(_distinct(gram, owner, n)[0], n_words == 0) / n_grams

    lines: Words = words(texts, _LINE)
    n_lines = np.maximum(np.diff(lines.of), 1)
    cols["repeated_lines"] = 1 - np.maximum(
        _distinct(hasher(lines.start, lines.end), lines.text(), n)[0], size == 0
    ) / n_lines
    cols["words_per_line"] = n_words / n_lines
    cols["words_per_stop"] = n_words / (1 + cols["share_stop"] * size)
    last = data[found.end - 1] if len(found.end) else np.empty(0, np.uint8)
    cols["marked_words"] = _per_text(~WORD_BYTE[last], found.of) / some
    upper = np.concatenate([[0], np.cumsum(_COUNTED["upper"][data], dtype=np.int32)])
    letters = upper[found.end] - upper[found.start]
    cols["upper_words"] = _per_text((letters >= 2) & (2 * letters > length), found.of) / some
    cols["byte_entropy"] = -(held * np.log2(np.maximum(held, 1e-12))).sum(1)
    return np.stack([np.nan_to_num(cols[k]) for k in STATISTICS], 1).astype(np.float64)


@dataclass
class Forest:
    """Flat trees: node i of a tree has children 2i + 1 and 2i + 2."""

    base: float
    feature: np.ndarray  # [tree, inner node]
    cut: np.ndarray  # [tree, inner node]; go right where value > cut
    leaf: np.ndarray  # [tree, leaf]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        total = np.full(len(x), self.base)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - len(feature)]
        return sigmoid(total)


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    """Second-order boosting of the logistic loss on binned statistics."""
    n, k = x.shape
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if n else 0.5
    feature = np.zeros((trees, inner), np.int64)
    cut = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    if n == 0 or y.min() == y.max():
        return Forest(float(np.log(share / (1 - share))), feature[:0], cut[:0], leaf[:0])
    # Classes weigh alike: rejects are few, and their share differs between corpora.
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    flat = binned + BINS * np.arange(k)[:, None]
    margin = np.zeros(n)
    for t in range(trees):
        p = sigmoid(margin)
        grad, hess = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            width, low = 2**level, 2**level - 1
            at = ((node - low) * (k * BINS))[None, :] + flat
            shape = (width, k, BINS)
            size = width * k * BINS
            g = np.bincount(at.ravel(), np.tile(grad, k), size).reshape(shape).cumsum(2)
            h = np.bincount(at.ravel(), np.tile(hess, k), size).reshape(shape).cumsum(2)
            gl, hl, ga, ha = g[..., :-1], h[..., :-1], g[..., -1:], h[..., -1:]
            gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
            gain[(hl < 1) | (ha - hl < 1)] = 0
            best = gain.reshape(width, -1).argmax(1)
            f, b = best // (BINS - 1), best % (BINS - 1)
            split = gain.reshape(width, -1).max(1) > 1e-9
            split &= b < np.array([len(edges[i]) for i in f])
            feature[t, low : low + width] = np.where(split, f, 0)
            cut[t, low : low + width] = [
                edges[i][j] if s else np.inf for i, j, s in zip(f, b, split, strict=True)
            ]
            own = node - low
            right = split[own] & (binned[f[own], np.arange(n)] > b[own])
            node = 2 * node + 1 + right
        at = node - inner
        leaf[t] = -RATE * np.bincount(at, grad, leaves) / (np.bincount(at, hess, leaves) + 1)
        margin += leaf[t][at]
    return Forest(0.0, feature, cut, leaf)


def train(docs: DataFrame, labels: DataFrame) -> Forest:
    """Fit on a bounded sample; ``labels`` holds only rows that may be learned from."""

    def fit(rows: pa.Table) -> Forest:
        parts = [statistics(s) for s in slices(rows.column("text"))]
        x = np.concatenate(parts) if parts else np.empty((0, len(STATISTICS)))
        return fit_forest(x, rows.column("_label").to_numpy().astype(float))

    return fitted(labelled_rows(docs, labels, "quality", SAMPLE_ROWS, SAMPLE_CHARS), fit)


SCHEMA = f"doc_id long, score double, {', '.join(f'{s} double' for s in STATISTICS)}"


def score_quality(docs: DataFrame, model: Forest) -> DataFrame:
    """One row per document: doc_id, score in 0..1 and the statistics."""

    def run(texts: Texts, rows: pa.RecordBatch) -> pa.RecordBatch:
        x = statistics(texts)
        return arrow(
            ["doc_id", "score", *STATISTICS],
            [rows.column("doc_id"), model(x), *(np.ascontiguousarray(c) for c in x.T)],
        )

    return map_texts(docs.select("doc_id", "text"), run, SCHEMA)


def keep_good(docs: DataFrame, model: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of documents whose score reaches the threshold, all columns as they were."""

    def run(texts: Texts, rows: pa.RecordBatch) -> pa.RecordBatch:
        return rows.filter(pa.array(model(statistics(texts)) >= threshold))

    return map_texts(docs, run, docs.schema)
