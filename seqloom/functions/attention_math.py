"""Kernels of the attention scorer on back-to-back sequences."""

from __future__ import annotations

import numpy as np

from .constants import MIN_TEMPERATURE

#: Most values of a table that holds the sums of two neighbouring taps.
PAIR_VALUES = 1 << 17
#: Widest spread of attention logits whose exponentials are multiplied instead of summed up first.
FLAT = 300.0
#: Values of a hidden layer worked on at a time: a cache holds them.
HEAD_VALUES = 1 << 17
#: Sequences of at least so many positions on average are attended one by one.
LONG = 64
from .ragged import segment_reduce, segment_softmax, sigmoid, spread


def neighbour_index(lengths: np.ndarray, taps: int) -> tuple[np.ndarray, int]:
    """Layout with border rows between sequences: place of each position, and size."""
    half = taps // 2
    total = int(lengths.sum())
    place = np.arange(total) + half * np.repeat(np.arange(1, len(lengths) + 1), lengths)
    return place, total + half * (len(lengths) + 1)


def convolve(x: np.ndarray, lengths: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Same-length 1-D convolution; ``weight`` is (taps, in, out). Borders count as zero."""
    taps = weight.shape[0]
    place, size = neighbour_index(lengths, taps)
    padded = np.zeros((size, x.shape[1]))
    padded[place] = x
    out = np.take(padded, place - taps // 2, axis=0) @ weight[0]
    for t in range(1, taps):
        out += np.take(padded, place + t - taps // 2, axis=0) @ weight[t]
    out += bias
    return out


def tap_columns(x: np.ndarray, lengths: np.ndarray, taps: int) -> np.ndarray:
    """(positions, taps * width): what each position's convolution reads."""
    place, size = neighbour_index(lengths, taps)
    width = x.shape[1]
    padded = np.zeros((size, width))
    padded[place] = x
    # What a position reads lies in one stretch.
    stretches = np.lib.stride_tricks.sliding_window_view(padded.ravel(), taps * width)[::width]
    return np.take(stretches, place - taps // 2, axis=0)


def neighbour_codes(codes: np.ndarray, lengths: np.ndarray, taps: int, border: int) -> list[np.ndarray]:
    """Letter code at each tap of every position; every fold reads the same ones."""
    place, size = neighbour_index(lengths, taps)
    padded = np.full(size, border, dtype=np.intp)
    padded[place] = codes
    return [np.take(padded, place + t - taps // 2) for t in range(taps)]


def convolve_codes(at_taps: list[np.ndarray], tables: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The same for letters: ``tables`` (taps, letters + 1, out) ends in a zero row."""
    out = np.take(tables[0] + bias, at_taps[0], axis=0)
    for table, codes in zip(tables[1:], at_taps[1:]):
        out += np.take(table, codes, axis=0)
    return out


def paired_tables(tables: np.ndarray) -> list[np.ndarray]:
    """One table for each two neighbouring taps, so that half the look-ups are left."""
    letters, out = tables.shape[1:]
    if letters * letters * out > PAIR_VALUES:
        return list(tables)
    pairs = [
        (a[:, None, :] + b[None, :, :]).reshape(-1, out) for a, b in zip(tables[::2], tables[1::2])
    ]
    return pairs + ([tables[-1]] if len(tables) % 2 else [])


def paired_codes(at_taps: list[np.ndarray], letters: int, tables: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of ``tables`` at every position."""
    if len(tables) == len(at_taps):
        return at_taps
    pairs = [a * letters + b for a, b in zip(at_taps[::2], at_taps[1::2])]
    return pairs + ([at_taps[-1]] if len(at_taps) % 2 else [])


def window_codes(at_taps: list[np.ndarray], letters: int) -> np.ndarray:
    """One number per window of letters."""
    code = at_taps[0]
    for c in at_taps[1:]:
        code = code * letters + c
    return code


def exponential_tables(tables: list[np.ndarray]) -> list[np.ndarray] | None:
    """Tables whose products are exp(sum of logits), but for a factor per channel.

    A softmax does not see the factor. None if the smallest products could vanish.
    """
    if sum(float((t.max(axis=0) - t.min(axis=0)).max()) for t in tables) > FLAT:
        return None
    return [np.exp(t - t.max(axis=0)) for t in tables]


def multiply_codes(at_taps: list[np.ndarray], tables: list[np.ndarray]) -> np.ndarray:
    out = np.take(tables[0], at_taps[0], axis=0)
    for table, codes in zip(tables[1:], at_taps[1:]):
        out *= np.take(table, codes, axis=0)
    return out


def tap_tables(book: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Codebook (letters, in) times weight (taps, in, out), plus a zero border row."""
    tables = np.einsum("ad,tdc->tac", book, weight)
    return np.concatenate([tables, np.zeros((weight.shape[0], 1, weight.shape[2]))], axis=1)


def apply_attention(
    features: np.ndarray, attention: np.ndarray, lengths: np.ndarray, mode: str
) -> np.ndarray:
    if mode.endswith("single_conv"):
        return features
    return features * segment_softmax(attention, lengths)


def run_head(x: np.ndarray, layers: list[dict]) -> np.ndarray:
    """Linear layers with ReLU between; ``gain``/``offset`` is a folded batch norm.

    Several outputs are averaged to one logit.
    """
    for i, layer in enumerate(layers):
        x = x @ layer["weight"]
        x += layer["bias"]
        if i < len(layers) - 1:
            np.maximum(x, 0.0, out=x)
            if layer.get("gain") is not None:
                x *= layer["gain"]
                x += layer["offset"]
    return x[:, 0] if x.shape[1] == 1 else x.mean(axis=1)


def folded_head(layers: list[dict], channels: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weight, bias) of each layer with batch norms and the mean over outputs worked in.

    The bias of a hidden layer is what its ReLU cuts at: relu(x + b) = max(x, -b) + b, and
    the added b goes to the bias of the next layer. The last layer gives one value.
    """
    if not layers:
        return [(np.full(channels, 1.0 / channels), np.float64(0.0))]
    folded, gain, offset = [], None, None
    for i, layer in enumerate(layers):
        weight, bias = np.asarray(layer["weight"], float), np.asarray(layer["bias"], float)
        if i:
            before = folded[-1][1]
            if gain is not None:
                bias = bias + offset @ weight
                weight = gain[:, None] * weight
            bias = bias + before @ weight
        gain, offset = layer.get("gain"), layer.get("offset")
        folded.append((weight, bias))
    weight, bias = folded[-1]
    folded[-1] = weight.mean(axis=1), bias.mean()
    return folded


def run_folded(x: np.ndarray, folded: list[tuple[np.ndarray, np.ndarray]], scale: np.ndarray | None = None) -> np.ndarray:
    """One logit per row of ``x``, whose columns are multiplied by ``scale``."""
    first = folded[0][0]
    if scale is not None:
        first = (first.T * scale).T
    last, bias = folded[-1]
    if len(folded) == 1:
        return x @ first + bias
    rows = max(64, HEAD_VALUES // max(w.shape[1] for w, _ in folded[:-1]))
    out = np.empty(len(x))
    for at in range(0, len(x), rows):
        z = x[at : at + rows] @ first
        np.maximum(z, -folded[0][1], out=z)
        for weight, cut in folded[1:-1]:
            z = z @ weight
            np.maximum(z, -cut, out=z)
        np.dot(z, last, out=out[at : at + rows])
    out += bias
    return out


def attended_logits(
    features: np.ndarray, weights: np.ndarray, lengths: np.ndarray, folded: list[tuple[np.ndarray, np.ndarray]]
) -> np.ndarray:
    """Head of ``features`` times ``weights`` over their sums in each sequence; both may be overwritten."""
    features *= weights
    if len(lengths) and len(features) < LONG * len(lengths):
        features /= spread(segment_reduce(np.add, weights, lengths), lengths)
        return run_folded(features, folded)
    out = np.empty(len(features))
    end = 0
    for n in lengths.tolist():
        start, end = end, end + n
        # A product with ones adds up columns several times faster than a sum along the rows.
        total = np.ones(n) @ weights[start:end]
        out[start:end] = run_folded(features[start:end], folded, 1.0 / total)
    return out


def pool(
    mode: str, logits: np.ndarray, lengths: np.ndarray, temperature: float = 1.0
) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(residue scores, sequence scores, weighted residues of the weighted modes)."""
    prob = sigmoid(logits)
    if mode == "max":
        return prob, segment_reduce(np.maximum, prob, lengths), None
    if mode in ("mean", "mean_single_conv"):
        return prob, segment_reduce(np.add, prob, lengths) / lengths, None
    if mode == "sum":
        return logits, sigmoid(segment_reduce(np.add, logits, lengths)), None
    if mode in ("weighted_mean", "weighted_mean_single_conv"):
        weights = segment_softmax(prob, lengths)
    elif mode == "weighted_mean_two":
        weights = segment_softmax(logits, lengths)
    else:
        weights = segment_softmax(logits / max(temperature, MIN_TEMPERATURE), lengths)
    weighted = prob * weights
    score = segment_reduce(np.add, weighted, lengths)
    if mode in ("weighted_mean_two", "weighted_mean_three"):
        score = np.minimum(score, 1.0)
    return (logits if mode == "weighted_mean_two" else prob), score, weighted


def pool_gradient(
    mode: str,
    logits: np.ndarray,
    lengths: np.ndarray,
    temperature: float,
    upstream: np.ndarray,
) -> tuple[np.ndarray, float]:
    """Gradient of sum(upstream * score) for the logits and the temperature."""
    p = sigmoid(logits)
    slope = p * (1.0 - p)
    g = spread(upstream, lengths)
    if mode == "max":
        top = spread(segment_reduce(np.maximum, p, lengths), lengths)
        hit = (p == top).astype(float)
        hit /= spread(segment_reduce(np.add, hit, lengths), lengths)
        return g * hit * slope, 0.0
    if mode in ("mean", "mean_single_conv"):
        return g * slope / spread(lengths.astype(float), lengths), 0.0
    if mode == "sum":
        s = sigmoid(segment_reduce(np.add, logits, lengths))
        return spread(upstream * s * (1.0 - s), lengths), 0.0
    if mode in ("weighted_mean", "weighted_mean_single_conv"):
        w = segment_softmax(p, lengths)
        s = spread(segment_reduce(np.add, p * w, lengths), lengths)
        return g * (w + w * (p - s)) * slope, 0.0
    t = 1.0 if mode == "weighted_mean_two" else max(temperature, MIN_TEMPERATURE)
    w = segment_softmax(logits / t, lengths)
    s = spread(segment_reduce(np.add, p * w, lengths), lengths)
    pull = w * (p - s)
    learns = mode == "weighted_mean_three" and temperature > MIN_TEMPERATURE
    return g * (w * slope + pull / t), float(-(g * pull * logits).sum() / t**2) if learns else 0.0
