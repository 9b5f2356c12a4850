"""Toxic spans and document scores from a linear-chain conditional random field.

Training
    The labels are per document, so token labels come first: a word of a toxic
    document counts as toxic if it, or one of its beginnings, is found in toxic
    documents several times as often as in clean ones. The field has two states,
    clean and toxic, with hashed features of the word and its beginnings, and
    transition weights; stochastic gradients come from forward-backward.
    Near copies of an earlier document of the sample are left out of all counts, or a
    copied text would make each of its words look toxic and dilute the others.

Scoring
    A document is cut into chains of at most ``CHAIN`` words. Forward-backward
    gives each word its marginal; the largest marginal, their sum and their
    density feed a logistic regression, which is the document's score. Runs of
    words over one half are the offending spans.

Defined results: null and empty texts have no words and get the score of a text
without toxic words; repeated rows are scored one by one; an empty table gives
an empty result; without labels of both classes every score is 0. Other columns
are kept by ``reject_toxic`` and ignored elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow, fitted, labelled_rows, map_texts, sigmoid
from .textops import LOWER, WORD_BYTE, Hasher, Texts, Words, char_offsets, shingles, slices, words

CHAIN = 64
BLOCK = 4096  # chains whose messages are held at a time
HASH_BITS = 18
PREFIXES = (4, 5, 6, 7)
#: At most so many labelled rows of each class, none longer than so many characters, are fitted on.
SAMPLE_ROWS = 2000
SAMPLE_CHARS = 20_000
#: Bytes of the sample worked on at a time: it is fitted in one task.
SAMPLE_BYTES = 1 << 18
#: A word form marks toxic text if toxic documents have it so many times as often.
ODDS = 5.0
THRESHOLD = 0.5
TEXTS = 256  # texts whose features are counted at a time
#: Jaccard of the three-word shingles from which on a text is a near copy.
COPY = 0.8


@dataclass
class Field:
    """Weights of the toxic state; the clean state's emissions are 0."""

    weights: np.ndarray  # one for each hashed feature; [0] stays 0
    trans: np.ndarray  # log weights [from, to]
    start: float
    doc: np.ndarray  # logistic regression on doc_features


def features(texts: Texts) -> tuple[Words, np.ndarray]:
    """Words and their feature numbers; 0 where a word is shorter than a beginning."""
    data = LOWER[texts.data]
    found = words(texts, WORD_BYTE)
    hasher = Hasher(data)
    out = np.zeros((1 + len(PREFIXES), len(found.start)), np.int32)
    shift = np.uint64(64 - HASH_BITS)
    out[0] = (hasher(found.start, found.end) >> shift).astype(np.int32)
    length = found.end - found.start
    for i, n in enumerate(PREFIXES, 1):
        long = length >= n
        begin = found.start[long]
        # Another length than a whole word's, so that the two never share a number.
        salted = hasher(begin, begin + n) * np.uint64(2 * n + 1)
        out[i, long] = (salted >> shift).astype(np.int32)
    return found, out


def chains(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of each chain of at most CHAIN words."""
    n = np.diff(of)
    count = -(-n // CHAIN)
    text = np.repeat(np.arange(len(n)), count)
    within = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = of[:-1][text] + within * CHAIN
    return first, np.minimum(of[1:][text] - first, CHAIN)


def _padded(values: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """[position, chain]; beyond a chain's end 0."""
    out = np.zeros((CHAIN, len(first)), values.dtype)
    for t in range(int(length.max(initial=0))):
        on = length > t
        out[t, on] = values[first[on] + t]
    return out


def forward_backward(emit: np.ndarray, length: np.ndarray, model: Field):
    """Marginals of the toxic state [position, chain] and expected transitions [2, 2].

    ``emit`` is the log weight of toxic against clean. Both messages are kept as
    the ratio toxic : clean, so no logarithm of a sum is needed.
    """
    t00, t01, t10, t11 = np.exp(model.trans).ravel()
    e = np.exp(np.clip(emit, -30, 30))
    steps = int(length.max(initial=0))
    ahead = np.zeros_like(e)
    behind = np.ones_like(e)
    if steps:
        ahead[0] = e[0] * np.exp(model.start)
    for t in range(1, steps):
        r = ahead[t - 1]
        ahead[t] = e[t] * (t01 + t11 * r) / (t00 + t10 * r)
    for t in range(steps - 2, -1, -1):
        r = e[t + 1] * behind[t + 1]
        here = (t10 + t11 * r) / (t00 + t01 * r)
        behind[t] = np.where(length > t + 1, here, 1.0)
    ratio = ahead * behind
    return ratio / (1 + ratio), ahead, behind, e


def _expected_transitions(ahead, behind, e, length, trans) -> np.ndarray:
    w = np.exp(trans)
    out = np.zeros((2, 2))
    for t in range(len(e) - 1):
        on = length > t + 1
        if not on.any():
            break
        a, b = ahead[t, on], e[t + 1, on] * behind[t + 1, on]
        parts = np.stack([np.full_like(a, w[0, 0]), w[0, 1] * b, w[1, 0] * a, w[1, 1] * a * b])
        out += (parts / parts.sum(0)).sum(1).reshape(2, 2)
    return out


def marginals(found: Words, feats: np.ndarray, model: Field) -> np.ndarray:
    first, length = chains(found.of)
    p = np.zeros(feats.shape[1])
    if not len(first):
        return p
    logits = np.zeros(feats.shape[1], np.float32)
    for row in feats:
        logits += model.weights[row]
    for low in range(0, len(first), BLOCK):
        f, n = first[low : low + BLOCK], length[low : low + BLOCK]
        chance = forward_backward(_padded(logits, f, n), n, model)[0]
        at = np.arange(CHAIN)[:, None]
        on = at < n
        p[(f + at)[on]] = chance[on]
    return p


def doc_features(p: np.ndarray, of: np.ndarray) -> np.ndarray:
    n = np.diff(of)
    total = np.concatenate([[0.0], np.cumsum(p)])
    mass = np.maximum(total[of[1:]] - total[of[:-1]], 0.0)
    top = np.zeros(len(n))
    np.maximum.at(top, np.repeat(np.arange(len(n)), n), p)
    return np.stack(
        [np.ones(len(n)), top, np.log1p(mass), np.minimum(20 * mass / np.maximum(n, 1), 1.0)], 1
    )


@dataclass
class Sets:
    """Distinct three-word shingles of each text, sorted, and the smallest of them under three salts."""

    shingle: np.ndarray
    size: np.ndarray  # one for each text
    least: np.ndarray  # [salt, text]


def shingle_sets(hashes: np.ndarray, of: np.ndarray) -> Sets:
    shingle, text = shingles(hashes, of, 3)
    order = np.lexsort((shingle, text))
    shingle, text = shingle[order], text[order]
    new = np.ones(len(text), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (text[1:] != text[:-1])
    shingle, text = shingle[new], text[new]
    n = len(of) - 1
    least = np.full((3, n), np.iinfo(np.uint64).max, np.uint64)
    for k, salt in enumerate((0x9E37, 0x85EB, 0xC2B2)):
        salted = (shingle ^ np.uint64(salt)) * np.uint64(0xD6E8FEB86659FD93 + 2 * salt)
        np.minimum.at(least[k], text, salted)
    return Sets(shingle, np.bincount(text, minlength=n), least)


def _first_copies(found: Words, hashes: np.ndarray) -> np.ndarray:
    """False for near copies of an earlier text that is kept."""
    return first_sets([shingle_sets(hashes, found.of)])


def first_sets(sets: list[Sets]) -> np.ndarray:
    """False for texts whose shingles are nearly those of an earlier text that is kept.

    Texts that share a smallest three-word shingle are compared by all of them.
    """
    shingle = np.concatenate([s.shingle for s in sets])
    size = np.concatenate([s.size for s in sets])
    least = np.concatenate([s.least for s in sets], 1).tolist()
    keep = np.ones(len(size), bool)
    at = np.concatenate([[0], np.cumsum(size)])
    holders: dict[tuple[int, int], list[int]] = {}
    for i in np.flatnonzero(size).tolist():
        keys = [(k, smallest[i]) for k, smallest in enumerate(least)]
        others = np.array(sorted({o for key in keys for o in holders.get(key, ())}), np.int64)
        if len(others):
            mine = shingle[at[i] : at[i + 1]]
            n = size[others]
            flat = np.concatenate([shingle[at[o] : at[o + 1]] for o in others])
            same = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
            both = np.add.reduceat(same.astype(np.int64), np.cumsum(n) - n)
            keep[i] = not (both >= COPY * (len(mine) + n - both)).any()
        if keep[i]:
            for key in keys:
                holders.setdefault(key, []).append(i)
    return keep


def _marks(feats: np.ndarray, keep: np.ndarray, of: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which features toxic documents have much more often than clean ones, of those kept."""
    size, n_docs = 1 << HASH_BITS, len(label)
    toxic, clean = np.zeros(size), np.zeros(size)
    for low in range(0, n_docs, TEXTS):
        high = min(low + TEXTS, n_docs)
        own = slice(of[low], of[high])
        text = np.repeat(np.arange(low, high), np.diff(of[low : high + 1]))
        used = keep[text]
        for row in feats:
            both = np.unique(row[own][used].astype(np.int64) * n_docs + text[used])
            bad = label[both % n_docs] == 1
            toxic += np.bincount(both[bad] // n_docs, minlength=size)
            clean += np.bincount(both[~bad] // n_docs, minlength=size)
    nt, nc = max((label[keep] == 1).sum(), 1), max((label[keep] == 0).sum(), 1)
    odds = ((toxic + 0.5) / (nt + 1)) / ((clean + 0.5) / (nc + 1))
    marks = (odds >= ODDS) & (toxic >= max(3, 0.01 * nt))
    marks[0] = False
    return marks


def fit_field(
    parts: list[Texts], label: np.ndarray, epochs: int = 6, least_steps: int = 60, seed: int = 7
) -> Field:
    """Train on whole texts, in slices, with document labels 0 and 1.

    Few texts are gone through more often, so that no fewer than ``least_steps``
    gradient steps are taken.
    """
    model = Field(
        np.zeros(1 << HASH_BITS, np.float32),
        np.array([[0.0, -3.0], [-1.0, -2.0]]),
        -3.0,
        np.array([-40.0, 0.0, 0.0, 0.0]),
    )
    if (label == 1).sum() == 0 or (label == 0).sum() == 0:
        return model
    # Part by part, so that what is held beside the feature numbers stays small.
    of = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(words(p, WORD_BYTE).of) for p in parts]))])
    feats = np.empty((1 + len(PREFIXES), int(of[-1])), np.int32)
    sets, low = [], 0
    for part in parts:
        own, numbers = features(part)
        feats[:, low : low + numbers.shape[1]] = numbers
        low += numbers.shape[1]
        sets.append(shingle_sets(Hasher(LOWER[part.data])(own.start, own.end), own.of))
    found = Words(of[:0], of[:0], of)  # where the words stand is not needed any more
    keep = first_sets(sets)
    del sets
    marks = _marks(feats, keep, of, label)
    toxic_word = np.repeat(label == 1, np.diff(of))
    toxic_word &= np.logical_or.reduce([marks[row] for row in feats])

    first, length = chains(found.of)
    chain_text = np.searchsorted(found.of, first, "right") - 1
    usable = np.flatnonzero(keep[chain_text])
    rng = np.random.default_rng(seed)
    seen_w = np.full(len(model.weights), 1e-2, np.float32)
    seen_t = np.full((2, 2), 1e-2)
    bias_grad = 1e-2
    n_parts = max(1, len(usable) // 2048)
    for _ in range(max(epochs, -(-least_steps // n_parts))):
        for part in np.array_split(rng.permutation(usable), n_parts):
            f, n = first[part], length[part]
            offset = np.cumsum(n) - n
            rows = np.repeat(f - offset, n) + np.arange(n.sum())
            emit = _padded(model.weights[feats[:, rows]].sum(0), offset, n)
            chance, ahead, behind, e = forward_backward(emit, n, model)
            gold = _padded(toxic_word.astype(np.float64), f, n)
            on = np.arange(CHAIN)[:, None] < n
            error = (chance - gold).T[on.T]
            grad = np.zeros(len(model.weights), np.float32)
            for row in feats:
                grad += np.bincount(row[rows], weights=error, minlength=len(grad)).astype(np.float32)
            grad = grad / len(part) + 1e-5 * model.weights
            grad[0] = 0
            seen_w += grad**2
            model.weights -= 0.5 * grad / np.sqrt(seen_w)
            model.weights[0] = 0
            g = gold.astype(int)
            pairs = on[1:]
            observed = np.bincount((2 * g[:-1] + g[1:])[pairs], minlength=4).reshape(2, 2)
            gt = (_expected_transitions(ahead, behind, e, n, model.trans) - observed) / len(part)
            gt[0, 0] = 0
            seen_t += gt**2
            model.trans -= 0.2 * gt / np.sqrt(seen_t)
            gs = float((chance[0] - gold[0]).mean())
            bias_grad += gs**2
            model.start -= 0.2 * gs / np.sqrt(bias_grad)
    x = doc_features(marginals(found, feats, model), found.of)
    model.doc = logistic(x[keep], label[keep].astype(float))
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        hess = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(hess, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """Fit on a bounded sample; ``labels`` holds only rows that may be learned from."""

    def fit(rows: pa.Table) -> Field:
        label = rows.column("_label").to_numpy().astype(int)
        return fit_field(list(slices(rows.column("text"), SAMPLE_BYTES)), label)

    return fitted(labelled_rows(docs, labels, "toxic", SAMPLE_ROWS, SAMPLE_CHARS), fit)


def score(texts: Texts, model: Field) -> tuple[np.ndarray, Words, np.ndarray]:
    found, feats = features(texts)
    p = marginals(found, feats, model)
    return sigmoid(doc_features(p, found.of) @ model.doc), found, p


def spans(texts: Texts, found: Words, p: np.ndarray) -> list[list[dict]]:
    """Runs of words over one half, as code point offsets with their mean marginal."""
    hit = p > 0.5
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    hits = np.flatnonzero(hit)
    text = np.searchsorted(found.of, hits, "right") - 1
    for i in np.unique(text):
        own = hits[text == i]
        data = texts.data[texts.starts[i] : texts.starts[i + 1]]
        for run in np.split(own, np.flatnonzero(np.diff(own) > 1) + 1):
            at = char_offsets(data, np.array([found.start[run[0]], found.end[run[-1]]]) - texts.starts[i])
            out[i].append({"start": int(at[0]), "end": int(at[1]), "p": float(p[run].mean())})
    return out


SCHEMA = "doc_id long, score double, spans array<struct<start: int, end: int, p: double>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def score_toxicity(docs: DataFrame, model: Field) -> DataFrame:
    """One row per document: doc_id, score in 0..1 and offending spans."""

    def run(texts: Texts, rows: pa.RecordBatch) -> pa.RecordBatch:
        value, found, p = score(texts, model)
        return arrow(
            ["doc_id", "score", "spans"],
            [rows.column("doc_id"), value, pa.array(spans(texts, found, p), _SPANS)],
        )

    return map_texts(docs.select("doc_id", "text"), run, SCHEMA)


def reject_toxic(docs: DataFrame, model: Field, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of documents whose score is below the threshold, all columns as they were."""

    def run(texts: Texts, rows: pa.RecordBatch) -> pa.RecordBatch:
        return rows.filter(pa.array(score(texts, model)[0] < threshold))

    return map_texts(docs, run, docs.schema)
