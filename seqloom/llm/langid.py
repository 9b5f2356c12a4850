"""Language identification by error-correcting output codes.

Every learned language has a codeword of +1 and -1. One binary classifier per bit,
a logistic regression on hashed byte n-grams, predicts that bit; a document gets
the language whose codeword has the smallest summed logistic loss against the
margins. Up to ``EXHAUSTIVE`` languages the code has every way to part them in two;
beyond that its columns are drawn with a fixed seed.

Defined results: ``und`` with score 0 for a null text or one without a letter; an
empty table gives an empty result; with no learned language every text is ``und``,
with one every text with a letter is that one. Ties go to the first language in
order. Repeated rows get equal results. Very long texts are read whole; they are not
learned from. Rows without an id are not learned from; of several rows with one id, one
is. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, first_by_hash, fitted, map_texts, one_text_per_id, picked_texts
from .textops import LOWER, Texts, blocks, slices

HASH_BITS = 12
EXHAUSTIVE = 7
#: At most so many labelled rows in all, none longer than so many characters, are fitted on.
SAMPLE_ROWS = 4000
SAMPLE_CHARS = 20_000
#: Texts whose n-grams are counted at a time.
ROWS = 512
#: A result is ambiguous if the best language's share of the decoding is below this.
CLEAR = 0.6

_LETTERS = LOWER.copy()
_LETTERS[:65] = _LETTERS[91:97] = _LETTERS[123:128] = 32


@dataclass
class Codes:
    languages: list[str]
    words: np.ndarray  # [language, bit], +1 or -1
    weights: np.ndarray  # [feature, bit]
    bias: np.ndarray


def ngrams(texts: Texts) -> np.ndarray:
    """[text, feature]: square roots of n-gram counts, scaled to length 1.

    Bytes of characters that are no letters count as a space; letters beyond ASCII
    stay as their bytes.
    """
    if len(texts) > ROWS:
        return np.concatenate([ngrams(part) for part in blocks(texts, ROWS)])
    n, size = len(texts), 1 << HASH_BITS
    data = _LETTERS[texts.data].astype(np.uint32)
    owner = np.repeat(np.arange(n), np.diff(texts.starts))
    ends = np.repeat(texts.starts[1:], np.diff(texts.starts))
    at = np.arange(len(data))
    out = np.zeros(n * size)
    code = data.copy()
    for width in (1, 2, 3):
        if width > 1:
            code = code[:-1] * np.uint32(256) + data[width - 1 :] if len(code) else code
        own = at[: len(code)]
        inside = own + width <= ends[: len(code)]
        bucket = ((code * np.uint32(2654435761) + np.uint32(width * 40503)) * np.uint32(2246822519)) >> np.uint32(
            32 - HASH_BITS
        )
        keys = owner[: len(code)] * size + bucket
        out += np.bincount(keys[inside], minlength=len(out))
    out = np.sqrt(out.reshape(n, size))
    return (out / np.maximum(np.sqrt((out**2).sum(1, keepdims=True)), 1e-9)).astype(np.float32)


def codewords(k: int) -> np.ndarray:
    """[language, bit] of +1 and -1, no two columns alike or opposite."""
    if k <= EXHAUSTIVE:
        # The last language is always -1, so opposite columns cannot occur.
        bits = np.arange(1, 2 ** max(k - 1, 0))
        return np.array([2 * ((bits >> i) & 1) - 1 for i in range(k)]).reshape(k, len(bits))
    rng = np.random.default_rng(11)
    n_bits = int(np.ceil(10 * np.log2(k)))
    best, apart = None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], (k, n_bits))
        near = (n_bits - (code @ code.T - n_bits * np.eye(k)).max()) // 2
        if near > apart and (np.abs(code.sum(0)) < k).all():
            best, apart = code, near
    return best


def fit_codes(x: np.ndarray, lang: list[str], steps: int = 250, ridge: float = 1e-4) -> Codes:
    """Accelerated gradient descent on all bits at once."""
    languages = sorted(set(lang))
    code = codewords(len(languages))
    bits = code.shape[1]
    w = np.zeros((1 << HASH_BITS, bits), np.float32)
    bias = np.zeros(bits, np.float32)
    if not bits:
        return Codes(languages, code, w, bias)
    own = np.searchsorted(languages, lang)
    y = code[own].astype(np.float32)
    # Languages weigh alike, however many rows each has.
    weight = (1 / np.bincount(own)[own] / len(languages)).astype(np.float32)[:, None]
    rate = 4 / (1 + 4 * ridge)  # rows have length 1 and weights sum to 1
    w_prev, b_prev = w, bias
    for t in range(steps):
        pull = t / (t + 3)
        wy, by = w + pull * (w - w_prev), bias + pull * (bias - b_prev)
        margin = x @ wy + by
        grad = -weight * y / (1 + np.exp(np.clip(y * margin, -30, 30)))
        w_prev, b_prev = w, bias
        w = wy - rate * (x.T @ grad + ridge * wy)
        bias = by - rate * grad.sum(0)
    return Codes(languages, code, w, bias)


def train(docs: DataFrame) -> Codes:
    """Fit on a bounded sample of rows with a language; ``docs`` holds only rows to learn from.

    Ids are taken per language in the order of a hash of the id, ``SAMPLE_ROWS`` in all; an
    id with several rows counts once.
    """
    known = one_text_per_id(docs.where(F.col("lang").isNotNull()), SAMPLE_CHARS, "lang")
    n_languages = max(known.agg(F.approx_count_distinct("lang")).first()[0], 1)
    picked = first_by_hash(known, "lang", max(SAMPLE_ROWS // n_languages, 1))
    # More than SAMPLE_ROWS only if there are more languages than that, or counted too low.
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)

    def fit(rows: pa.Table) -> Codes:
        parts = [ngrams(s) for s in slices(rows.column("text"))]
        x = np.concatenate(parts) if parts else np.empty((0, 1 << HASH_BITS), np.float32)
        return fit_codes(x, rows.column("_lang").to_pylist())

    return fitted(picked_texts(docs, picked.withColumnRenamed("lang", "_lang"), SAMPLE_CHARS), fit)


def decode(x: np.ndarray, model: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest language and its share of exp(-loss), summed over bits."""
    margin = np.clip(x @ model.weights + model.bias, -30, 30)
    loss = np.stack([np.log1p(np.exp(-margin * word)).sum(1) for word in model.words], 1)
    share = np.exp(loss.min(1, keepdims=True) - loss)
    return loss.argmin(1), share.max(1) / share.sum(1)


SCHEMA = "doc_id long, lang_pred string, score double, ambiguous boolean"


def identify(docs: DataFrame, model: Codes) -> DataFrame:
    """One row per document: doc_id, lang_pred, score in 0..1 and whether it is ambiguous."""
    names = np.array([*model.languages, "und"], dtype=object)

    def run(texts: Texts, rows: pa.RecordBatch) -> pa.RecordBatch:
        if len(model.languages):
            parts = [decode(ngrams(part), model) for part in blocks(texts, ROWS)]
            best, share = (np.concatenate(x) for x in zip(*parts, strict=True))
        else:
            best, share = np.full(len(texts), -1), np.zeros(len(texts))
        known = rows.column("_letter").to_numpy(zero_copy_only=False).astype(bool) & (best >= 0)
        score = np.where(known, share, 0.0).astype(np.float64)
        return arrow(
            ["doc_id", "lang_pred", "score", "ambiguous"],
            [
                rows.column("doc_id"),
                pa.array(names[np.where(known, best, -1)], pa.string()),
                score,
                score < CLEAR,
            ],
        )

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letter")
    return map_texts(docs.select("doc_id", "text", letter), run, SCHEMA)
