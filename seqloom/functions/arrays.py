"""Column expressions on per-sequence arrays.

A sequence is one row, its residue values one ragged array. Softmax, pooling
and ensembles over positions then need no shuffle: everything a sequence
needs is in its own row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import MIN_TEMPERATURE, POOL_MODES


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Array lambdas are interpreted: an aggregate written inside one runs again
    for every element, which makes a softmax quadratic in sequence length.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def array_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)


def array_mean(arr: Column) -> Column:
    return let(arr, lambda a: F.when(F.size(a) > 0, array_sum(a) / F.size(a)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def softmax(arr: Column, temperature: Column | float = 1.0) -> Column:
    t = _as_column(temperature)

    def weights(a: Column) -> Column:
        return let(
            F.struct(F.array_max(a).alias("top"), t.alias("t")),
            lambda s: F.transform(a, lambda v: F.exp((v - s["top"]) / s["t"])),
        )

    return let(arr, lambda a: let(weights(a), _normalise))


def _normalise(weights: Column) -> Column:
    return let(array_sum(weights), lambda norm: F.transform(weights, lambda w: w / norm))


def sigmoid_array(arr: Column) -> Column:
    return F.transform(arr, sigmoid)


def elementwise_mean(arrays: list[Column]) -> Column:
    """Position-wise mean of equally long arrays."""
    total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), arrays)
    n = float(len(arrays))
    return F.transform(total, lambda v: v / F.lit(n))


def residue_scores(mode: str, logits: Column) -> Column:
    """Residue values as shown to the user; logits where the mode keeps them raw."""
    return logits if residue_score_kind(mode) == "logit" else sigmoid_array(logits)


def residue_score_kind(mode: str) -> str:
    check_mode(mode)
    return "logit" if mode in ("sum", "weighted_mean_two") else "probability"


def weighted_residues(mode: str, logits: Column, temperature: Column | float = 1.0) -> Column:
    """Sigmoid times softmax weight, per position (the weighted modes only)."""
    if mode in ("weighted_mean", "weighted_mean_single_conv"):
        weigh = lambda o, p: softmax(p)
    elif mode == "weighted_mean_two":
        weigh = lambda o, p: softmax(o)
    elif mode == "weighted_mean_three":
        floor = F.greatest(_as_column(temperature), F.lit(MIN_TEMPERATURE))
        weigh = lambda o, p: softmax(o, floor)
    else:
        raise ValueError(f"{mode} has no weighted residues")
    return let(
        F.struct(logits.alias("o"), sigmoid_array(logits).alias("p")),
        lambda s: F.zip_with(s["p"], weigh(s["o"], s["p"]), lambda p, w: p * w),
    )


def pool_scores(mode: str, logits: Column, temperature: Column | float = 1.0) -> Column:
    """One sequence score from its residue logits."""
    check_mode(mode)
    if mode == "max":
        return sigmoid(F.array_max(logits))
    if mode in ("mean", "mean_single_conv"):
        return array_mean(sigmoid_array(logits))
    if mode == "sum":
        return sigmoid(array_sum(logits))
    score = array_sum(weighted_residues(mode, logits, temperature))
    if mode in ("weighted_mean_two", "weighted_mean_three"):
        score = F.least(score, F.lit(1.0))
    return score


def check_mode(mode: str) -> None:
    if mode not in POOL_MODES:
        raise ValueError(f"unknown pooling mode {mode!r}; choose one of {POOL_MODES}")


def _as_column(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))
