"""Splits, folds and weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import seeded_rank

SPLITS = ("train", "val", "test")


def predefined_split(
    df: DataFrame, split_column: str = "data_split", train_mode: bool = True
) -> DataFrame:
    """Rows per split; fails when a split the mode needs is empty."""
    counts = df.agg(*[F.count_if(F.col(split_column) == s).alias(s) for s in SPLITS])
    needed = ("train", "test") if train_mode else ("test",)
    message = F.lit(f"empty split among {needed}")
    ok = F.lit(True)
    for s in needed:
        ok = ok & (F.col(s) > 0)
    counts = counts.withColumn("test", F.when(ok, F.col("test")).otherwise(F.raise_error(message)))
    return counts.unpivot([], list(SPLITS), "data_split", "n_rows")


def random_split(
    df: DataFrame,
    fractions: dict[str, float],
    seed: int = 42,
    key: str = "seq_id",
    out: str = "data_split",
) -> DataFrame:
    """Seeded split with exact sizes; ``val`` of 0 gives the two-way form.

    Same rows for the same seed, whatever the partitioning.
    """
    train, val, test = (float(fractions.get(s, 0.0)) for s in SPLITS)
    if abs(train + val + test - 1.0) > 1e-9:
        raise ValueError("split fractions must sum to 1")
    ranked = seeded_rank(df, key, seed)
    n_train = F.floor(F.col("_total") * F.lit(train) + F.lit(1e-9))
    share = val / (val + test) if val > 0 else 0.0
    n_val = F.floor((F.col("_total") - n_train) * F.lit(share) + F.lit(1e-9))
    name = (
        F.when(F.col("_rank") < n_train, F.lit("train"))
        .when(F.col("_rank") < n_train + n_val, F.lit("val"))
        .otherwise(F.lit("test"))
    )
    return ranked.withColumn(out, name).drop("_rank", "_total")


def random_split_2way(
    df: DataFrame, train: float, seed: int = 42, key: str = "seq_id"
) -> DataFrame:
    return random_split(df, {"train": train, "val": 0.0, "test": 1.0 - train}, seed, key)


def random_split_3way(
    df: DataFrame, train: float, val: float, test: float, seed: int = 42, key: str = "seq_id"
) -> DataFrame:
    return random_split(df, {"train": train, "val": val, "test": test}, seed, key)


def split_view(df: DataFrame, split: str, split_column: str = "data_split") -> DataFrame:
    return df.where(F.col(split_column) == split)


def fold_columns_to_long(
    df: DataFrame, ids: list[str], prefix: str = "data_split_", folds: list[str] | None = None
) -> DataFrame:
    """Wide ``data_split_foldK`` columns to rows (ids, fold, data_split)."""
    columns = [prefix + f for f in folds] if folds else [
        c for c in df.columns if c.startswith(prefix)
    ]
    return df.unpivot(ids, columns, "fold", "data_split").withColumn(
        "fold", F.expr(f"substring(fold, {len(prefix) + 1})")
    )


def stratified_folds(
    df: DataFrame, label: str, k: int, seed: int = 42, key: str = "seq_id", out: str = "fold"
) -> DataFrame:
    """Fold number per row; every label is spread evenly over the folds."""
    ranked = seeded_rank(df, key, seed, within=[label])
    return ranked.withColumn(out, (F.col("_rank") % k).cast("int")).drop("_rank", "_total")


def sample_weights(
    df: DataFrame, weight_column: str | None = "sample_weight", split_column: str = "data_split"
) -> DataFrame:
    """Weight for training rows; 1 where no weight column is used."""
    if weight_column is None:
        weight = F.lit(1.0)
    else:
        weight = F.col(weight_column).cast("double")
    used = F.when(F.col(split_column) == "train", weight)
    return df.withColumn("weight", used)


def fit_class_weights(
    df: DataFrame, label: str = "value_bool", classes: Sequence[float] = (0.0, 1.0)
) -> dict[float, float]:
    """n / (classes present * n_class) per label, from one aggregate row.

    ``classes`` is the label's domain; a label outside it is an error, however
    many there are. A class without rows gets no weight.
    """
    value = F.col(label).cast("double")
    row = df.agg(
        F.count(value).alias("total"),
        *[F.count_if(value == c).alias(f"n{i}") for i, c in enumerate(classes)],
    ).first()
    counts = {float(c): row[f"n{i}"] for i, c in enumerate(classes) if row[f"n{i}"]}
    if sum(counts.values()) != row["total"]:
        raise ValueError(f"{label} has values outside {tuple(classes)}")
    return {c: row["total"] / (len(counts) * n) for c, n in sorted(counts.items())}


def balanced_class_weight(df: DataFrame, label: str = "value_bool") -> DataFrame:
    """Add ``class_weight``; unlabeled rows get null. No join: weights are literals."""
    weights = fit_class_weights(df, label)
    lookup = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return df.withColumn("class_weight", lookup[F.col(label).cast("double")])
