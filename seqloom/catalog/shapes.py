"""Scoring queries at the shapes that models are shipped in: inputs, widths and heads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attention, features
from ..operators.attention import FoldModel, models_from_table, models_to_table
from . import shaped_sql as s
from . import views as v
from .registry import query

# Kernel, channels and hidden units of the one-hot model; units of the deep head.
ONEHOT = {"kernel": 5, "channels": 20, "hidden": 32}
DEEP = (256, 64, 32)
#: An embedding of 64 values stands for 8 residues of 8 values each.
WIDTH = PLACES = 8


def _scored(spark: SparkSession, df: DataFrame, models: list[FoldModel], mode: str, encoding: str) -> DataFrame:
    """Scores of every fold, with weights that go through the weights table."""
    models = models_from_table(models_to_table(spark, models, "formula"), "formula")
    scored = attention.score_folds(df, models, mode, encoding, with_residues=False)
    return scored.where(F.col("ensemble_score").isNotNull()).select(
        "seq_id",
        *[v.r6(F.col("fold_scores")[f]).alias(f"{f}_seq_score") for f in v.FOLDS],
        v.r6(F.col("ensemble_score")).alias("ensemble_seq_score"),
    )


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.sequences(spark, sf_dir).select("seq_id", "sequence")


@query("score_folds_onehot", s.onehot_sql(5, 20, 32))
def score_folds_onehot(spark, sf_dir):
    """One-hot input, five taps, 20 channels, 32 hidden units with a batch norm."""
    models = v.fold_models(width=len(v.ALPHABET), **ONEHOT)
    return _scored(spark, _sequences(spark, sf_dir), models, "weighted_mean_three", "onehot")


@query("score_folds_deep", s.deep_sql(4, DEEP))
def score_folds_deep(spark, sf_dir):
    """Three hidden layers on a single convolution, without attention."""
    models = v.fold_models(channels=4, hidden=DEEP, width=len(v.ALPHABET))
    return _scored(spark, _sequences(spark, sf_dir), models, "mean_single_conv", "onehot")


@query("score_folds_linear", s.linear_sql(4, 2))
def score_folds_linear(spark, sf_dir):
    """A head without hidden layer whose two outputs are averaged."""
    models = v.fold_models(channels=4, hidden=(), width=len(v.ALPHABET), outputs=2)
    return _scored(spark, _sequences(spark, sf_dir), models, "weighted_mean_two", "onehot")


@query("score_residue_embeddings", s.vector_sql(WIDTH, PLACES, 4, 32))
def score_residue_embeddings(spark, sf_dir):
    """Attach stacks of residue vectors, take the last layer, cut it to the sequence, score."""
    residue = F.transform(F.sequence(F.lit(0), F.lit(PLACES - 1)), lambda i: F.slice("embedding", WIDTH * i + 1, WIDTH))
    stacks = v.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.array(F.array(), residue.cast("array<array<double>>")).alias("layers")
    )
    joined, _ = features.attach_embeddings(
        _sequences(spark, sf_dir), stacks, "seq_id", "vec_id", "layers", layer=-1, n_layers=2,
        cut_to=F.least(F.length("sequence"), F.lit(PLACES)),
    )
    models = v.fold_models(channels=4, hidden=32, width=WIDTH)
    return _scored(spark, joined.select("seq_id", "embedding"), models, "weighted_mean_three", "embedding")
