"""Principal components, fitted on training rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import PCA_VARIANCE


@dataclass
class Components:
    """``weights`` is (input dims, kept components); ``explained`` covers all."""

    weights: np.ndarray
    explained: list[float]

    @property
    def n_components(self) -> int:
        return self.weights.shape[1]


def components_needed(explained: list[float], fraction: float, width: int) -> int:
    return min(width, int((np.cumsum(explained) < fraction).sum()) + 1)


def fit_pca(df: DataFrame, column: str, fraction: float = PCA_VARIANCE) -> Components:
    """Fewest components whose share of the variance reaches ``fraction``.

    The covariance is summed on the executors; only the h x h result is
    decomposed on the driver.
    """
    vectors = df.select(array_to_vector(F.col(column).cast("array<double>")).alias("x"))
    width = len(df.select(column).first()[0])
    model = PCA(k=width, inputCol="x", outputCol="z").fit(vectors)
    explained = [float(v) for v in model.explainedVariance.toArray()]
    keep = components_needed(explained, fraction, width)
    return Components(np.array(model.pc.toArray())[:, :keep], explained)


def apply_pca(df: DataFrame, column: str, components: Components, out: str = "components") -> DataFrame:
    """Rows times components, uncentred as when fitted models are applied."""
    shared = df.sparkSession.sparkContext.broadcast(components.weights)

    @F.pandas_udf("array<double>")
    def project(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(vectors.to_numpy()).astype(float) @ shared.value))

    return df.withColumn(out, project(F.col(column).cast("array<double>")))


def pca_scatter_points(
    df: DataFrame, column: str, components: Components, keep: list[str]
) -> DataFrame:
    """First two components with the label and split columns in ``keep``."""
    projected = apply_pca(df, column, components, "_pc")
    return projected.select(
        *keep, F.col("_pc")[0].alias("pc1"), F.get(F.col("_pc"), F.lit(1)).alias("pc2")
    )
