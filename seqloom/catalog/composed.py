"""Composed models with data columns: their features, and what they predict."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.features import rbf_centers
from ..plans.pipeline import PipelineConfig, compose_pipeline
from . import views as v
from .registry import query

KERNELS = 10
_CENTERS = ", ".join(f"({k}, {c!r}::DOUBLE)" for k, c in enumerate(rbf_centers(-1.0, 1.0, KERNELS)))


@query(
    "compose_data_features",
    f"""WITH {v.FEATURED}, train AS (SELECT * FROM featured WHERE data_split = 'train'),
    long AS (SELECT seq_id, data_split, unnest(range(64)) AS i, unnest(embedding) AS x FROM featured),
    moments AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM long WHERE data_split = 'train' GROUP BY i),
    middle AS (SELECT quantile_cont(chars, 0.5) AS c,
      coalesce(nullif(quantile_cont(chars, 0.75) - quantile_cont(chars, 0.25), 0), 1) AS s FROM train),
    centers(k, center) AS (VALUES {_CENTERS}),
    langs AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS j FROM (SELECT DISTINCT lang FROM train))
    SELECT seq_id, i::INT AS i, {v.sql_r6("(x - m) / coalesce(nullif(s, 0), 1)")} AS value FROM long JOIN moments USING (i)
    UNION ALL SELECT seq_id, (64 + k)::INT, {v.sql_r6("exp(-pow(((chars - c) / s - center) / 0.2::DOUBLE, 2))")}
      FROM featured, middle, centers
    UNION ALL SELECT seq_id, ({64 + KERNELS} + j)::INT, (featured.lang = langs.lang)::INT::DOUBLE FROM featured, langs""",
)
def compose_data_features(spark, sf_dir):
    """Every feature value: standardised vector, kernels of a scaled number, one-hot category."""
    df = v.featured_vectors(spark, sf_dir)
    config = PipelineConfig(
        embedder="Precomputed",
        add_data_columns=True,
        data_columns_dimred=["data_chars"],
        rbf_n_kernels=KERNELS,
        standardize_embedding=True,
    )
    made = compose_pipeline(df, config).features(df)
    return made.select("seq_id", F.posexplode("features").alias("i", "value")).withColumn("value", v.r6(F.col("value")))


@query("compose_data_columns")
def compose_data_columns(spark, sf_dir):
    """Classes from vector and number through PCA, and the category beside it."""
    df = v.featured_vectors(spark, sf_dir)
    config = PipelineConfig(
        embedder="Precomputed",
        dimred="PCADimReduction",
        add_data_columns=True,
        data_columns_dimred=["data_chars"],
        standardize_embedding=True,
    )
    return compose_pipeline(df, config).apply(df).select("seq_id", "data_split", "y", "y_pred", "y_pred_prob")


@query("compose_regression")
def compose_regression(spark, sf_dir):
    """A number from vector and data columns; targets are scaled for training and restored."""
    df = v.featured_vectors(spark, sf_dir)
    config = PipelineConfig(
        embedder="Precomputed",
        predictor="TorchMLP",
        task="regression",
        add_data_columns=True,
        target_scaling="StandardScaler",
        predictor_options={"hidden": 16, "rate": 0.05, "patience": 5},
    )
    return compose_pipeline(df, config).apply(df).select("seq_id", "data_split", "y", "y_pred")
