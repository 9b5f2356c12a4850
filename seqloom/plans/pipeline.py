"""Composed model: encode, join features, reduce, reduce-exempt features, predict.

Stages are chosen by name from registries. ``fit`` returns a ``FittedPipeline``
whose ``apply`` is one lazy plan; its parameters are saved as small tables.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import PCA_VARIANCE, RBF_KERNELS
from ..functions.ragged import list_array
from ..operators.attention import (
    WEIGHTS_SCHEMA,
    FoldModel,
    models_from_table,
    models_to_arrow,
    score_folds,
)
from ..operators.checks import feature_channels, select_feature_columns, select_target
from ..operators.dimred import Components, apply_pca, fit_pca
from ..operators.features import Categories, assemble_features, fit_categorical, rbf_expand
from ..operators.gradient import MlpModel, fit_attention, fit_mlp_regression, mlp_regression_score
from ..operators.linear import LinearModel, logreg_grid_cv, logreg_score
from ..operators.residues import encoded_array, mean_pool, mean_pool_letters
from ..operators.scalers import (
    Scaler,
    VectorScaler,
    fit_minmax_scaler,
    fit_robust_scaler,
    fit_target_scaler,
    fit_vector_scaler,
    restore_target,
)

KINDS = ("embedder", "dimred", "predictor")


@dataclass
class Stage:
    """``fit(train_df, options) -> state``; ``apply(df, state, options) -> df``."""

    fit: Callable[[DataFrame, dict], Any]
    apply: Callable[[DataFrame, Any, dict], DataFrame]
    to_rows: Callable[[Any], pa.Table] | None = None
    from_rows: Callable[[DataFrame], Any] | None = None


_STAGES: dict[tuple[str, str], Stage] = {}


def register_stage(kind: str, name: str, stage: Stage) -> None:
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    _STAGES[kind, name] = stage


def stage(kind: str, name: str) -> Stage:
    try:
        return _STAGES[kind, name]
    except KeyError:
        known = sorted(n for k, n in _STAGES if k == kind)
        raise ValueError(f"unknown {kind} {name!r}; registered: {known}") from None


@dataclass
class PipelineConfig:
    """Plain-dict style configuration of a composed model."""

    embedder: str = "ZScale"
    embedder_options: dict = field(default_factory=dict)
    dimred: str = "NoReduction"
    dimred_options: dict = field(default_factory=dict)
    predictor: str = "LogisticRegression"
    predictor_options: dict = field(default_factory=dict)
    task: str = "classification_binary"
    add_data_columns: Any = False
    data_columns_standard: Any = False
    data_columns_dimred: Any = False
    data_scaler: str | None = "RobustScaler"
    rbf: bool = True
    rbf_n_kernels: int = RBF_KERNELS
    standardize_embedding: bool = False
    target_scaling: str | None = None
    split_column: str = "data_split"
    sample_weight: str | None = None
    data_name: str | None = None

    def model_name(self) -> str:
        """Embedder, predictor and data name, underscores dropped, joined by one."""
        parts = (self.embedder, self.predictor, self.data_name or "")
        return "_".join(p.replace("_", "") for p in parts)


@dataclass
class FittedPipeline:
    config: PipelineConfig
    columns: dict[str, list[str]]
    channels: dict[str, str]
    encoders: dict[str, Categories]
    scaler: Scaler | None
    vector_scaler: VectorScaler | None
    target_scaler: Scaler
    dimred_state: Any
    predictor_state: Any
    report: list[dict] = field(default_factory=list)

    def features(self, df: DataFrame) -> DataFrame:
        """Add ``features``: reduced(embedding ++ features) ++ other features."""
        c = self.config
        df = _embed(df, c)
        if c.predictor_options.get("residue"):
            return df
        columns = df.columns
        for n in self.columns["add"]:
            if n in self.encoders:
                df = self.encoders[n].attach(df, f"_index_{n}")
        if self.vector_scaler is not None:
            df = df.withColumn("embedding", self.vector_scaler.forward(F.col("embedding")))
        reduced = [n for n in self.columns["add"] if n in self.columns["dimred"]]
        others = [n for n in self.columns["add"] if n not in self.columns["dimred"]]
        df = df.withColumn(
            "features", assemble_features(F.col("embedding"), *[self._channel(n) for n in reduced])
        )
        df = stage("dimred", c.dimred).apply(df, self.dimred_state, c.dimred_options)
        if others:
            df = df.withColumn(
                "features", assemble_features(F.col("features"), *[self._channel(n) for n in others])
            )
        return df.drop(*[f"_index_{n}" for n in self.encoders if f"_index_{n}" not in columns])

    def _channel(self, name: str) -> Column:
        if self.channels[name] == "categorical":
            return self.encoders[name].one_hot(F.col(f"`_index_{name}`"))
        x = F.col(name).cast("double")
        if self.scaler is not None:
            x = self.scaler.forward(name, x)
        return rbf_expand(x, n_kernels=self.config.rbf_n_kernels) if self.config.rbf else F.array(x)

    def apply(self, df: DataFrame) -> DataFrame:
        """Add ``y`` (null if unlabeled), ``y_pred`` and, for classes, ``y_pred_prob``."""
        c = self.config
        df = select_target(df, c.task)
        df = self.features(df)
        df = stage("predictor", c.predictor).apply(df, self.predictor_state, c.predictor_options)
        if c.task == "regression":
            df = restore_target(df, self.target_scaler)
        return df


def _embed(df: DataFrame, c: PipelineConfig) -> DataFrame:
    return stage("embedder", c.embedder).apply(df, None, c.embedder_options)


def compose_pipeline(df: DataFrame, config: PipelineConfig) -> FittedPipeline:
    """Fit every stage on the train rows (trainers also see val)."""
    c = config
    split = F.col(c.split_column)
    columns = select_feature_columns(
        df, c.add_data_columns, c.data_columns_standard, c.data_columns_dimred, c.split_column
    )
    channels = feature_channels(df, columns["add"])
    train = df.where(split == "train")
    real = [n for n, kind in channels.items() if kind == "real"]
    scaler = None
    if real and c.data_scaler == "RobustScaler":
        scaler = fit_robust_scaler(train, real)
    elif real and c.data_scaler == "MinMaxScaler":
        scaler = fit_minmax_scaler(train, real, (-1.0, 1.0))
    elif real and c.data_scaler is not None:
        raise ValueError(f"unknown data scaler {c.data_scaler!r}")
    encoders = {
        n: fit_categorical(train, n) for n, kind in channels.items() if kind == "categorical"
    }
    labeled = select_target(df, c.task)
    target_scaler = fit_target_scaler(
        labeled.where((split == "train") & F.col("y").isNotNull()),
        c.target_scaling if c.task == "regression" else None,
    )
    fitted = FittedPipeline(
        c, columns, channels, encoders, scaler, None, target_scaler, None, None
    )
    if c.task == "regression":
        labeled = labeled.withColumn("y", target_scaler.forward("y"))

    if c.predictor_options.get("residue"):
        state = stage("predictor", c.predictor).fit(_embed(labeled, c), _with_split(c))
    else:
        if c.standardize_embedding:
            fitted.vector_scaler = fit_vector_scaler(_embed(train, c), "embedding")
        plain = PipelineConfig(**{**c.__dict__, "dimred": "NoReduction"})
        reduced_only = {**columns, "add": columns["dimred"]}
        before = FittedPipeline(
            plain, reduced_only, channels, encoders, scaler, fitted.vector_scaler, target_scaler, None, None
        )
        fitted.dimred_state = stage("dimred", c.dimred).fit(before.features(train), c.dimred_options)
        state = stage("predictor", c.predictor).fit(fitted.features(labeled), _with_split(c))
    fitted.predictor_state, fitted.report = state
    return fitted


def _with_split(c: PipelineConfig) -> dict:
    return {"split_column": c.split_column, "sample_weight": c.sample_weight, **c.predictor_options}


# -- built-in stages -----------------------------------------------------------


def _letter_embedder(kind: str) -> Stage:
    def apply(df: DataFrame, state: Any, options: dict) -> DataFrame:
        if options.get("mean_pool", True):
            return df.withColumn("embedding", mean_pool_letters(F.col("sequence"), kind))
        return df.withColumn("embedding", encoded_array(F.col("sequence"), kind))

    return Stage(lambda df, options: None, apply)


def _apply_precomputed(df: DataFrame, state: Any, options: dict) -> DataFrame:
    """Vectors already in the ``embedding`` column; residue vectors may be pooled."""
    if options.get("mean_pool"):
        return df.withColumn("embedding", mean_pool(F.col("embedding"), options["width"]))
    return df


def _fit_logreg(df: DataFrame, options: dict) -> tuple[LinearModel, list[dict]]:
    train = df.where(F.col(options["split_column"]) == "train")
    keys = ("c_values", "penalties", "n_splits", "class_weight", "max_iter", "seed", "key")
    result = logreg_grid_cv(
        train, weight=options.get("sample_weight"), **{k: options[k] for k in keys if k in options}
    )
    return result.model, result.table


def _fit_attention_stage(df: DataFrame, options: dict) -> tuple[FoldModel, list[dict]]:
    skip = ("split_column", "sample_weight", "residue")
    model, fit = fit_attention(
        df,
        label="y",
        split=options["split_column"],
        **{k: v for k, v in options.items() if k not in skip},
    )
    return model, fit.history


def _apply_attention_stage(df: DataFrame, model: FoldModel, options: dict) -> DataFrame:
    mode = options.get("mode", "weighted_mean_three")
    scored = score_folds(df, [model], mode, options.get("encoding", "zscale"))
    prob = F.col("fold_scores")[model.fold]
    return scored.withColumns(
        {
            "y_pred_prob": prob,
            "y_pred": (prob >= F.lit(model.cutoff)).cast("int"),
            "residue_scores": F.col("fold_residues")[model.fold],
        }
    ).drop(
        "fold_scores", "fold_residues", "fold_penalties", "ensemble_residues", "ensemble_score"
    )


def _fit_mlp(df: DataFrame, options: dict) -> tuple[MlpModel, list[dict]]:
    skip = ("split_column", "sample_weight")
    model, fit = fit_mlp_regression(
        df, split=options["split_column"], **{k: v for k, v in options.items() if k not in skip}
    )
    return model, fit.history


#: Values per row of a stored array.
PIECE = 1 << 20
_ARRAY_SCHEMA = "name string, width int, start long, values array<double>"


def _array_table(**arrays: np.ndarray) -> pa.Table:
    """(name, width, start, values): arrays in pieces, row after row of ``width`` values."""
    names, widths, starts, pieces = [], [], [], []
    for name, a in arrays.items():
        a = np.atleast_2d(np.asarray(a, dtype=float))
        flat = a.ravel()
        for at in range(0, max(len(flat), 1), PIECE):
            names.append(name)
            widths.append(a.shape[1])
            starts.append(at)
            pieces.append(flat[at : at + PIECE])
    values = list_array(np.concatenate(pieces), np.array([len(p) for p in pieces]))
    return pa.table(
        [pa.array(names), pa.array(widths, pa.int32()), pa.array(starts, pa.int64()), values],
        names=["name", "width", "start", "values"],
    )


def _arrays(table: DataFrame) -> dict[str, np.ndarray]:
    rows = table.toArrow().sort_by([("name", "ascending"), ("start", "ascending")])
    values, pieces, widths = rows.column("values"), {}, {}
    for n, (name, width) in enumerate(zip(*[rows.column(c).to_pylist() for c in ("name", "width")], strict=True)):
        pieces.setdefault(name, []).append(values[n].values.to_numpy(zero_copy_only=False))
        widths[name] = width
    return {name: np.concatenate(own).reshape(-1, widths[name]) for name, own in pieces.items()}


def _pca_from(table: DataFrame) -> Components:
    a = _arrays(table)
    return Components(a["weights"], [float(v) for v in a["explained"][0]])


def _linear_from(table: DataFrame) -> LinearModel:
    a = _arrays(table)
    return LinearModel([float(v) for v in a["coefficients"][0]], float(a["intercept"][0, 0]))


def _mlp_from(table: DataFrame) -> MlpModel:
    a = _arrays(table)
    return MlpModel(a["weight"], a["bias"][0], a["out_weight"][0], float(a["out_bias"][0, 0]))


register_stage("embedder", "OneHot", _letter_embedder("onehot"))
register_stage("embedder", "ZScale", _letter_embedder("zscale"))
register_stage("embedder", "Precomputed", Stage(lambda df, options: None, _apply_precomputed))
register_stage(
    "dimred", "NoReduction", Stage(lambda df, options: None, lambda df, state, options: df)
)
register_stage(
    "dimred",
    "PCADimReduction",
    Stage(
        lambda df, options: fit_pca(
            df, "features", options.get("fraction_variance_explained", PCA_VARIANCE)
        ),
        lambda df, state, options: apply_pca(df, "features", state, "features"),
        lambda s: _array_table(weights=s.weights, explained=s.explained),
        _pca_from,
    ),
)
register_stage(
    "predictor",
    "LogisticRegression",
    Stage(
        _fit_logreg,
        lambda df, state, options: logreg_score(df, state),
        lambda s: _array_table(coefficients=s.coefficients, intercept=[s.intercept]),
        _linear_from,
    ),
)
register_stage(
    "predictor",
    "TorchMLP",
    Stage(
        _fit_mlp,
        lambda df, state, options: mlp_regression_score(df, state),
        lambda s: _array_table(
            weight=s.weight, bias=s.bias, out_weight=s.out_weight, out_bias=[s.out_bias]
        ),
        _mlp_from,
    ),
)
register_stage(
    "predictor",
    "LightAttention",
    Stage(
        _fit_attention_stage,
        _apply_attention_stage,
        lambda s: models_to_arrow([s], "model"),
        lambda table: models_from_table(table, "model")[0],
    ),
)


# -- persistence ---------------------------------------------------------------


MANIFEST = "_manifest"


def _filesystem(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _contents(spark: SparkSession, path: str) -> dict[str, list]:
    """Length and SHA-256 of each file below ``path``, by its name from there."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "part-*")
        .load(path)
        .select("path", "length", F.sha2("content", 256).alias("sha"))
        .collect()  # one short row per file of a model
    )
    base = path.rstrip("/").rsplit("/", 1)[-1]
    return {
        name: [r["length"], r["sha"]]
        for r in files
        if not (name := r["path"].split(f"/{base}/", 1)[-1]).startswith(f"{MANIFEST}/")
    }


def save_pipeline(spark: SparkSession, fitted: FittedPipeline, path: str) -> None:
    """Write config, dictionaries, scalers, reduction, predictor and report below ``path``.

    All is written under a temporary name, then a manifest of every file's length and
    digest, and only then gets its name; a run that breaks off leaves nothing under it.
    An existing target is never overwritten.
    """
    path = path.rstrip("/")
    fs, target = _filesystem(spark, path)
    if fs.exists(target):
        raise FileExistsError(f"{path} exists")
    held = f"{path}.writing-{uuid.uuid4().hex}"
    head = {
        "config": fitted.config.__dict__,
        "columns": fitted.columns,
        "channels": fitted.channels,
        "encoders": {n: [e.size, e.frequent] for n, e in fitted.encoders.items()},
        "scaler": fitted.scaler.__dict__ if fitted.scaler else None,
        "vector_scaler": fitted.vector_scaler.__dict__ if fitted.vector_scaler else None,
        "target_scaler": fitted.target_scaler.__dict__,
        "report": fitted.report,
    }
    _text(spark, json.dumps(head), f"{held}/config")
    for n, encoder in enumerate(fitted.encoders.values()):
        encoder.rows.write.parquet(f"{held}/encoders/{n}")
    for kind, state in (("dimred", fitted.dimred_state), ("predictor", fitted.predictor_state)):
        to_rows = stage(kind, getattr(fitted.config, kind)).to_rows
        if to_rows is not None and state is not None:
            rows = to_rows(state)
            schema = _ARRAY_SCHEMA if "start" in rows.schema.names else WEIGHTS_SCHEMA
            spark.createDataFrame(rows, schema).write.parquet(f"{held}/{kind}")
    _text(spark, json.dumps(_contents(spark, held)), f"{held}/{MANIFEST}")
    if not fs.rename(_filesystem(spark, held)[1], target):
        raise FileExistsError(f"{path} could not be taken")


def _text(spark: SparkSession, value: str, path: str) -> None:
    spark.createDataFrame([(value,)], "value string").coalesce(1).write.text(path)


def load_pipeline(spark: SparkSession, path: str) -> FittedPipeline:
    """Read a saved model; refused unless every file is there as the manifest has it."""
    path = path.rstrip("/")
    fs, place = _filesystem(spark, f"{path}/{MANIFEST}/_SUCCESS")
    if not fs.exists(place):
        raise FileNotFoundError(f"{path} holds no complete model")
    wanted = json.loads(spark.read.text(f"{path}/{MANIFEST}").first()[0])
    if (found := _contents(spark, path)) != wanted:
        wrong = sorted(n for n in {*wanted, *found} if wanted.get(n) != found.get(n))
        raise ValueError(f"{path} differs from its manifest in {wrong}")
    head = json.loads(spark.read.text(f"{path}/config").first()[0])
    config = PipelineConfig(**head["config"])
    states = {}
    for kind in ("dimred", "predictor"):
        from_rows = stage(kind, getattr(config, kind)).from_rows
        there = any(n.startswith(f"{kind}/") for n in wanted)
        states[kind] = from_rows(spark.read.parquet(f"{path}/{kind}")) if from_rows is not None and there else None
    return FittedPipeline(
        config,
        head["columns"],
        head["channels"],
        {
            n: Categories(n, spark.read.parquet(f"{path}/encoders/{k}"), *facts)
            for k, (n, facts) in enumerate(head["encoders"].items())
        },
        Scaler(**head["scaler"]) if head["scaler"] else None,
        VectorScaler(**head["vector_scaler"]) if head["vector_scaler"] else None,
        Scaler(**head["target_scaler"]),
        states["dimred"],
        states["predictor"],
        head["report"],
    )
