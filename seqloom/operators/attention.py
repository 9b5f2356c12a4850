"""Attention scorer: convolutions, head, pooling, all folds in one pass.

Every sequence is one row, so scoring needs no shuffle: Spark partitions the
rows, a task scores its Arrow batches with NumPy, and weights travel once per
job as a broadcast variable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import attention_math as am
from ..functions import ragged
from ..functions.arrays import array_mean, check_mode, weighted_residues
from ..functions.constants import ALPHABET, HIGH_RISK_THRESHOLD
from ..session import ship_package
from .residues import codebook

VALUES_PER_STEP = 1 << 17  # size of the dense matrices held at a time; a cache holds a few
WINDOWS = 1 << 14  # most windows of letters whose logits are worked out once, ahead of all rows
MAX_WEIGHT_BYTES = 4 << 30  # of one model's folds, in driver and executor memory

_VECTOR = T.ArrayType(T.DoubleType())
_MATRIX = T.ArrayType(_VECTOR)


@dataclass
class FoldModel:
    """Weights of one fold. Batch norm is folded into ``gain`` and ``offset``."""

    fold: str
    feature_weight: np.ndarray  # (taps, in, channels)
    feature_bias: np.ndarray
    attention_weight: np.ndarray
    attention_bias: np.ndarray
    head: list[dict] = field(default_factory=list)
    temperature: float = 1.0
    cutoff: float = 0.5

    def __post_init__(self):
        if self.feature_weight.shape[0] % 2 == 0:
            raise ValueError("even kernel sizes are not supported")


def fold_batch_norm(
    mean: np.ndarray, var: np.ndarray, weight: np.ndarray, bias: np.ndarray, eps: float = 1e-5
) -> dict[str, np.ndarray]:
    gain = weight / np.sqrt(var + eps)
    return {"gain": gain, "offset": bias - mean * gain}


def models_from_table(
    weights: DataFrame, model: str, max_bytes: int = MAX_WEIGHT_BYTES
) -> list[FoldModel]:
    """Build fold models from rows (model, fold, layer, tap, width, values).

    A row is one matrix or vector, row after row, ``width`` values each. Layers:
    ``feature`` and ``attention`` (tap >= 0: inputs x channels; tap -1: bias),
    ``head0, head1, ...`` (tap 0: inputs x outputs; -1 bias, -2 gain, -3 offset),
    ``temperature`` and ``cutoff``. Models of more than ``max_bytes`` are refused
    before anything is read: all of it goes to the driver and to each executor.
    """
    rows = weights.where(F.col("model") == model)
    size = rows.agg(F.sum(8 * F.size("values").cast("long"))).first()[0] or 0
    if size > max_bytes:
        raise ValueError(f"the weights of {model} take {size} bytes, over {max_bytes}")
    layers: dict[str, dict[tuple[str, int], np.ndarray]] = {}
    table = rows.select("fold", "layer", "tap", "width", "values").toArrow()
    values = table.column("values")
    for n, row in enumerate(table.select(["fold", "layer", "tap", "width"]).to_pylist()):
        held = values[n].values.to_numpy(zero_copy_only=False).reshape(-1, row["width"])
        layers.setdefault(row["fold"], {})[row["layer"], row["tap"]] = held
    return [_model_of(fold, layers[fold]) for fold in sorted(layers)]


def _model_of(fold: str, parts: dict[tuple[str, int], np.ndarray]) -> FoldModel:
    def conv(name: str) -> tuple[np.ndarray, np.ndarray]:
        taps = sorted(t for n, t in parts if n == name and t >= 0)
        weight = np.stack([parts[name, t] for t in taps])
        return weight, parts[name, -1][0] if (name, -1) in parts else np.zeros(weight.shape[2])

    head = []
    while (name := f"head{len(head)}", 0) in parts:
        weight = parts[name, 0]
        bias = parts[name, -1][0] if (name, -1) in parts else np.zeros(weight.shape[1])
        layer = {"weight": weight, "bias": bias}
        if (name, -2) in parts:
            layer |= {"gain": parts[name, -2][0], "offset": parts[name, -3][0]}
        head.append(layer)
    single = {n: float(parts[n, 0][0, 0]) for n in ("temperature", "cutoff") if (n, 0) in parts}
    return FoldModel(fold, *conv("feature"), *conv("attention"), head, **single)


WEIGHTS_SCHEMA = "model string, fold string, layer string, tap int, width int, values array<double>"


def models_to_arrow(models: list[FoldModel], model: str) -> pa.Table:
    """One row per matrix or vector of each fold; the values stay arrays."""
    names, arrays = [], []
    for m in models:
        parts: list[tuple[str, int, np.ndarray]] = []
        for name in ("feature", "attention"):
            parts += [(name, tap, w) for tap, w in enumerate(getattr(m, f"{name}_weight"))]
            parts.append((name, -1, getattr(m, f"{name}_bias")))
        for n, layer in enumerate(m.head):
            parts += [(f"head{n}", 0, layer["weight"]), (f"head{n}", -1, layer["bias"])]
            if layer.get("gain") is not None:
                parts += [(f"head{n}", -2, layer["gain"]), (f"head{n}", -3, layer["offset"])]
        parts += [("temperature", 0, np.array(m.temperature)), ("cutoff", 0, np.array(m.cutoff))]
        for layer, tap, values in parts:
            values = np.atleast_2d(np.asarray(values, float))
            names.append((model, m.fold, layer, tap, values.shape[1]))
            arrays.append(values.ravel())
    columns = list(zip(*names, strict=True))
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
    values = ragged.list_array(np.concatenate(arrays), np.array([len(a) for a in arrays]))
    return pa.table(
        [*[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], values],
        names=["model", "fold", "layer", "tap", "width", "values"],
    )


def models_to_table(spark: SparkSession, models: list[FoldModel], model: str) -> DataFrame:
    return spark.createDataFrame(models_to_arrow(models, model), WEIGHTS_SCHEMA)


def _steps(lengths: np.ndarray, width: int) -> Iterator[slice]:
    """Runs of whole sequences with a bounded number of matrix values."""
    start, filled, limit = 0, 0, VALUES_PER_STEP // max(1, width)
    for i, n in enumerate(lengths):
        if i > start and filled + n > limit:
            yield slice(start, i)
            start, filled = i, 0
        filled += n
    if start < len(lengths):
        yield slice(start, len(lengths))


def _per_batch(
    df: DataFrame,
    fields: list[T.StructField],
    compute: Callable[[pa.RecordBatch], list[pa.Array]],
    width: int,
) -> DataFrame:
    ship_package(df.sparkSession)
    schema = T.StructType(df.schema.fields + fields)
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            # Slices keep the output list offsets and the dense matrices small.
            for piece in row_steps(batch, width):
                arrays = compute(piece)
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, *arrays], [*piece.schema.names, *names]
                )

    return df.mapInArrow(run, schema)


def row_steps(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch small enough for dense matrices ``width`` values wide."""
    if "sequence" in batch.schema.names:
        lengths = np.asarray(pc.utf8_length(batch.column("sequence")).fill_null(0))
    else:
        lists = next(c for c in batch.columns if pa.types.is_list(c.type))
        lengths = np.asarray(lists.value_lengths().fill_null(0))
    for step in _steps(lengths, width):
        yield batch.slice(step.start, step.stop - step.start)


def residue_conv1d(df: DataFrame, model: FoldModel, encoding: str = "zscale") -> DataFrame:
    """Add ``features`` and ``attention`` (positions x channels) of one fold.

    ``encoding`` names a letter codebook, or ``embedding`` to read vectors from
    an ``embedding`` column.
    """
    shared = df.sparkSession.sparkContext.broadcast(_prepare([model], encoding)[0])

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = _read_input(batch, encoding, shared.value)
        return [
            ragged.list_array(rows.convolve(shared.value, part), rows.lengths)
            for part in ("feature", "attention")
        ]

    fields = [T.StructField("features", _MATRIX), T.StructField("attention", _MATRIX)]
    return _per_batch(df, fields, compute, max(model.feature_weight.shape[1:]))


def attention_apply(df: DataFrame, mode: str = "weighted_mean_three") -> DataFrame:
    """Add ``applied``: features times the per-channel softmax over positions."""
    check_mode(mode)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        features, lengths = ragged.matrix_rows(batch.column("features"))
        attention, _ = ragged.matrix_rows(batch.column("attention"))
        filled = lengths[lengths > 0]
        return [ragged.list_array(am.apply_attention(features, attention, filled, mode), lengths)]

    return _per_batch(df, [T.StructField("applied", _MATRIX)], compute, 64)


def mlp_head(df: DataFrame, layers: list[dict], column: str = "applied") -> DataFrame:
    """Add ``logits``: one value per position."""
    shared = df.sparkSession.sparkContext.broadcast(layers)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        x, lengths = ragged.matrix_rows(batch.column(column), layers[0]["weight"].shape[0])
        return [ragged.list_array(am.run_head(x, shared.value), lengths)]

    width = max(layer["weight"].shape[1] for layer in layers)
    return _per_batch(df, [T.StructField("logits", _VECTOR)], compute, width)


def score_penalty(logits: Column, mode: str, weight: float, temperature: float = 1.0) -> Column:
    """Mean weighted residue score of a sequence, times the penalty weight."""
    return array_mean(weighted_residues(mode, logits, temperature)) * F.lit(weight)


def _prepare(models: list[FoldModel], encoding: str, mode: str | None = None) -> list[dict]:
    """What a task needs of each fold; letter encodings become tap tables.

    Without attention a logit depends on the letters under the taps alone. Where there are
    no more than ``WINDOWS`` such windows, a fold is the table of their logits.
    """
    book = None
    if encoding != "embedding":
        values = codebook(encoding)
        book = np.array([values[a] for a in ALPHABET])
    prepared = []
    for m in models:
        taps = m.feature_weight.shape[0]
        head = am.folded_head(m.head, m.feature_weight.shape[2])
        entry = {"head": head, "temperature": m.temperature, "taps": taps}
        single = mode is not None and mode.endswith("single_conv")
        if single and book is not None and (len(book) + 1) ** taps <= WINDOWS:
            prepared.append(entry | {"windows": _window_logits(m, book, head)})
            continue
        for part in ("feature",) if single else ("feature", "attention"):
            weight = getattr(m, f"{part}_weight")
            tables = weight if book is None else am.paired_tables(am.tap_tables(book, weight))
            entry[part] = tables
            entry[f"{part}_bias"] = getattr(m, f"{part}_bias")
        if book is not None and not single:
            entry["exponentials"] = am.exponential_tables(entry["attention"])
        prepared.append(entry)
    return prepared


def _window_logits(model: FoldModel, book: np.ndarray, head: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    tables = am.tap_tables(book, model.feature_weight)
    taps, letters = tables.shape[:2]
    codes = np.indices((letters,) * taps).reshape(taps, -1)
    parts = [
        am.run_folded(am.convolve_codes(list(codes[:, at : at + 1024]), tables, model.feature_bias), head)
        for at in range(0, codes.shape[1], 1024)
    ]
    return np.concatenate(parts)


@dataclass
class _Input:
    """The sequences of a batch as the folds read them."""

    lengths: np.ndarray
    filled: np.ndarray  # lengths of the sequences that are not empty
    vectors: np.ndarray | None = None
    at_taps: list[np.ndarray] | None = None
    at_tables: list[np.ndarray] | None = None

    def convolve(self, fold: dict, part: str) -> np.ndarray:
        if self.at_taps is None:
            return am.convolve(self.vectors, self.filled, fold[part], fold[f"{part}_bias"])
        return am.convolve_codes(self._tables(fold, part), fold[part], fold[f"{part}_bias"])

    def _tables(self, fold: dict, part: str) -> list[np.ndarray]:
        if self.at_tables is None or len(self.at_tables) != len(fold[part]):
            self.at_tables = am.paired_codes(self.at_taps, ragged.PAD + 1, fold[part])
        return self.at_tables

    def logits(self, fold: dict, mode: str) -> np.ndarray:
        if "windows" in fold:
            if self.at_tables is None:
                self.at_tables = [am.window_codes(self.at_taps, ragged.PAD + 1)]
            return np.take(fold["windows"], self.at_tables[0])
        if mode.endswith("single_conv"):
            return am.run_folded(self.convolve(fold, "feature"), fold["head"])
        if fold.get("exponentials") is not None:
            weights = am.multiply_codes(self._tables(fold, "attention"), fold["exponentials"])
        else:
            weights = self.convolve(fold, "attention")
            weights -= ragged.spread(ragged.segment_reduce(np.maximum, weights, self.filled), self.filled)
            np.exp(weights, out=weights)
        return am.attended_logits(self.convolve(fold, "feature"), weights, self.filled, fold["head"])


def _read_input(batch: pa.RecordBatch, encoding: str, fold: dict) -> _Input:
    if encoding == "embedding":
        x, lengths = ragged.matrix_rows(batch.column("embedding"), fold["feature"].shape[1])
        return _Input(lengths, lengths[lengths > 0], vectors=x)
    codes, lengths = ragged.letter_codes(batch.column("sequence"))
    filled = lengths[lengths > 0]
    taps = am.neighbour_codes(codes, filled, fold["taps"], ragged.PAD)
    return _Input(lengths, filled, at_taps=taps)


def score_folds(
    df: DataFrame,
    models: list[FoldModel],
    mode: str,
    encoding: str = "zscale",
    with_residues: bool = True,
    with_fold_residues: bool = True,
) -> DataFrame:
    """Add fold maps ``fold_residues``, ``fold_scores``, ``fold_penalties`` and the
    means over folds ``ensemble_residues`` and ``ensemble_score``.

    One pass over the sequences scores every fold. Empty sequences get nulls.
    ``with_residues=False`` leaves the residue arrays, most of the output, in the task;
    ``with_fold_residues=False`` sends only their mean. No later plan can drop what a
    task has returned, so ask for what is used.
    """
    check_mode(mode)
    with_fold_residues = with_fold_residues and with_residues
    if len({m.feature_weight.shape[0] for m in models}) != 1:
        raise ValueError("the folds of a model share one kernel size")
    prepared = _prepare(models, encoding, mode)
    shared = df.sparkSession.sparkContext.broadcast(prepared)
    names = [m.fold for m in models]

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = _read_input(batch, encoding, shared.value[0])
        lengths, filled = rows.lengths, rows.filled
        empty = lengths == 0
        out, residue_sum, score_sum = [], 0.0, 0.0
        for fold in shared.value:
            logits = rows.logits(fold, mode)
            residues, scores, weighted = am.pool(mode, logits, filled, fold["temperature"])
            score_sum = score_sum + scores
            if with_residues:
                residue_sum = residue_sum + residues
            if with_fold_residues:
                out.append(ragged.list_array(residues, lengths))
            out.append(_with_nulls(scores, empty))
            spent = 0.0 * scores if weighted is None else (
                ragged.segment_reduce(np.add, weighted, filled) / filled
            )
            out.append(_with_nulls(spent, empty))
        n = len(shared.value)
        if with_residues:
            out.append(ragged.list_array(residue_sum / n, lengths))
        out.append(_with_nulls(score_sum / n, empty))
        return out

    fields = []
    for i in range(len(names)):
        fields += [T.StructField(f"_r{i}", _VECTOR)] if with_fold_residues else []
        fields += [T.StructField(f"_s{i}", T.DoubleType()), T.StructField(f"_p{i}", T.DoubleType())]
    fields += [T.StructField("ensemble_residues", _VECTOR)] if with_residues else []
    fields += [T.StructField("ensemble_score", T.DoubleType())]
    # A head works on its rows in blocks of its own.
    width = max(1 if "windows" in p else max(m.feature_weight.shape[1:]) for p, m in zip(prepared, models))
    scored = _per_batch(df, fields, compute, width)

    def as_map(prefix: str) -> Column:
        entries = [x for i, f in enumerate(names) for x in (F.lit(f), F.col(f"{prefix}{i}"))]
        return F.create_map(*entries)

    return scored.select(
        *df.columns,
        *([as_map("_r").alias("fold_residues")] if with_fold_residues else []),
        *(["ensemble_residues"] if with_residues else []),
        as_map("_s").alias("fold_scores"),
        as_map("_p").alias("fold_penalties"),
        "ensemble_score",
    )


def _with_nulls(values: np.ndarray, empty: np.ndarray) -> pa.Array:
    full = np.zeros(len(empty))
    full[~empty] = values
    return pa.array(full, type=pa.float64(), mask=empty)


def summary_column(residues: Column, threshold: float = HIGH_RISK_THRESHOLD, base: int = 0) -> Column:
    """Mean, max, min and high-risk positions (0-based unless ``base`` says otherwise)."""
    risky = F.filter(
        F.transform(residues, lambda v, i: F.when(v > threshold, i + base)),
        lambda i: i.isNotNull(),
    )
    return F.struct(
        array_mean(residues).alias("mean"),
        F.array_max(residues).alias("max"),
        F.array_min(residues).alias("min"),
        risky.alias("high_risk_positions"),
    )


def fold_scores_long(scored: DataFrame, cutoffs: dict[str, float] | None = None) -> DataFrame:
    """(seq_id, name, sequence, fold, seq_score[, y_pred]) rows."""
    long = scored.select("seq_id", "name", "sequence", F.explode("fold_scores").alias("fold", "seq_score"))
    return long if cutoffs is None else apply_cutoff(long, cutoffs)


def apply_cutoff(long: DataFrame, cutoffs: dict[str, float], score: str = "seq_score") -> DataFrame:
    """Class 1 where the score reaches its fold's cutoff; 0.0 is a valid cutoff."""
    table = F.create_map(*[x for f, c in cutoffs.items() for x in (F.lit(f), F.lit(float(c)))])
    return long.withColumn("y_pred", (F.col(score) >= table[F.col("fold")]).cast("int"))
