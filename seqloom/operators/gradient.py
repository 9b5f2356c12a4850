"""Training by distributed gradients.

Every epoch is one Spark job: tasks sum the gradient of their rows, slots of
partitions are added up on the executors, and the driver moves the parameters.
Only one parameter-sized vector ever reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions import attention_math as am
from ..functions import ragged
from ..functions.constants import ALPHABET
from ..functions.masks import Dropout
from ..session import cut_lineage, ship_package
from .attention import FoldModel, fold_batch_norm, row_steps, score_folds
from .metrics import optimal_cutoff
from .residues import codebook

STATS = 4  # train loss, train weight, validation loss, validation weight
COMBINE_SLOTS = 32


@dataclass
class Fit:
    params: list[np.ndarray]
    history: list[dict]
    best_epoch: int
    state: object = None


def pack(params: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([p.reshape(-1) for p in params])


def unpack(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    out, at = [], 0
    for p in like:
        out.append(flat[at : at + p.size].reshape(p.shape))
        at += p.size
    return out


class Optimizer:
    """Plain gradient steps or Adam with its usual constants."""

    def __init__(self, kind: str, rate: float):
        if kind not in ("sgd", "adam"):
            raise ValueError("optimizer is 'sgd' or 'adam'")
        self.kind, self.rate, self.t = kind, rate, 0
        self.m = self.v = 0.0

    def step(self, flat: np.ndarray, grad: np.ndarray) -> np.ndarray:
        if self.kind == "sgd":
            return flat - self.rate * grad
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad * grad
        m, v = self.m / (1 - 0.9**self.t), self.v / (1 - 0.999**self.t)
        return flat - self.rate * m / (np.sqrt(v) + 1e-8)


Partial = Callable[[list[np.ndarray], pa.RecordBatch], tuple[list[np.ndarray], np.ndarray]]
#: What one piece of a batch adds to a sum over the table, given what all tasks share.
Give = Callable[[object, pa.RecordBatch], np.ndarray]


def summed(table: DataFrame, shared: object, give: Give, width: int) -> np.ndarray | None:
    """Sum of ``give(shared, piece)`` over the whole table; None if it has no rows.

    ``width`` values per position bound the size of a piece.
    """
    ship_package(table.sparkSession)
    sent = table.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for piece in row_steps(batch, width) if batch.num_rows else ():
                part = give(sent.value, piece)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [ragged.list_array(total, np.array([len(total)]))], ["g"]
            )

    parts = table.mapInArrow(run, "g array<double>").select(
        array_to_vector("g").alias("g"), (F.spark_partition_id() % COMBINE_SLOTS).alias("slot")
    )
    slots = parts.groupBy("slot").agg(Summarizer.sum(F.col("g")).alias("g"))
    rows = slots.agg(F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.sum(F.col("g"))).alias("g"))
    row = rows.where("n > 0").first()
    sent.unpersist()
    return None if row is None else np.array(row["g"])


def summed_gradient(
    table: DataFrame, params: list[np.ndarray], partial: Partial
) -> tuple[np.ndarray, np.ndarray]:
    """Sum of per-batch gradients and loss statistics over the whole table."""
    width = max(p[..., 0].size for p in params)  # the widest input of any layer

    def give(weights: object, piece: pa.RecordBatch) -> np.ndarray:
        grads, stats = partial(weights, piece)
        return np.concatenate([pack(grads), stats])

    flat = summed(table, params, give, width)
    if flat is None:
        return np.zeros(sum(p.size for p in params)), np.zeros(STATS)
    return flat[:-STATS], flat[-STATS:]


def training_table(table: DataFrame, partitions: int | None = None, key: str = "seq_id") -> DataFrame:
    """Write the training rows once, as they lie or over ``partitions``.

    Every task of an epoch returns a parameter-sized sum; the sums are combined in
    slots on the executors, so more partitions cost no more on the driver.
    """
    return cut_lineage(table.repartition(partitions, key) if partitions else table)


#: (rows, parameters, epoch) -> summed gradient, loss statistics, and what else belongs to the parameters.
Evaluate = Callable[[DataFrame, list[np.ndarray], int], tuple[np.ndarray, np.ndarray, object]]


def descend(
    table: DataFrame,
    params: list[np.ndarray],
    partial: Partial | None,
    optimizer: Optimizer,
    epochs: int,
    patience: int,
    n_batches: int = 1,
    key: str = "seq_id",
    evaluate: Evaluate | None = None,
) -> Fit:
    """Epochs with early stopping; the parameters with the lowest validation loss win.

    ``n_batches`` > 1 takes several steps per epoch on hash-chosen parts. ``evaluate``
    stands in for the plain sum of ``partial`` where a step needs several passes.
    """
    if evaluate is None:
        evaluate = lambda rows, now, epoch: (*summed_gradient(rows, now, partial), None)
    fixed = table.persist(StorageLevel.MEMORY_AND_DISK)
    flat = pack(params).astype(float)
    best, best_loss, best_epoch, history, state = flat, np.inf, -1, [], None
    for epoch in range(epochs):
        losses = np.zeros(STATS)
        for b in range(n_batches):
            rows = fixed
            if n_batches > 1:
                rows = fixed.where(F.pmod(F.xxhash64(key, F.lit(epoch)), F.lit(n_batches)) == b)
            before = flat
            grad, stats, now = evaluate(rows, unpack(flat, params), epoch)
            losses += stats
            if stats[1]:
                flat = optimizer.step(flat, grad / stats[1])
        train = losses[0] / losses[1] if losses[1] else float("nan")
        val = losses[2] / losses[3] if losses[3] else train
        history.append({"epoch": epoch, "train_loss": float(train), "val_loss": float(val)})
        # The losses belong to the parameters the epoch's (last) step started from.
        if val < best_loss:
            best, best_loss, best_epoch, state = before, val, epoch, now
        elif epoch - best_epoch >= patience:
            break
    fixed.unpersist()
    return Fit(unpack(best, params), history, best_epoch, state)


# -- attention scorer ----------------------------------------------------------

# Hidden widths of each head, the layers whose outputs are dropped at random,
# and the usual constants of batch norm.
_HEADS = {"linear": (), "mlp": (32,), "mlp_deep": (256, 64, 32)}
_DROPPED = {1: (), 2: (0,), 4: (0, 1)}
EPSILON, MOMENTUM = 1e-5, 0.1


@dataclass
class Norm:
    """Batch norm behind the last hidden layer.

    ``mean`` and ``var`` are those of all positions of the step, or running ones. ``pull``
    are the step's means of the upstream gradient and of its product with the normed
    values; without it the moments count as constants.
    """

    gamma: np.ndarray
    beta: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    pull: tuple[np.ndarray, np.ndarray] | None = None

    @property
    def slope(self) -> np.ndarray:
        return 1.0 / np.sqrt(self.var + EPSILON)

    def folded(self) -> tuple[np.ndarray, np.ndarray]:
        """Gain and offset that stand for the norm."""
        gain = self.gamma * self.slope
        return gain, self.beta - self.mean * gain


@dataclass
class Drops:
    """Dropout of the convolved features and inside the head, of one piece."""

    conv: Dropout
    head: Dropout


def init_attention(
    width: int, channels: int, kernel: int, head: str, output_dim: int, rng: np.random.Generator
) -> list[np.ndarray]:
    """Uniform start within 1/sqrt(fan-in); the last parameter is the temperature."""
    if kernel % 2 == 0:
        raise ValueError("even kernel sizes are not supported")

    def uniform(fan_in: int, *shape: int) -> np.ndarray:
        bound = 1.0 / np.sqrt(fan_in)
        return rng.uniform(-bound, bound, shape)

    params = []
    for _ in range(2):
        params += [uniform(width * kernel, kernel, width, channels), uniform(width * kernel, channels)]
    sizes = (channels, *_HEADS[head], output_dim)
    for a, b in zip(sizes, sizes[1:]):
        params += [uniform(a, a, b), uniform(a, b)]
    return params + [np.ones(1)]


@dataclass
class Pass:
    """What a forward pass leaves for the way back."""

    columns: np.ndarray
    features: np.ndarray  # behind the dropout
    weights: np.ndarray | None  # None: all are one
    kept: np.ndarray | None  # of the features
    inputs: list[np.ndarray]  # of each dense layer, before a batch norm
    gains: list[float]  # of the dropout behind each dense layer
    logits: np.ndarray


def attention_forward(
    params: list[np.ndarray],
    x: np.ndarray,
    lengths: np.ndarray,
    mode: str,
    norm: Norm | None = None,
    drops: Drops | None = None,
    stop_at_hidden: bool = False,
) -> Pass:
    """Convolutions, attention and head; ``params`` end in the temperature.

    The outputs of the last layer are averaged, so it is one vector of weights, into which
    a batch norm in front of it is folded.
    """
    wf, bf, wa, ba = params[:4]
    dense = params[4:-1]
    columns = am.tap_columns(x, lengths, wf.shape[0])
    features = columns @ wf.reshape(columns.shape[1], -1)
    features += bf
    kept = drops.conv.kept(0, features.shape[1]) if drops else None
    if kept is not None:
        features *= kept * drops.conv.gain
    weights = None
    if not mode.endswith("single_conv"):
        attention = columns @ wa.reshape(columns.shape[1], -1)
        attention += ba
        weights = ragged.segment_softmax(attention, lengths)
    inputs, gains = [features if weights is None else features * weights], []
    layers = len(dense) // 2
    for i in range(layers - 1):
        z = inputs[i] @ dense[2 * i]
        z += dense[2 * i + 1]
        np.maximum(z, 0.0, out=z)
        stays = drops.head.kept(i + 1, z.shape[1]) if drops and i in _DROPPED[layers] else None
        gains.append(1.0)
        if stays is not None:
            # What stays is scaled along with the weights that read it.
            gains[i] = drops.head.gain
            z *= stays
            z *= gains[i]
        inputs.append(z)
        if stop_at_hidden and i == layers - 2:
            return Pass(columns, features, weights, kept, inputs, gains, z[:, 0])
    last, bias = _last_layer(dense, norm)
    return Pass(columns, features, weights, kept, inputs, gains, inputs[-1] @ last + bias)


def _last_layer(dense: list[np.ndarray], norm: Norm | None) -> tuple[np.ndarray, float]:
    last, bias = dense[-2].mean(axis=1), float(dense[-1].mean())
    if norm is None:
        return last, bias
    gain, offset = norm.folded()
    return gain * last, bias + float(offset @ last)


def attention_loss(
    done: Pass, temperature: float, lengths: np.ndarray, y: np.ndarray, mode: str, penalty: float, per: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(loss, score, gradient of the loss for the score) of each sequence."""
    _, scores, weighted = am.pool(mode, done.logits, lengths, temperature)
    clipped = np.clip(scores, 1e-12, 1 - 1e-12)
    loss = -(y * np.log(clipped) + (1 - y) * np.log(1 - clipped))
    upstream = (clipped - y) / (clipped * (1 - clipped))
    if penalty and weighted is not None:
        loss = loss + penalty * ragged.segment_reduce(np.add, weighted, lengths) / per
        upstream = upstream + penalty / per
    return loss, scores, upstream


def attention_gradient(
    params: list[np.ndarray],
    x: np.ndarray,
    lengths: np.ndarray,
    y: np.ndarray,
    mode: str,
    penalty: float,
    mean_length: float | None = None,
    norm: Norm | None = None,
    drops: Drops | None = None,
    head_only: bool = False,
    loss_only: bool = False,
) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(gradients, loss per sequence, scores) of summed BCE plus the penalty.

    The penalty is the mean of the weighted scores over all residues of the set, not
    over each sequence first: a sequence's part is its sum over ``mean_length`` of the
    set, which is that of the rows given unless the caller knows it. With ``norm`` the
    gradients of its gamma and beta come before that of the temperature. ``head_only``
    leaves the parts before the last layer at zero, ``loss_only`` all gradients out.
    """
    wf, _, wa, ba = params[:4]
    dense = params[4:-1]
    temperature = float(params[-1][0])
    done = attention_forward(params, x, lengths, mode, norm, drops)
    per = lengths.mean() if mean_length is None else mean_length
    loss, scores, upstream = attention_loss(done, temperature, lengths, y, mode, penalty, per)
    if loss_only:
        return [], loss, scores

    d_logits, d_temp = am.pool_gradient(mode, done.logits, lengths, temperature, upstream)
    last, outputs = len(dense) // 2 - 1, dense[-1].size
    # The last layer's gradient is the same for each output, and that of what it reads is
    # this vector times one of weights.
    total, read = d_logits.sum(), d_logits @ done.inputs[-1]
    ahead = dense[-2].mean(axis=1)
    d_norm: list[np.ndarray] = []
    if norm is not None and last:
        normed = norm.slope * (read - norm.mean * total)
        d_norm = [ahead * normed, ahead * total]
        read = norm.gamma * normed + norm.beta * total
    d_dense = [np.repeat(read[:, None] / outputs, outputs, axis=1), np.full(outputs, total / outputs)]
    if head_only and last:
        d_dense = [np.zeros_like(p) for p in dense[:-2]] + d_dense
        before = [np.zeros_like(p) for p in params[:4]]
        return [*before, *d_dense, *d_norm, np.array([d_temp])], loss, scores
    gain = norm.gamma * norm.slope if norm is not None and last else 1.0
    d = d_logits[:, None] * (ahead * gain)
    for i in range(last - 1, -1, -1):
        hidden = done.inputs[i + 1]
        if i == last - 1 and norm is not None and norm.pull is not None:
            tilt = norm.slope * norm.pull[1]
            d -= hidden * (tilt * gain)
            d -= (norm.pull[0] - norm.mean * tilt) * gain
        # Hidden units that were dropped are zero like those that a ReLU cut.
        d *= hidden > 0
        if done.gains[i] != 1.0:
            d *= done.gains[i]
        d_dense = [done.inputs[i].T @ d, np.ones(len(d)) @ d, *d_dense]
        d = d @ dense[2 * i].T
    d_features = d if done.weights is None else d * done.weights
    if done.kept is not None:
        d_features = d_features * (done.kept * drops.conv.gain)
    grads = [(done.columns.T @ d_features).reshape(wf.shape), d_features.sum(axis=0)]
    if done.weights is None:
        grads += [np.zeros_like(wa), np.zeros_like(ba)]
    else:
        weights, d_weights = done.weights, d * done.features
        inner = ragged.segment_reduce(np.add, weights * d_weights, lengths)
        d_attention = weights * (d_weights - ragged.spread(inner, lengths))
        grads += [(done.columns.T @ d_attention).reshape(wa.shape), d_attention.sum(axis=0)]
    return [*grads, *d_dense, *d_norm, np.array([d_temp])], loss, scores


@dataclass
class Training:
    """How a piece of the training table is read and what its loss is."""

    encoding: str
    mode: str
    penalty: float
    mean_length: dict[int, float]  # of the train rows (0) and the validation rows (2)
    conv_dropout: float = 0.0
    dropout: float = 0.0
    seed: int = 42

    def read(self, piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        if self.encoding == "embedding":
            return ragged.matrix_rows(piece.column("embedding"))
        values = codebook(self.encoding)
        codes, lengths = ragged.letter_codes(piece.column("sequence"))
        return np.take(np.array([values[a] for a in ALPHABET]), codes, axis=0), lengths

    def parts(self, piece: pa.RecordBatch, epoch: int, held_too: bool):
        """(place of its statistics, x, lengths, y, dropout) of the train and validation rows."""
        held = np.asarray(piece.column("held"))
        if not held_too and held.all():
            return
        x, lengths = self.read(piece)
        y, number = np.asarray(piece.column("y")), np.asarray(piece.column("number"))
        for part, at in ((~held, 0), (held, 2)):
            if not part.any() or (at and not held_too):
                continue
            rows = x if part.all() else x[np.repeat(part, lengths)]
            drops = None
            if at == 0 and (self.conv_dropout or self.dropout):
                conv = Dropout(self.conv_dropout, self.seed, epoch, number[part], lengths[part])
                drops = Drops(conv, conv.at_rate(self.dropout))
            yield at, rows, lengths[part], y[part], drops


def training_step(
    sum_over: Callable[[object, Give, int], np.ndarray],
    params: list[np.ndarray],
    how: Training,
    epoch: int,
    running: tuple[np.ndarray, np.ndarray] | None,
) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray] | None]:
    """Summed gradient and loss statistics of all rows, and the running moments.

    ``sum_over(shared, give, size)`` adds up what each piece gives. Without batch norm
    (``running`` is None) that is one pass. With it there are three: the hidden units'
    moments over all training positions, then the means of the gradient that reaches
    them, then the gradient itself, which needs both. Validation rows are scored with the
    running moments.
    """
    if running is None:

        def give(shared: object, piece: pa.RecordBatch) -> np.ndarray:
            total, stats = np.zeros(sum(p.size for p in shared)), np.zeros(STATS)
            for at, x, lengths, y, drops in how.parts(piece, epoch, True):
                g, loss, _ = attention_gradient(
                    shared, x, lengths, y, how.mode, how.penalty, how.mean_length[at], drops=drops, loss_only=bool(at)
                )
                stats[at : at + 2] = loss.sum(), len(y)
                if at == 0:
                    total = pack(g)
            return np.concatenate([total, stats])

        flat = sum_over(params, give, sum(p.size for p in params) + STATS)
        return flat[:-STATS], flat[-STATS:], None

    gamma, beta = params[-3:-1]
    plain = [*params[:-3], params[-1]]
    units = len(gamma)

    def moments(shared: object, piece: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(2 * units + 1)
        for _, x, lengths, _, drops in how.parts(piece, epoch, False):
            h = attention_forward(shared, x, lengths, how.mode, drops=drops, stop_at_hidden=True).inputs[-1]
            first = np.ones(len(h)) @ h
            np.square(h, out=h)
            out += np.concatenate([first, np.ones(len(h)) @ h, [len(h)]])
        return out

    seen = sum_over(plain, moments, 2 * units + 1)
    n = max(seen[-1], 1.0)
    mean = seen[:units] / n
    var = np.maximum(seen[units:-1] / n - mean * mean, 0.0)
    if seen[-1]:
        grown = n / max(n - 1, 1.0)  # running variances are unbiased
        running = tuple((1 - MOMENTUM) * old + MOMENTUM * new for old, new in zip(running, (mean, var * grown), strict=True))
    norm = Norm(gamma, beta, mean, var)

    def pulls(shared: object, piece: pa.RecordBatch) -> np.ndarray:
        own, step = shared
        out = np.zeros(2 * units)
        for at, x, lengths, y, drops in how.parts(piece, epoch, False):
            g, _, _ = attention_gradient(
                own, x, lengths, y, how.mode, how.penalty, how.mean_length[at], step, drops, head_only=True
            )
            out += np.concatenate([g[-2], g[-3]])
        return out

    pulled = sum_over((plain, norm), pulls, 2 * units) / n
    norm = Norm(gamma, beta, mean, var, (pulled[:units], pulled[units:]))
    stored = Norm(gamma, beta, *running)

    def gradients(shared: object, piece: pa.RecordBatch) -> np.ndarray:
        own, step, held = shared
        total, stats = np.zeros(sum(p.size for p in own) + 2 * units), np.zeros(STATS)
        for at, x, lengths, y, drops in how.parts(piece, epoch, True):
            g, loss, _ = attention_gradient(
                own, x, lengths, y, how.mode, how.penalty, how.mean_length[at], held if at else step, drops,
                loss_only=bool(at),
            )
            stats[at : at + 2] = loss.sum(), len(y)
            if at == 0:
                total = pack(g)
        return np.concatenate([total, stats])

    flat = sum_over((plain, norm, stored), gradients, sum(p.size for p in params) + STATS)
    return flat[:-STATS], flat[-STATS:], running


def attention_training_table(
    df: DataFrame, encoding: str, label: str = "value_bool", split: str = "data_split"
) -> tuple[DataFrame, dict[int, float]]:
    """Rows to train and validate on, written once, and the mean length of either kind.

    ``number`` is a 64-bit hash of the row's id, from which its dropout masks are drawn.
    """
    source = "embedding" if encoding == "embedding" else "sequence"
    usable = df.where(F.col(label).isNotNull() & F.col(split).isin("train", "val"))
    size = F.size(source) if encoding == "embedding" else F.length(source)
    table = training_table(
        usable.where(size > 0).select(
            "seq_id",
            source,
            F.xxhash64("seq_id").alias("number"),
            F.col(label).cast("double").alias("y"),
            (F.col(split) == "val").alias("held"),
        )
    )
    counts = table.agg(
        F.count_if("held").alias("val"),
        F.count_if(~F.col("held")).alias("train"),
        F.avg(F.when(F.col("held"), size)).alias("val_length"),
        F.avg(F.when(~F.col("held"), size)).alias("train_length"),
    ).first()
    if not counts["train"] or not counts["val"]:
        raise ValueError("training needs rows in both train and val")
    return table, {0: counts["train_length"], 2: counts["val_length"]}


def first_step(
    df: DataFrame,
    params: list[np.ndarray],
    encoding: str = "zscale",
    mode: str = "weighted_mean_three",
    penalty: float = 0.0,
    batch_norm: bool = True,
) -> tuple[list[np.ndarray], np.ndarray]:
    """Summed gradients and loss statistics of given parameters, dropout off."""
    table, mean_length = attention_training_table(df, encoding)
    width = max(p[..., 0].size for p in params)
    running = (np.zeros_like(params[-2]), np.ones_like(params[-2])) if batch_norm else None
    how = Training(encoding, mode, penalty, mean_length)
    sum_over = lambda shared, give, size: summed(table, shared, give, width)
    grad, stats, _ = training_step(sum_over, params, how, 0, running)
    return unpack(grad, params), stats


def fit_attention(
    df: DataFrame,
    fold: str = "fold1",
    encoding: str = "zscale",
    width: int | None = None,
    label: str = "value_bool",
    split: str = "data_split",
    mode: str = "weighted_mean_three",
    head: str = "linear",
    kernel: int = 5,
    channels: int = -1,
    output_dim: int = 1,
    penalty: float = 0.0,
    optimizer: str = "sgd",
    rate: float = 0.05,
    epochs: int = 100,
    patience: int = 20,
    n_batches: int = 1,
    seed: int = 42,
    dropout: float = 0.0,
    conv_dropout: float = 0.0,
    batch_norm: bool = True,
) -> tuple[FoldModel, Fit]:
    """Train one fold on its train rows, stop on its val rows, store its best-MCC cutoff.

    A head with hidden layers has batch norm behind the last of them, whose moments are
    those of all training positions of a step, without padding; what the model keeps are
    the running moments, folded into gain and offset. Dropout masks follow from the seed,
    the epoch, the row's id and the position.
    """
    if encoding != "embedding":
        width = len(codebook(encoding)[ALPHABET[0]])
    if width is None:
        raise ValueError("give the embedding width")
    table, mean_length = attention_training_table(df, encoding, label, split)
    rng = np.random.default_rng(seed)
    params = init_attention(width, channels if channels > 0 else width, kernel, head, output_dim, rng)
    running = None
    if batch_norm and _HEADS[head]:
        units = _HEADS[head][-1]
        params = [*params[:-1], np.ones(units), np.zeros(units), params[-1]]
        running = (np.zeros(units), np.ones(units))
    how = Training(encoding, mode, penalty, mean_length, conv_dropout, dropout, seed)
    widest = max(p[..., 0].size for p in params)
    moments = [running]

    def evaluate(rows: DataFrame, now: list[np.ndarray], epoch: int):
        def sum_over(shared: object, give: Give, size: int) -> np.ndarray:
            total = summed(rows, shared, give, widest)
            return np.zeros(size) if total is None else total

        grad, stats, moments[0] = training_step(sum_over, now, how, epoch, moments[0])
        return grad, stats, moments[0]

    fit = descend(
        table, params, None, Optimizer(optimizer, rate), epochs, patience, n_batches, evaluate=evaluate
    )
    wf, bf, wa, ba, *dense = fit.params[:-1]
    if running is not None:
        *dense, gamma, beta = dense
    layers = [{"weight": dense[i], "bias": dense[i + 1]} for i in range(0, len(dense), 2)]
    if running is not None:
        layers[-2] |= fold_batch_norm(*fit.state, gamma, beta, EPSILON)
    model = FoldModel(fold, wf, bf, wa, ba, layers, float(fit.params[-1][0]))

    held_out = score_folds(table.where("held"), [model], mode, encoding, with_residues=False).select(
        "y", F.col("fold_scores")[fold].alias("y_pred_prob")
    )
    model.cutoff = float(optimal_cutoff(held_out, []).first()["optimal_mcc_cutoff"])
    return model, fit


# -- regression on fixed-width vectors -----------------------------------------


@dataclass
class MlpModel:
    """features -> hidden tanh -> one value."""

    weight: np.ndarray  # (in, hidden)
    bias: np.ndarray
    out_weight: np.ndarray  # (hidden,)
    out_bias: float


def mlp_regression_score(df: DataFrame, model: MlpModel, features: str = "features") -> DataFrame:
    """Add ``y_pred`` with dropout off."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def predict(vectors: pd.Series) -> pd.Series:
        m = shared.value
        x = np.stack(vectors.to_numpy()).astype(float)
        return pd.Series(np.tanh(x @ m.weight + m.bias) @ m.out_weight + m.out_bias)

    return df.withColumn("y_pred", predict(F.col(features).cast("array<double>")))


def mlp_gradient(
    params: list[np.ndarray], x: np.ndarray, y: np.ndarray
) -> tuple[list[np.ndarray], np.ndarray]:
    """Gradients and losses of summed absolute error."""
    w, b, v, c = params
    hidden = np.tanh(x @ w + b)
    gap = hidden @ v + c[0] - y
    sign = np.sign(gap)
    d_hidden = sign[:, None] * v[None, :] * (1.0 - hidden * hidden)
    grads = [x.T @ d_hidden, d_hidden.sum(axis=0), hidden.T @ sign, np.array([sign.sum()])]
    return grads, np.abs(gap)


def fit_mlp_regression(
    df: DataFrame,
    features: str = "features",
    label: str = "y",
    split: str = "data_split",
    hidden: int = 64,
    rate: float = 3e-4,
    epochs: int = 100,
    patience: int = 20,
    n_batches: int = 1,
    seed: int = 42,
    key: str = "seq_id",
) -> tuple[MlpModel, Fit]:
    """Absolute-error regression with Adam and early stopping."""
    table = training_table(
        df.where(F.col(label).isNotNull() & F.col(split).isin("train", "val")).select(
            F.col(key).alias("seq_id"),
            F.col(features).cast("array<double>").alias("x"),
            F.col(label).cast("double").alias("y"),
            (F.col(split) == "val").alias("held"),
        )
    )
    first = table.first()
    if first is None:
        raise ValueError("no training rows")
    width = len(first["x"])

    def partial(params: list[np.ndarray], batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
        x = np.asarray(batch.column("x").flatten(), dtype=float).reshape(batch.num_rows, -1)
        y, held = np.asarray(batch.column("y")), np.asarray(batch.column("held"))
        grads, loss = mlp_gradient(params, x[~held], y[~held])
        _, val_loss = mlp_gradient(params, x[held], y[held])
        return grads, np.array([loss.sum(), len(loss), val_loss.sum(), len(val_loss)])

    rng = np.random.default_rng(seed)
    a, b = 1 / np.sqrt(width), 1 / np.sqrt(hidden)
    params = [
        rng.uniform(-a, a, (width, hidden)),
        rng.uniform(-a, a, hidden),
        rng.uniform(-b, b, hidden),
        rng.uniform(-b, b, 1),
    ]
    fit = descend(table, params, partial, Optimizer("adam", rate), epochs, patience, n_batches)
    w, bias, v, c = fit.params
    return MlpModel(w, bias, v, float(c[0])), fit
