"""Logistic regression with a cross-validated grid.

All fits of a grid (every fold left out, every strength and penalty, and the refits on
all rows) advance together: one scan of the table per iteration gives each fit its loss,
gradient and curvature, with the rows of its own fold masked. The driver then takes a
Newton step for each fit; for the l1 penalty the step minimizes the quadratic model plus
the penalty by coordinate descent. A fit is done when its optimality conditions hold to
``KKT_TOLERANCE``, which is measured, not guessed from the steps.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import dot, sigmoid
from ..session import cut_lineage
from .gradient import summed
from .splits import fit_class_weights, stratified_folds

# The default hyper-parameter grid.
DEFAULT_C = (0.01, 0.1, 1.0, 10.0, 100.0)
DEFAULT_PENALTIES = ("l1", "l2")
DEFAULT_SPLITS = 5
DEFAULT_MAX_ITER = 10_000
#: Largest violation of the optimality conditions, per unit of weight.
KKT_TOLERANCE = 1e-7
#: Curvatures of so many bytes are summed in one scan; more fits take turns.
CURVATURE_BYTES = 64 << 20
ROWS_PER_STEP = 4096


@dataclass
class LinearModel:
    coefficients: list[float]
    intercept: float
    iterations: int = 0
    converged: bool = True
    kkt: float = 0.0

    def margin(self, features: Column) -> Column:
        return dot(features, F.lit(self.coefficients)) + F.lit(self.intercept)


@dataclass
class Task:
    """One fit: the fold it leaves out (None: none), the strength and the penalty."""

    fold: int | None
    c: float
    penalty: str
    weight: float = 0.0  # of its rows, all in all


@dataclass
class _State:
    """Where a fit stands. The intercept is the last coefficient."""

    strength: float
    l1: bool
    now: np.ndarray
    value: float = np.inf
    grad: np.ndarray = field(default_factory=lambda: np.empty(0))
    curve: np.ndarray = field(default_factory=lambda: np.empty(0))
    step: np.ndarray = field(default_factory=lambda: np.empty(0))
    size: float = 1.0
    kkt: float = np.inf
    scans: int = 0
    done: bool = False

    def penalty(self, at: np.ndarray) -> float:
        own = at[:-1]
        return self.strength * (np.abs(own).sum() if self.l1 else 0.5 * own @ own)

    def trial(self) -> np.ndarray:
        return self.now if not len(self.step) else self.now + self.size * self.step

    def violation(self) -> float:
        g, own = self.grad[:-1], self.now[:-1]
        if self.l1:
            out = np.where(own != 0, np.abs(g + self.strength * np.sign(own)), np.maximum(np.abs(g) - self.strength, 0))
        else:
            out = np.abs(g + self.strength * own)
        return float(max(out.max(initial=0.0), abs(self.grad[-1])))

    def advance(self, loss: float, grad: np.ndarray, curve: np.ndarray, tol: float) -> None:
        """Take in what the scan found at the trial point and choose the next one."""
        self.scans += 1
        at = self.trial()
        value = loss + self.penalty(at)
        if value > self.value + 1e-13 * abs(self.value) and self.size > 1e-6:
            self.size /= 2
            return
        self.now, self.value, self.grad, self.curve, self.size = at, value, grad, curve, 1.0
        self.kkt = self.violation()
        self.done = self.kkt <= tol
        if not self.done:
            self.step = self._l1_step() if self.l1 else self._l2_step()

    def _l2_step(self) -> np.ndarray:
        shrink = np.full(len(self.now), self.strength)
        shrink[-1] = 0.0
        h = self.curve + np.diag(shrink + 1e-12)
        return -np.linalg.solve(h, self.grad + shrink * self.now)

    def _l1_step(self, sweeps: int = 2000) -> np.ndarray:
        """Coordinate descent on the quadratic model plus the penalty."""
        h = self.curve + np.diag(np.full(len(self.now), 1e-12))
        d, pull = np.zeros(len(self.now)), self.grad.copy()  # pull is the model's slope at d
        diagonal = np.diag(h).copy()
        for _ in range(sweeps):
            most = 0.0
            for j in range(len(d)):
                target = self.now[j] + d[j] - pull[j] / diagonal[j]
                if j < len(d) - 1:
                    target = np.sign(target) * max(abs(target) - self.strength / diagonal[j], 0.0)
                change = target - self.now[j] - d[j]
                if change:
                    d[j] += change
                    pull += change * h[:, j]
                    most = max(most, abs(change) * diagonal[j])
            if most < 0.01 * KKT_TOLERANCE:
                break
        return d


def _inputs(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x = np.asarray(piece.column("f").flatten(), dtype=float).reshape(piece.num_rows, -1)
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    return x, *(np.asarray(piece.column(c), dtype=float) for c in ("y", "w", "fold"))


def _scan(shared: object, piece: pa.RecordBatch) -> np.ndarray:
    """Per fit: loss, gradient and curvature at its point over the rows that it uses."""
    points, folds = shared
    total = np.zeros((len(folds), 1 + points.shape[1] + points.shape[1] ** 2))
    size = points.shape[1]
    for start in range(0, piece.num_rows, ROWS_PER_STEP):
        x, y, w, fold = _inputs(piece.slice(start, ROWS_PER_STEP))
        margin = x @ points.T
        used = w[:, None] * (fold[:, None] != folds[None, :])
        p = 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))
        total[:, 0] += (used * (np.logaddexp(0.0, margin) - y[:, None] * margin)).sum(0)
        total[:, 1 : size + 1] += (used * (p - y[:, None])).T @ x
        bend = used * p * (1.0 - p)
        for k in range(len(folds)):
            total[k, size + 1 :] += ((x * bend[:, k : k + 1]).T @ x).ravel()
    return total.ravel()


def stacked_fits(
    rows: DataFrame, tasks: list[Task], width: int, max_iter: int = DEFAULT_MAX_ITER, tol: float = KKT_TOLERANCE
) -> list[LinearModel]:
    """Fit all tasks on rows (f, y, w, fold), a scan per iteration for all that are not done.

    Losses are means over a fit's weight, so strength C is a penalty of 1 / (C * weight).
    """
    states = [_State(1.0 / (t.c * t.weight), t.penalty == "l1", np.zeros(width + 1)) for t in tasks]
    at_once = max(1, CURVATURE_BYTES // (8 * (width + 2) ** 2))
    for _ in range(max_iter):
        open_ = [k for k, s in enumerate(states) if not s.done]
        if not open_:
            break
        for first in range(0, len(open_), at_once):
            part = open_[first : first + at_once]
            points = np.stack([states[k].trial() for k in part])
            folds = np.array([-1.0 if tasks[k].fold is None else tasks[k].fold for k in part])
            found = summed(rows, (points, folds), _scan, max(width, len(part)))
            for k, row in zip(part, found.reshape(len(part), -1), strict=True):
                row = row / tasks[k].weight
                states[k].advance(row[0], row[1 : width + 2], row[width + 2 :].reshape(width + 1, -1), tol)
    return [
        LinearModel([float(v) for v in s.now[:-1]], float(s.now[-1]), s.scans, s.done, s.kkt) for s in states
    ]


def fit_logreg(
    df: DataFrame,
    c: float,
    penalty: str,
    weight_sum: float,
    max_iter: int = DEFAULT_MAX_ITER,
    tol: float = KKT_TOLERANCE,
) -> LinearModel:
    """One fit on columns (x vector, y, w). ``c`` is the inverse penalty strength."""
    rows = df.select(vector_to_array("x").alias("f"), "y", "w", F.lit(0).alias("fold"))
    width = rows.select(F.size("f").alias("n")).first()["n"]
    return stacked_fits(rows, [Task(None, c, penalty, weight_sum)], width, max_iter, tol)[0]


def _mcc(tp: float, fp: float, tn: float, fn: float) -> float:
    under = sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)
    return (tp * tn - fp * fn) / under if under else 0.0


@dataclass
class GridResult:
    model: LinearModel
    best: dict
    table: list[dict]
    fits: list[tuple[Task, LinearModel]] = field(default_factory=list)
    positives: dict[int, float] = field(default_factory=dict)  # rows of class 1 by fold

    def to_table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.table)


def logreg_grid_cv(
    df: DataFrame,
    features: str = "features",
    label: str = "y",
    weight: str | None = None,
    c_values: tuple[float, ...] = DEFAULT_C,
    penalties: tuple[str, ...] = DEFAULT_PENALTIES,
    n_splits: int = DEFAULT_SPLITS,
    class_weight: str | None = None,
    max_iter: int = DEFAULT_MAX_ITER,
    seed: int = 42,
    key: str = "seq_id",
) -> GridResult:
    """Grid over (C, penalty), stratified folds, scored by MCC, refit on all rows.

    Each grid point tells its most iterations, the largest violation of the optimality
    conditions among its fits and whether all of them are at their optimum. The folded
    table is written once; fits on all rows run along, so the best one is ready at once.
    All held-out rows are scored for all grid points in one scan.
    """
    if class_weight not in (None, "balanced"):
        raise ValueError("class_weight is None or 'balanced'")
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    if class_weight == "balanced":
        per_class = fit_class_weights(df, label)
        table = F.create_map(*[F.lit(v) for kv in per_class.items() for v in kv])
        w = w * table[F.col(label).cast("double")]
    rows = df.where(F.col(label).isNotNull()).select(
        key, F.col(features).cast("array<double>").alias("f"), F.col(label).cast("double").alias("y"), w.alias("w")
    )
    folded = cut_lineage(stratified_folds(rows, "y", n_splits, seed, key).select("f", "y", "w", "fold"))
    facts = folded.groupBy("fold").agg(F.sum("w").alias("w"), F.sum("y").alias("y"), F.max(F.size("f")).alias("width")).collect()
    if not facts:
        raise ValueError("no rows to train on")
    totals = {r["fold"]: r["w"] for r in facts}
    width, everything = max(r["width"] for r in facts), sum(totals.values())
    grid = [(float(c), p) for c in c_values for p in penalties]
    left_out = [*range(n_splits), None]
    tasks = [Task(fold, c, p, everything - totals.get(fold, 0.0)) for fold in left_out for c, p in grid]
    fitted = stacked_fits(folded, tasks, width, max_iter)

    size, held = len(grid), len(grid) * n_splits
    points = np.array([[*m.coefficients, m.intercept] for m in fitted[:held]]).reshape(n_splits, size, -1)

    def confusion(shared: object, piece: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((n_splits, 4, size))
        for start in range(0, piece.num_rows, ROWS_PER_STEP):
            x, y, _, fold = _inputs(piece.slice(start, ROWS_PER_STEP))
            for k in range(n_splits):
                own = fold == k
                hit, yes = x[own] @ shared[k].T > 0, (y[own] == 1)[:, None]
                for cell, n in enumerate((hit & yes, hit & ~yes, ~hit & ~yes, ~hit & yes)):
                    out[k, cell] += n.sum(0)
        return out.ravel()

    counts = summed(folded, points, confusion, max(width, size)).reshape(n_splits, 4, size)
    scores = [[_mcc(*counts[k, :, i].tolist()) for k in range(n_splits)] for i in range(size)]

    table = []
    for i, ((c, p), values) in enumerate(zip(grid, scores)):
        own = fitted[i:held:size]
        mean = sum(values) / n_splits
        row = {"C": c, "penalty": p, "mean_test_score": mean}
        row["iterations"] = max(m.iterations for m in own)
        row["converged"] = all(m.converged for m in own)
        row["kkt_residual"] = max(m.kkt for m in own)
        row["std_test_score"] = sqrt(sum((v - mean) ** 2 for v in values) / n_splits)
        table.append(row | {f"split{i}_test_score": v for i, v in enumerate(values)})
    for row in table:
        row["rank_test_score"] = 1 + sum(r["mean_test_score"] > row["mean_test_score"] for r in table)
    best = next(r for r in table if r["rank_test_score"] == 1)
    model = fitted[held + table.index(best)]
    return GridResult(model, {"C": best["C"], "penalty": best["penalty"]}, table, list(zip(tasks, fitted)), {r["fold"]: r["y"] for r in facts})


def logreg_score(df: DataFrame, model: LinearModel, features: str = "features") -> DataFrame:
    """Add ``y_pred`` and ``y_pred_prob``, the probability of class 1."""
    scored = df.withColumn("_margin", model.margin(F.col(features)))
    return scored.withColumns(
        {
            "y_pred_prob": sigmoid(F.col("_margin")),
            "y_pred": (F.col("_margin") > 0).cast("int"),
        }
    ).drop("_margin")
