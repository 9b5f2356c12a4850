"""Fitted scalers.

``fit_*`` reads the table once and keeps two numbers per column, as Spark's
own estimators do; applying them is a plain column expression with no join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordered import exact_quantiles


@dataclass
class Scaler:
    """x -> (x - center) / scale * stretch + shift, per column."""

    kind: str
    center: dict[str, float]
    scale: dict[str, float]
    stretch: float = 1.0
    shift: float = 0.0

    def forward(self, name: str, x: Column | None = None) -> Column:
        x = F.col(name) if x is None else x
        z = (x - F.lit(self.center[name])) / F.lit(self.scale[name])
        return z * F.lit(self.stretch) + F.lit(self.shift)

    def inverse(self, name: str, x: Column | None = None) -> Column:
        x = F.col(name) if x is None else x
        z = (x - F.lit(self.shift)) / F.lit(self.stretch)
        return z * F.lit(self.scale[name]) + F.lit(self.center[name])

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.forward(c) for c in self.center})

    def restore(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.inverse(c) for c in self.center})

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (self.kind, c, float(self.center[c]), float(self.scale[c]), self.stretch, self.shift)
            for c in self.center
        ]
        return spark.createDataFrame(
            rows,
            "kind string, column string, center double, scale double, stretch double, shift double",
        )

    @classmethod
    def from_table(cls, table: DataFrame) -> Scaler:
        rows = table.collect()
        return cls(
            rows[0]["kind"],
            {r["column"]: r["center"] for r in rows},
            {r["column"]: r["scale"] for r in rows},
            rows[0]["stretch"],
            rows[0]["shift"],
        )


def _nonzero(x: float) -> float:
    return x if x else 1.0


def fit_robust_scaler(
    df: DataFrame, columns: list[str], accuracy: int | None = None
) -> Scaler:
    """Median and inter-quartile range; exact unless an accuracy is given."""
    if accuracy is not None:
        quarter = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
        row = df.agg(
            *[F.percentile_approx(c, quarter, F.lit(accuracy)).alias(c) for c in columns]
        ).first()
        quartiles = {c: row[c] for c in columns}
    else:
        long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
            [], columns, "column", "value"
        )
        rows = exact_quantiles(long, ["column"], "value", [0.25, 0.5, 0.75]).collect()
        quartiles = {r["column"]: (r["q0"], r["q1"], r["q2"]) for r in rows}
    return Scaler(
        "RobustScaler",
        {c: quartiles[c][1] for c in columns},
        {c: _nonzero(quartiles[c][2] - quartiles[c][0]) for c in columns},
    )


def fit_minmax_scaler(
    df: DataFrame, columns: list[str], feature_range: tuple[float, float] = (-1.0, 1.0)
) -> Scaler:
    row = df.agg(
        *[F.min(F.col(c).cast("double")).alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(F.col(c).cast("double")).alias(f"hi{i}") for i, c in enumerate(columns)],
    ).first()
    low, high = feature_range
    return Scaler(
        "MinMaxScaler",
        {c: row[f"lo{i}"] for i, c in enumerate(columns)},
        {c: _nonzero(row[f"hi{i}"] - row[f"lo{i}"]) for i, c in enumerate(columns)},
        stretch=high - low,
        shift=low,
    )


def fit_standard_scaler(df: DataFrame, columns: list[str]) -> Scaler:
    row = df.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    return Scaler(
        "StandardScaler",
        {c: row[f"m{i}"] for i, c in enumerate(columns)},
        {c: _nonzero(row[f"s{i}"]) for i, c in enumerate(columns)},
    )


def fit_target_scaler(df: DataFrame, kind: str | None, target: str = "y") -> Scaler:
    """Scaler of the training labels; ``None`` passes values through."""
    if kind is None:
        return Scaler("None", {target: 0.0}, {target: 1.0})
    if kind == "MinMaxScaler":
        return fit_minmax_scaler(df, [target], (0.0, 1.0))
    if kind == "RobustScaler":
        return fit_robust_scaler(df, [target])
    if kind == "StandardScaler":
        return fit_standard_scaler(df, [target])
    raise ValueError(f"unknown target scaler {kind!r}")


def scale_target(df: DataFrame, scaler: Scaler, target: str = "y") -> DataFrame:
    return df.withColumn(f"{target}_scaled", scaler.forward(target))


def restore_target(
    df: DataFrame, scaler: Scaler, prediction: str = "y_pred", target: str = "y"
) -> DataFrame:
    return df.withColumn(prediction, scaler.inverse(target, F.col(prediction)))


@dataclass
class VectorScaler:
    """Per-dimension scaler of an array column."""

    kind: str
    center: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)

    def forward(self, arr: Column) -> Column:
        params = F.lit([[float(c), float(s)] for c, s in zip(self.center, self.scale)])
        return F.zip_with(arr, params, lambda x, p: (x.cast("double") - p[0]) / p[1])


def fit_vector_scaler(df: DataFrame, column: str, kind: str = "StandardScaler") -> VectorScaler:
    """One JVM-side pass over the vectors of the training rows."""
    vector = array_to_vector(F.col(column).cast("array<double>"))
    if kind == "StandardScaler":
        stats = df.select(
            Summarizer.metrics("mean", "variance", "count").summary(vector).alias("s")
        ).select(
            vector_to_array("s.mean").alias("m"),
            vector_to_array("s.variance").alias("v"),
            F.col("s.count").alias("n"),
        ).first()
        shrink = (stats["n"] - 1) / stats["n"]  # Summarizer gives the sample variance
        scale = [_nonzero((v * shrink) ** 0.5) for v in stats["v"]]
        return VectorScaler(kind, list(stats["m"]), scale)
    if kind == "MinMaxScaler":
        stats = df.select(Summarizer.metrics("min", "max").summary(vector).alias("s")).select(
            vector_to_array("s.min").alias("lo"), vector_to_array("s.max").alias("hi")
        ).first()
        scale = [_nonzero(h - l) for l, h in zip(stats["lo"], stats["hi"])]
        return VectorScaler(kind, list(stats["lo"]), scale)
    if kind == "RobustScaler":
        long = df.select(F.posexplode(F.col(column).cast("array<double>")).alias("dim", "value"))
        rows = exact_quantiles(long, ["dim"], "value", [0.25, 0.5, 0.75]).collect()
        rows = sorted(rows, key=lambda r: r["dim"])
        return VectorScaler(kind, [r["q1"] for r in rows], [_nonzero(r["q2"] - r["q0"]) for r in rows])
    raise ValueError(f"unknown embedding scaler {kind!r}")


def standardize_embeddings(
    df: DataFrame, column: str, scaler: VectorScaler, out: str | None = None
) -> DataFrame:
    return df.withColumn(out or column, scaler.forward(F.col(column)))
