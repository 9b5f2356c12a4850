"""Points behind confusion matrices, ROC and precision-recall curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import score_counts
from .ordered import running_sums


def confusion_matrix(
    df: DataFrame, classes: list[int] | None = None, y: str = "y", y_pred: str = "y_pred"
) -> DataFrame:
    """(actual, predicted, n, share of the actual class), zero-filled, real class values."""
    labels = [int(c) for c in (classes or [0, 1])]
    cells = F.array(
        *[
            F.struct(
                F.lit(a).alias("actual"),
                F.lit(p).alias("predicted"),
                F.count_if((F.col(y) == a) & (F.col(y_pred) == p)).alias("n"),
            )
            for a in labels
            for p in labels
        ]
    )
    rows = df.agg(cells.alias("cells")).select(F.inline("cells"))
    per_class = F.sum("n").over(Window.partitionBy("actual"))
    return rows.withColumn("share", F.coalesce(F.try_divide(F.col("n").cast("double"), per_class), F.lit(0.0)))


def roc_points(df: DataFrame, keys: list[str], y: str = "y", prob: str = "y_pred_prob") -> DataFrame:
    """(keys, threshold, fpr, tpr) at every distinct score; collinear points are kept."""
    counts = score_counts(df, keys, y, prob)
    ranked = running_sums(counts, keys, "score", ["pos", "neg"], descending=True)
    return ranked.select(
        *keys,
        F.col("score").alias("threshold"),
        F.try_divide(F.col("cum_neg").cast("double"), F.col("total_neg")).alias("fpr"),
        F.try_divide(F.col("cum_pos").cast("double"), F.col("total_pos")).alias("tpr"),
    )


def pr_points(df: DataFrame, keys: list[str], y: str = "y", prob: str = "y_pred_prob") -> DataFrame:
    """(keys, threshold, precision, recall), closed by (1, 0) without a threshold."""
    counts = score_counts(df, keys, y, prob)
    ranked = running_sums(counts, keys, "score", ["pos", "neg"], descending=True)
    seen = F.col("cum_pos") + F.col("cum_neg")
    recall = F.try_divide(F.col("cum_pos").cast("double"), F.col("total_pos"))
    point = F.struct(
        F.col("score").alias("threshold"),
        (F.col("cum_pos") / seen).alias("precision"),
        F.coalesce(recall, F.lit(1.0)).alias("recall"),
    )
    end = F.struct(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    # The last point of a curve brings the closing one with it.
    last = seen == F.col("total_pos") + F.col("total_neg")
    points = F.when(last, F.array(point, end)).otherwise(F.array(point))
    return ranked.select(*keys, F.inline(points))
