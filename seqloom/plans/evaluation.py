"""Evaluation run: predictions in, metric tables and files out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import OVERALL, metrics_by_split_group
from ..operators.tables import union_splits
from ..session import cut_lineage
from ..sources.writers import write_eval_tables, write_predictions


def evaluate_predictions(
    parts: dict[str, DataFrame],
    prefix: str,
    task: str = "classification_binary",
    group: str | None = None,
) -> dict[str, str]:
    """Union the split tables, write them, and write the metrics of what was written.

    Predictions are computed once; every metric reads the written table.
    """
    predictions = union_splits(parts)
    if group is not None and group != "group":
        predictions = predictions.withColumn("group", F.col(group).cast("string"))
    paths = {"predictions": write_predictions(predictions, prefix)}
    stored = predictions.sparkSession.read.parquet(paths["predictions"])
    stats = cut_lineage(
        metrics_by_split_group(stored if group is not None else stored.drop("group"), task)
    )
    overall = stats.where(F.col("group") == OVERALL)
    per_group = stats.where(F.col("group") != OVERALL) if group is not None else None
    return paths | write_eval_tables(overall, prefix, per_group)
