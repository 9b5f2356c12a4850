"""Set operations and keyed alignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_splits(parts: dict[str, DataFrame], split_column: str = "data_split") -> DataFrame:
    """One table from per-split tables; an empty split adds no rows."""
    tagged = [df.withColumn(split_column, F.lit(s)) for s, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def distinct_sequences(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("sequence", *extra).distinct()


def attach_labels(df: DataFrame, labels: DataFrame, key: str = "seq_id") -> DataFrame:
    """Labels or predictions by id; rows without one are kept with nulls."""
    return df.join(labels, key, "left")
