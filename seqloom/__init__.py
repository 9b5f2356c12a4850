"""Sequence scoring and evaluation on Spark: DataFrame in, DataFrame out."""
