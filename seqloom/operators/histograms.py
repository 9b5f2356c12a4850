"""Histogram tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import HISTOGRAM_BINS


def bin_index(x: Column, low: Column, high: Column, bins: int = HISTOGRAM_BINS) -> Column:
    """0-based bin, the last one closed; null outside [low, high]."""
    scaled = F.floor((x - low) / ((high - low) / F.lit(float(bins))))
    inside = (x >= low) & (x <= high)
    return F.when(inside, F.least(scaled, F.lit(bins - 1)).cast("int"))


def target_histogram(
    df: DataFrame, value: str = "y", split: str = "data_split", bins: int = HISTOGRAM_BINS
) -> DataFrame:
    """(split, bin, lo, hi, n, density) for train and test, each over its own range.

    The range is one row per split, two at most, and is broadcast;
    counts then shrink to ``bins`` rows per split before the shuffle.
    """
    used = df.where(F.col(split).isin("train", "test") & F.col(value).isNotNull()).select(
        split, F.col(value).cast("double").alias("x")
    )
    ranges = used.groupBy(split).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    # A constant column gets the half-unit range on both sides.
    flat = F.col("lo") == F.col("hi")
    ranges = ranges.select(
        split,
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    binned = used.join(F.broadcast(ranges), split).withColumn(
        "bin", bin_index(F.col("x"), F.col("lo"), F.col("hi"), bins)
    )
    counts = binned.groupBy(split, "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    total = F.sum("n").over(Window.partitionBy(split))
    return counts.select(
        split,
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"),
        "n",
        (F.col("n") / (total * width)).alias("density"),
    )
