"""Ensembles and residue summaries on long score tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import HIGH_RISK_LISTED, HIGH_RISK_THRESHOLD
from ..session import cut_lineage
from .residues import letters


def ensemble_sequence(long: DataFrame) -> DataFrame:
    """Mean over folds per sequence; a single fold gives no ensemble."""
    return (
        long.groupBy("seq_id")
        .agg(F.avg("seq_score").alias("ensemble_score"), F.count(F.lit(1)).alias("n_folds"))
        .where(F.col("n_folds") > 1)
    )


def split_repeated(df: DataFrame, key: str = "seq_id") -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key no other row has, and the others; None if there are none.

    Only the keys are counted; a missing key is one like any other.
    """
    counts = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_rows"))
    repeated = cut_lineage(counts.where("_rows > 1").select("_key"), "repeated")
    if repeated.isEmpty():
        return df, None
    same = F.col(key).eqNullSafe(F.col("_key"))
    return df.join(repeated, same, "left_anti"), df.join(repeated, same, "left_semi")


def ensemble_residue(scored: DataFrame, folds: list[str], distinct_ids: bool = False) -> DataFrame:
    """Mean over the folds' ``fold_residues`` per (seq_id, pos), missing scores left out.

    The folds are added up where the sequence lies, one row per position. With
    ``distinct_ids`` every id has one row and nothing is shuffled; otherwise the rows of
    an id are added up position by position.
    """
    names = [f"_r{i}" for i in range(len(folds))]
    rows = scored.select(
        "seq_id", *[F.col("fold_residues")[f].alias(n) for f, n in zip(folds, names, strict=True)]
    )
    longest = reduce(F.greatest, [F.coalesce(F.size(n), F.lit(0)) for n in names], F.lit(0))
    places = F.when(longest > 0, F.sequence(F.lit(0), longest - 1))
    points = rows.select("seq_id", *names, F.explode(places).alias("pos"))
    values = [F.get(n, F.col("pos")) for n in names]
    total = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in values])
    found = reduce(lambda a, b: a + b, [x.isNotNull().cast("long") for x in values])
    sums = points.select("seq_id", "pos", total.alias("total"), found.alias("n"))
    if not distinct_ids:
        sums = sums.groupBy("seq_id", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return sums.select("seq_id", "pos", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("score"))


def residue_summary(
    residues: DataFrame, threshold: float = HIGH_RISK_THRESHOLD, base: int = 0
) -> DataFrame:
    """Mean, max, min and high-risk positions per sequence.

    Only positions over the threshold are collected, at most one sequence's
    worth per row.
    """
    risky = F.when(F.col("score") > threshold, F.col("pos") + base)
    return residues.groupBy("seq_id").agg(
        F.avg("score").alias("mean"),
        F.max("score").alias("max"),
        F.min("score").alias("min"),
        F.array_sort(F.collect_list(risky)).alias("high_risk_positions"),
    )


def top_high_risk(summary: DataFrame, listed: int = HIGH_RISK_LISTED) -> DataFrame:
    """The first positions of each list and how many there are in all."""
    return summary.select(
        "seq_id",
        F.slice("high_risk_positions", 1, listed).alias("first_positions"),
        F.size("high_risk_positions").alias("n_high_risk"),
    )


def prediction_report(scored: DataFrame, folds: list[str]) -> DataFrame:
    """One row per protein: length, all sequence scores and the summary."""
    summary = F.col("summary")
    return scored.select(
        "seq_id",
        "name",
        F.length("sequence").alias("length"),
        *[F.col("fold_scores")[f].alias(f"{f}_seq_score") for f in folds],
        "ensemble_score",
        summary["mean"].alias("mean"),
        summary["max"].alias("max"),
        summary["min"].alias("min"),
        F.slice(summary["high_risk_positions"], 1, HIGH_RISK_LISTED).alias("first_positions"),
        F.size(summary["high_risk_positions"]).alias("n_high_risk"),
    )


def residue_profile_long(scored: DataFrame, folds: list[str]) -> DataFrame:
    """(seq_id, name, series, position from 1, letter, score) for profile charts."""
    series = F.array(
        *[
            F.struct(F.lit(f).alias("series"), F.col("fold_residues")[f].alias("scores"))
            for f in folds
        ],
        F.struct(F.lit("ensemble").alias("series"), F.col("ensemble_residues").alias("scores")),
    )
    lines = scored.select("seq_id", "name", "sequence", F.explode(series).alias("s"))
    points = F.arrays_zip(
        letters(F.col("sequence")).alias("aa"), F.col("s.scores").alias("score")
    )
    return lines.select(
        "seq_id", "name", F.col("s.series").alias("series"), F.posexplode(points).alias("p", "v")
    ).select(
        "seq_id",
        "name",
        "series",
        (F.col("p") + 1).alias("position"),
        F.col("v.aa").alias("aa"),
        F.col("v.score").alias("score"),
    )
