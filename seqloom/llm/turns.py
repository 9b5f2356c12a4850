"""Turns of conversations in order, numbered without a task that holds a whole conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import running_sums

#: A word, for Java's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``no``, from 1 in each conversation, by turn with nulls first.

    Ties go by role, then text. Rows equal in all of these follow each other in any order,
    which nothing can tell; their place in the table only keeps them from landing in one
    task. One conversation may hold most rows: it is cut into stretches like any other.
    """
    placed = turns.select(
        "conv_id",
        F.struct("turn", "role", "text", F.monotonically_increasing_id().alias("row")).alias("place"),
        F.lit(1).alias("one"),
    )
    summed = running_sums(placed, ["conv_id"], "place", ["one"])
    return summed.select("conv_id", "place.turn", "place.role", "place.text", F.col("cum_one").alias("no"))
