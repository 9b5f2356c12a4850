"""Feature expansion, categorical encoding, assembly and embedding lookup."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import RBF_KERNELS
from ..session import cut_lineage
from .ordered import running_sums


def rbf_centers(low: float, high: float, n_kernels: int) -> list[float]:
    if n_kernels == 1:
        return [low]
    step = (high - low) / (n_kernels - 1)
    return [low + step * i for i in range(n_kernels - 1)] + [high]


def rbf_expand(
    x: Column, low: float = -1.0, high: float = 1.0, n_kernels: int = RBF_KERNELS
) -> Column:
    """Gaussian kernels on a line: one real value becomes ``n_kernels``."""
    width = (high - low) / n_kernels
    return F.array(
        *[
            F.exp(-F.pow((x - F.lit(c)) / F.lit(width), F.lit(2.0)))
            for c in rbf_centers(low, high, n_kernels)
        ]
    )


#: A category of at least one row in so many is dealt over as many salts.
FREQUENT = 64


@dataclass
class Categories:
    """Dictionary of one column: a table (category, index), indices from 0 in code point order.

    However many there are, they stay a table. ``frequent`` names those that many rows
    have, at most ``FREQUENT`` of them.
    """

    column: str
    rows: DataFrame
    size: int
    frequent: list[str]

    def attach(self, df: DataFrame, out: str) -> DataFrame:
        """Add the index of each row's category; an unknown or missing one raises.

        A join by category. Rows of frequent categories go to one of several copies of
        their dictionary row, so no task gets all rows of one category.
        """
        x = F.col(f"`{self.column}`")
        placed = df.withColumns(
            {
                "_category": x,
                "_salt": F.when(x.isin(self.frequent), F.pmod(F.monotonically_increasing_id(), F.lit(FREQUENT))).otherwise(0),
            }
        )
        zero, last = F.lit(0).cast("long"), F.lit(FREQUENT - 1).cast("long")
        copies = F.when(F.col("category").isin(self.frequent), F.sequence(zero, last)).otherwise(F.array(zero))
        book = self.rows.select(
            F.col("category").alias("_category"),
            F.explode(copies).alias("_salt"),
            F.col("index").alias(out),
        )
        message = F.concat(F.lit(f"unknown category in {self.column}: "), F.coalesce("_category", F.lit("null")))
        joined = placed.join(book, ["_category", "_salt"], "left")
        joined = joined.withColumn(out, F.coalesce(out, F.raise_error(message).cast("long")))
        return joined.select(*[F.col(f"`{c}`") for c in df.columns], out)

    def one_hot(self, index: Column) -> Column:
        """As wide as the dictionary, for models that need dense input."""
        places = F.sequence(F.lit(0).cast("long"), F.lit(self.size - 1).cast("long"))
        return F.transform(places, lambda i: (i == index).cast("double")) if self.size else F.array().cast("array<double>")

    def sparse(self, index: Column) -> Column:
        """The same as (size, indices, values)."""
        return F.struct(
            F.lit(self.size).cast("long").alias("size"), F.array(index).alias("indices"), F.array(F.lit(1.0)).alias("values")
        )


def fit_categorical(train: DataFrame, column: str) -> Categories:
    """Categories of the training rows, numbered across range partitions and written once."""
    counts = cut_lineage(
        train.where(F.col(f"`{column}`").isNotNull())
        .groupBy(F.col(f"`{column}`").alias("category"))
        .agg(F.count(F.lit(1)).alias("n")),
        "categories",
    )
    size, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # At most FREQUENT rows can pass.
    frequent = counts.where(F.col("n") * FREQUENT >= F.lit(total)).select("category")
    one = counts.select("category", F.lit(0).alias("all"), F.lit(1).alias("one"))
    numbered = running_sums(one, ["all"], "category", ["one"])
    rows = cut_lineage(numbered.select("category", (F.col("cum_one") - 1).cast("long").alias("index")), "dictionary")
    return Categories(column, rows, size, [r[0] for r in frequent.take(FREQUENT)])


def assemble_features(*parts: Column) -> Column:
    """Concatenate arrays and scalars into one feature array."""
    return F.concat(*[p.cast("array<double>") for p in parts])


def attach_embeddings(
    df: DataFrame,
    embeddings: DataFrame,
    key: str,
    embedding_key: str,
    column: str = "embedding",
    layer: int | None = None,
    n_layers: int | None = None,
    cut_to: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Join precomputed embeddings by id -> (matched rows, ids without one).

    With a layer stack ``layer`` picks one (negative counts from the end);
    ``cut_to`` trims residue vectors to the sequence length.
    """
    value = F.col(column)
    if layer is not None:
        if n_layers is None or not -n_layers <= layer < n_layers:
            raise ValueError(f"layer {layer} is outside 0..{n_layers}")
        value = F.element_at(value, layer + 1 if layer >= 0 else layer)
    vectors = embeddings.select(F.col(embedding_key).alias("_ekey"), value.alias("embedding"))
    joined = df.join(vectors, F.col(key) == F.col("_ekey")).drop("_ekey")
    if cut_to is not None:
        joined = joined.withColumn("embedding", F.slice("embedding", 1, cut_to))
    missing = df.join(vectors, F.col(key) == F.col("_ekey"), "left_anti").select(key)
    return joined, missing
