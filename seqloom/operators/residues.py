"""Residue tables: one row per letter of a sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import ALPHABET, ZSCALE


def letters(sequence: Column) -> Column:
    """Letters as an array; the empty sequence has none."""
    return F.when(F.length(sequence) > 0, F.split(sequence, "")).otherwise(
        F.array().cast("array<string>")
    )


def residue_explode(df: DataFrame, labels: str | None = None) -> DataFrame:
    """Rows (.., pos, aa, length[, res_value_bool]) with 0-based positions.

    The sequence and the label string stay behind: a row per letter that carried
    them would take the square of their length. A label string must have one digit
    per letter; otherwise the row raises. A missing or empty sequence without labels
    has no rows. Every sequence must give as many rows as it is long, so that a table
    has as many as the lengths add up to; otherwise the row raises.
    """
    kept = [c for c in df.columns if c not in ("sequence", labels)]
    source = df.withColumn("length", F.length("sequence"))
    if labels is None:
        source = source.withColumn("_rows", letters(F.col("sequence")))
        return source.select(*kept, "length", F.posexplode(_all_of("_rows", df)).alias("pos", "aa"))
    digits = F.when(
        F.length(labels).eqNullSafe(F.length("sequence")), letters(F.col(labels))
    ).otherwise(_refusal("labels do not fit sequence", df).cast("array<string>"))
    pairs = F.arrays_zip(letters(F.col("sequence")).alias("aa"), digits.alias("d"))
    exploded = source.withColumn("_rows", pairs).select(
        *kept, "length", F.posexplode(_all_of("_rows", df)).alias("pos", "_pair")
    )
    return exploded.select(
        *kept,
        "length",
        "pos",
        F.col("_pair.aa").alias("aa"),
        F.col("_pair.d").cast("int").alias("res_value_bool"),
    )


def _refusal(what: str, df: DataFrame) -> Column:
    name = F.col("seq_id").cast("string") if "seq_id" in df.columns else F.lit("without id")
    return F.raise_error(F.concat_ws(" ", F.lit(what), name))


def _all_of(rows: str, df: DataFrame) -> Column:
    """The rows of a sequence, if there are as many as it has letters."""
    whole = F.size(rows) == F.coalesce("length", F.lit(0))
    return F.when(whole, F.col(rows)).otherwise(_refusal("rows do not fit sequence", df))


def codebook(kind: str) -> dict[str, list[float]]:
    if kind == "onehot":
        return {a: [1.0 if a == b else 0.0 for b in ALPHABET] for a in ALPHABET}
    if kind == "zscale":
        return {a: list(v) for a, v in ZSCALE.items()}
    raise ValueError("kind is 'onehot' or 'zscale'")


def codebook_table(spark: SparkSession, kind: str) -> DataFrame:
    return spark.createDataFrame(list(codebook(kind).items()), "aa string, vec array<double>")


def encode_residues(residues: DataFrame, kind: str) -> DataFrame:
    """Add ``vec`` to a residue table. The 20-row codebook is a fixed-size broadcast."""
    book = codebook_table(residues.sparkSession, kind)
    return residues.join(F.broadcast(book), "aa")


def encode_onehot(residues: DataFrame) -> DataFrame:
    return encode_residues(residues, "onehot")


def encode_zscale(residues: DataFrame) -> DataFrame:
    return encode_residues(residues, "zscale")


def encoded_array(sequence: Column, kind: str) -> Column:
    """Per-sequence ``array<array<double>>`` without leaving the row."""
    book = codebook(kind)
    lookup = F.create_map(
        *[x for a, v in book.items() for x in (F.lit(a), F.array(*[F.lit(f) for f in v]))]
    )
    return F.transform(letters(sequence), lambda a: lookup[a])


def mean_pool(embedding: Column, width: int) -> Column:
    """Mean over positions of ``array<array<double>>`` with vectors of ``width``."""
    zero = F.array_repeat(F.lit(0.0), width)
    total = F.aggregate(
        embedding, zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b.cast("double"))
    )
    n = F.size(embedding)
    return F.when(
        n > 0,
        F.element_at(
            F.transform(
                F.array(F.struct(total.alias("t"), n.alias("n"))),
                lambda s: F.transform(s["t"], lambda x: x / s["n"]),
            ),
            1,
        ),
    )


def mean_pool_letters(sequence: Column, kind: str) -> Column:
    """Mean-pooled letter encoding from the 20 letter counts, fully compiled."""
    book = codebook(kind)
    counts = {a: F.length(sequence) - F.length(F.replace(sequence, F.lit(a))) for a in ALPHABET}
    width = len(book["A"])
    dims = []
    for d in range(width):
        terms = [counts[a] * F.lit(book[a][d]) for a in ALPHABET if book[a][d] != 0.0]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        dims.append(total / F.length(sequence))
    return F.array(*dims)
