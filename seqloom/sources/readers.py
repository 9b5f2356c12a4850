"""Readers for sequence tables, FASTA files and model registries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def spread_rows(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal rows out evenly over ``partitions``, if given.

    For tables of one large row group, which is one task otherwise. The caller
    decides; nothing here looks at the input.
    """
    return df.repartition(partitions) if partitions else df


def read_sequences_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    has_index: bool = False,
) -> DataFrame:
    """Read sequences from CSV; rows without a ``name`` column get ``seq_0, seq_1, ...``.

    ``has_index`` drops the unnamed leading column of a training table. Every
    column is text unless a schema is given, so no pass is spent on inference.
    """
    reader = spark.read.option("header", True).option("escape", '"')
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.csv(path)
    if "sequence" not in df.columns:
        raise ValueError("the CSV needs a 'sequence' column")
    named = "name" in df.columns
    if not named:
        df = _number_rows(df, "row_no").withColumn("name", F.concat(F.lit("seq_"), "row_no"))
        df = df.drop("row_no")
    if has_index:
        df = df.drop(df.columns[0])
    return df


def _number_rows(df: DataFrame, out: str) -> DataFrame:
    """Consecutive 0-based row numbers in file order.

    Only one small row per file split is ordered globally; sequence rows stay
    in their scan partition.
    """
    tagged = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_mid"),
    )
    splits = tagged.groupBy("_file", "_start").agg(
        F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "_file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")
    )
    return (
        tagged.join(offsets, ["_file", "_start"])
        .withColumn(out, F.col("_mid") - F.col("_first") + F.col("_off"))
        .drop("_file", "_start", "_mid", "_first", "_off")
    )


def read_sequences_parquet(
    spark: SparkSession, stem: str, parquet_suffixes: Sequence[str] = (".parquet.gzip", ".parquet")
) -> DataFrame:
    """Read ``stem.csv`` when it is there, else the Parquet file of the same stem."""
    attempts = [(f"{stem}.csv", lambda p: read_sequences_csv(spark, p, has_index=True))]
    attempts += [(stem + suffix, spark.read.parquet) for suffix in parquet_suffixes]
    for path, read in attempts:
        try:
            return read(path)
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"no CSV or Parquet table at {stem}")


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Read wrapped FASTA as (name, sequence).

    Records are split at newline-``>``, so files stay splittable. The name is
    the header up to its first blank.
    """
    records = spark.read.option("lineSep", "\n>").text(path)
    body = F.regexp_extract("value", r"^[^\r\n]*[\r\n]+([\s\S]*)$", 1)
    return (
        records.where(F.trim("value") != "")
        .select(
            F.regexp_extract("value", r"^\s*>?[ \t]*([^\s]*)", 1).alias("name"),
            F.regexp_replace(body, r"\s", "").alias("sequence"),
        )
        .where((F.col("name") != "") | (F.col("sequence") != ""))
    )


_REGISTRY_FIELDS = {
    "class_name": "string",
    "kernel_size": "int",
    "conv1d_output_dim": "int",
    "post_attention": "string",
    "reduction_mode": "string",
    "optimal_cutoff": "double",
    "penalty_weight": "double",
    "data_split_column": "string",
}


def scan_model_registry(
    spark: SparkSession,
    root: str,
    glob: str = "*/fold*/model.yaml",
    path_pattern: str = r"([^/]+)/(fold[^/]*)/[^/]+$",
) -> DataFrame:
    """One row per fold model: hyper-parameters read from its config file.

    ``class_name`` is taken from the ``predictor`` section. Use
    ``fold_counts`` for models and their number of folds.
    """
    files = spark.read.text(f"{root}/{glob}", wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("config")
    )
    predictor = F.regexp_extract("config", r"(?s)(?:^|\n)predictor:\s*\n((?:[ \t]+[^\n]*(?:\n|$))+)", 1)

    def field(name: str, kind: str):
        source = predictor if name == "class_name" else F.col("config")
        text = F.regexp_extract(source, rf"(?m)^\s*{name}:[ \t]*([^\r\n#]*)", 1)
        text = F.trim(F.regexp_replace(text, "[\"']", ""))
        return F.when(~F.lower(text).isin("", "null", "~"), text).try_cast(kind).alias(name)

    return files.select(
        F.regexp_extract("path", path_pattern, 1).alias("model"),
        F.regexp_extract("path", path_pattern, 2).alias("fold"),
        *[field(n, k) for n, k in _REGISTRY_FIELDS.items()],
    )


def fold_counts(registry: DataFrame) -> DataFrame:
    return registry.groupBy("model").agg(F.count(F.lit(1)).alias("n_folds"))
