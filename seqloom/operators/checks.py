"""Projections, filters and contract checks on sequence tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import (
    ALPHABET,
    LINKER,
    MASK_PLACEHOLDER,
    MASK_TOKEN,
    MAX_TRAIN_LENGTH,
)


def with_inference_defaults(
    df: DataFrame, split_column: str = "data_split", overwrite_split: bool = False
) -> DataFrame:
    """Add the columns scoring expects where the input has none."""
    defaults = {
        "value_bool": F.lit(1),
        "dataset": F.lit("user_input"),
        split_column: F.lit("test"),
        "len": F.length("sequence"),
    }
    missing = {c: v for c, v in defaults.items() if c not in df.columns}
    if overwrite_split:
        missing[split_column] = F.lit("test")
    return df.withColumns(missing) if missing else df


def foreign_letters(sequence: Column, alphabet: str = ALPHABET) -> Column:
    """The letters outside the alphabet, in order; empty when there are none."""
    return F.translate(sequence, alphabet, "")


def validate_alphabet(
    df: DataFrame, mode: str = "quarantine", alphabet: str = ALPHABET
) -> tuple[DataFrame, DataFrame] | DataFrame:
    """``quarantine`` -> (clean, rejected); ``fail`` -> rows that raise when read.

    Every row is either clean or rejected: a missing sequence is rejected with
    the reason ``missing``, one with other letters with the reason ``letter``.
    """
    foreign = foreign_letters(F.col("sequence"), alphabet)
    if mode == "fail":
        message = F.concat(
            F.lit("sequence "),
            F.col("seq_id").cast("string"),
            F.lit(" contains "),
            F.substring(foreign, 1, 1),
        )
        checked = F.when(foreign != "", F.raise_error(message).cast("string"))
        return df.withColumn("sequence", checked.otherwise(F.col("sequence")))
    if mode != "quarantine":
        raise ValueError("mode is 'quarantine' or 'fail'")
    letter = F.substring("_foreign", 1, 1)
    rejected = (
        df.withColumn("_foreign", foreign)
        .where(F.col("_foreign").isNull() | (F.col("_foreign") != ""))
        .withColumns(
            {
                "reason": F.when(F.col("_foreign").isNull(), "missing").otherwise("letter"),
                "bad_letter": letter,
                "bad_letter_pos": F.instr(F.col("sequence"), letter) - 1,
                "n_bad": F.length("_foreign"),
            }
        )
        .drop("_foreign")
    )
    return df.where(foreign == ""), rejected


def mask_placeholder(sequence: Column, placeholder: str = MASK_PLACEHOLDER) -> Column:
    """Space-separated letters with the placeholder replaced by the mask token."""
    if placeholder in ALPHABET:
        raise ValueError("the mask placeholder must not be an amino-acid letter")
    return F.replace(
        F.array_join(F.split(sequence, ""), " "), F.lit(placeholder), F.lit(MASK_TOKEN)
    )


def tandem_copies(sequence: Column, n: int, linker: str = LINKER) -> Column:
    if linker != LINKER:
        raise ValueError("only the poly-glycine linker is supported")
    if n <= 1:
        return sequence
    return F.array_join(F.array_repeat(sequence, n), linker)


def central_copy_start(length: Column, n: int) -> Column:
    """0-based start of copy ``n // 2`` inside the tandem sequence."""
    return F.lit(n // 2) * (length + len(LINKER)) if n > 1 else F.lit(0)


def central_copy_slice(values: Column, length: Column, n: int) -> Column:
    """Positions of the central copy, cut from a per-position array."""
    return F.slice(values, central_copy_start(length, n) + 1, length)


def too_long(df: DataFrame, limit: int = MAX_TRAIN_LENGTH) -> DataFrame:
    return df.where(F.length("sequence") > limit)


def max_length_guard(df: DataFrame, limit: int = MAX_TRAIN_LENGTH) -> DataFrame:
    """Same rows; a sequence over the limit raises when it is read."""
    message = F.concat(
        F.lit(f"sequence longer than {limit}: "), F.col("seq_id").cast("string")
    )
    guarded = F.when(F.length("sequence") > limit, F.raise_error(message).cast("string"))
    return df.withColumn("sequence", guarded.otherwise(F.col("sequence")))


def check_training_table(
    df: DataFrame,
    task: str,
    fractions: dict[str, float],
    split_column: str | None = None,
    group_column: str | None = None,
) -> DataFrame:
    """Violations table (rule, n_rows), from the schema and one aggregate.

    Column and fraction rules fail before any job runs; row rules are counted
    in a single pass. ``n_rows`` is 0 for a rule that holds.
    """
    if task not in ("classification_binary", "regression"):
        raise ValueError(f"unknown task {task!r}")
    target = "value_bool" if task == "classification_binary" else "value_real"
    missing = [s for s in ("train", "val", "test") if s not in fractions]
    if missing:
        raise ValueError(f"split fractions lack {missing}")
    if abs(sum(fractions.values()) - 1.0) > 1e-9:
        raise ValueError("split fractions must sum to 1")
    needed = ["sequence", target] + [c for c in (split_column, group_column) if c]
    absent = [c for c in needed if c not in df.columns]
    if absent:
        raise ValueError(f"columns not found: {absent}")
    if not isinstance(df.schema[target].dataType, (T.NumericType, T.BooleanType)):
        raise ValueError(f"{target} must be numeric")

    value = F.col(target).cast("double")
    rules = {
        "sequence_missing": F.col("sequence").isNull() | (F.col("sequence") == ""),
        "target_missing": value.isNull(),
        "target_nan": F.isnan(value),
    }
    if task == "classification_binary":
        rules["label_outside_0_1"] = value.isNotNull() & ~value.isin(0.0, 1.0)
    if split_column:
        split = F.col(split_column)
        rules["split_unknown"] = split.isNull() | ~split.isin("train", "val", "test")
    if group_column:
        rules["group_missing"] = F.col(group_column).isNull()
    counts = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(r) for r, c in rules.items()])
    return counts.unpivot([], list(rules), "rule", "n_rows")


def select_target(df: DataFrame, task: str, residue_labels: str | None = None) -> DataFrame:
    """Target column as ``y``; null when the table is unlabeled."""
    column = residue_labels or {
        "classification_binary": "value_bool",
        "regression": "value_real",
    }[task]
    if column not in df.columns:
        return df.withColumn("y", F.lit(None).cast("double"))
    y = F.col(column)
    return df.withColumn("y", y if residue_labels else y.cast("double"))


def select_feature_columns(
    df: DataFrame,
    add: bool | list[str],
    standardize: bool | list[str] = False,
    dimred: bool | list[str] = False,
    split_column: str = "data_split",
) -> dict[str, list[str]]:
    """Resolve the ``data_*`` columns to use, from the schema alone."""

    def resolve(option: bool | list[str], everything: list[str]) -> list[str]:
        if option is True:
            return list(everything)
        if option is False:
            return []
        unknown = [c for c in option if c not in df.columns]
        if unknown:
            raise ValueError(f"columns not found: {unknown}")
        return list(option)

    available = sorted(c for c in df.columns if c.startswith("data_") and c != split_column)
    used = resolve(add, available) if available else []
    if not used:
        return {"add": [], "standardize": [], "dimred": []}
    return {
        "add": used,
        "standardize": resolve(standardize, used),
        "dimred": resolve(dimred, used),
    }


def feature_channels(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Column -> ``categorical`` or ``real``; other types are refused."""
    kinds = {}
    for name in columns:
        dtype = df.schema[name].dataType
        if isinstance(dtype, T.StringType):
            kinds[name] = "categorical"
        elif isinstance(dtype, T.NumericType):
            kinds[name] = "real"
        else:
            raise ValueError(f"column {name} has unsupported type {dtype.simpleString()}")
    return kinds


def typed_feature_channels(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cast the real channels to double and leave the categorical ones as text."""
    kinds = feature_channels(df, columns)
    return df.withColumns(
        {c: F.col(c).cast("double") for c, kind in kinds.items() if kind == "real"}
    )


def describe_columns(df: DataFrame) -> DataFrame:
    """Per column: rows filled and, for text and arrays, the shortest and longest."""
    aggs = []
    for field in df.schema:
        col = F.col(f"`{field.name}`")
        size = None
        if isinstance(field.dataType, T.StringType):
            size = F.length(col)
        elif isinstance(field.dataType, T.ArrayType):
            size = F.size(col)
        aggs.append(
            F.struct(
                F.lit(field.name).alias("column"),
                F.count(col).alias("n_filled"),
                (F.min(size) if size is not None else F.lit(None).cast("int")).alias("min_size"),
                (F.max(size) if size is not None else F.lit(None).cast("int")).alias("max_size"),
            )
        )
    return df.agg(F.array(*aggs).alias("cols")).select(F.inline("cols"))
