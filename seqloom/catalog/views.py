"""Tables every registered query starts from, in Spark and in SQL.

Sequences come from the whole text of ``documents``: letters only, upper case,
letters outside the 20-letter alphabet dropped.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import ALPHABET, ZSCALE
from ..operators.attention import FoldModel
from ..session import shuffle_width
from ..sources.readers import spread_rows

# Stored cutoffs of the five folds.
CUTOFFS = {"fold1": 0.42, "fold2": 0.34, "fold3": 0.34, "fold4": 0.35, "fold5": 0.42}
FOLDS = list(CUTOFFS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(key: Column) -> Column:
    return F.when(key % 10 < 8, "train").when(key % 10 == 8, "val").otherwise("test")


def letters_of(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))


def sequence_of(text: Column) -> Column:
    """``letters_of`` without the letters outside the alphabet, in one pass over runs of them."""
    return F.upper(F.regexp_replace(text, f"[^{ALPHABET}{ALPHABET.lower()}]+", ""))


def sequences(spark: SparkSession, sf_dir: str, labels: bool = False) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq_id"),
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("name"),
        F.col("lang").alias("group"),
        split_of(F.col("doc_id")).alias("data_split"),
        sequence_of(F.col("text")).alias("sequence"),
    )
    docs = spread_rows(docs, shuffle_width(spark))
    if not labels:
        return docs
    quality = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("seq_id"), F.col("quality").cast("double").alias("value_bool")
    )
    return docs.join(quality, "seq_id", "left")


def benchmark_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short passages, whole: the texts small enough for pairwise SQL."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("seq_id"),
        sequence_of(F.col("text")).alias("sequence"),
        F.when(F.col("item_id") % 4 == 0, "test").otherwise("train").alias("data_split"),
    )


def residue_labels(sequence: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(sequence, "[VILFYWM]", "1"), "[A-Z]", "0")


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    prob = F.least(F.col("value") / 500.0, F.lit(1.0))
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 3 == 0, 1).otherwise(0).alias("y"),
        (prob >= 0.35).cast("int").alias("y_pred"),
        prob.alias("y_pred_prob"),
        F.col("event_type").alias("group"),
        split_of(F.col("user_id")).alias("data_split"),
    )


def regression_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("value").alias("y"),
        (F.col("value") * F.lit(0.8) + F.col("event_id") % 7).alias("y_pred"),
        F.col("event_type").alias("group"),
        split_of(F.col("user_id")).alias("data_split"),
    )


def featured_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("data_type"),
        F.col("user_id").alias("data_user"),
        F.col("value").alias("data_value"),
        split_of(F.col("user_id")).alias("data_split"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("seq_id"),
        "embedding",
        "label",
        split_of(F.col("vec_id")).alias("data_split"),
    )


def featured_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with two facts about their document, a class and a number to learn."""
    facts = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq_id"),
        F.col("lang").alias("data_lang"),
        F.col("n_chars").cast("double").alias("data_chars"),
    )
    return vectors(spark, sf_dir).join(facts, "seq_id").select(
        "seq_id",
        F.col("embedding").cast("array<double>").alias("embedding"),
        "data_split",
        "data_lang",
        "data_chars",
        (F.col("label") < 5).cast("double").alias("value_bool"),
        F.col("label").cast("double").alias("value_real"),
    )


# -- weights by formula --------------------------------------------------------


def weight(f: int, layer: int, i: int, j: int, k: int) -> float:
    return (((f * 13 + layer * 11 + i * 31 + j * 17 + k * 7) % 19) - 9) / 20.0


def dense_scale(inputs: int) -> float:
    """Keeps the sums of wide layers in the range of narrow ones."""
    return min(1.0, 4.0 / inputs)


def fold_models(
    kernel: int = 3,
    channels: int = 2,
    hidden: int | tuple[int, ...] = 4,
    folds: int = 5,
    width: int = len(ZSCALE["A"]),
    outputs: int = 1,
) -> list[FoldModel]:
    """Convolution over ``width`` inputs, attention, hidden layers, a batch norm behind the last."""
    sizes = (channels, *((hidden,) if isinstance(hidden, int) else hidden), outputs)
    models = []
    for f in range(1, folds + 1):

        def conv(layer: int, f: int = f) -> tuple[np.ndarray, np.ndarray]:
            w = [
                [[weight(f, layer, i, j, k) for k in range(channels)] for j in range(width)]
                for i in range(kernel)
            ]
            return np.array(w), np.array([weight(f, layer, 5, 0, k) for k in range(channels)])

        head = []
        for n, (a, b) in enumerate(zip(sizes, sizes[1:])):
            own = [[weight(f, 3 + 2 * n, 0, j, k) for k in range(b)] for j in range(a)]
            layer = {
                "weight": np.array(own) * dense_scale(a),
                "bias": np.array([weight(f, 3 + 2 * n, 5, 0, k) for k in range(b)]),
            }
            if n == len(sizes) - 3:
                layer["gain"] = np.array([1.0 + weight(f, 4 + 2 * n, 0, 0, k) for k in range(b)])
                layer["offset"] = np.array([weight(f, 4 + 2 * n, 5, 0, k) for k in range(b)])
            head.append(layer)
        fold = f"fold{f}"
        models.append(FoldModel(fold, *conv(1), *conv(2), head, 1.0 + f * 0.1, CUTOFFS[fold]))
    return models


def letter_logits(sequence: Column, f: int = 1) -> Column:
    """A linear head on z-scales alone: one logit per letter."""
    lookup = F.create_map(*[x for a, v in letter_logit_values(f).items() for x in (F.lit(a), F.lit(v))])
    return F.transform(F.split(sequence, ""), lambda a: lookup[a])


def letter_logit_values(f: int = 1) -> dict[str, float]:
    return {
        a: sum(z * weight(f, 1, 0, j, 0) for j, z in enumerate(ZSCALE[a])) + weight(f, 1, 5, 0, 0)
        for a in ALPHABET
    }


def r6(x: Column) -> Column:
    """Six decimals by one formula that is the same arithmetic in every engine.

    The offset a little over one half settles exact halves, which sums in
    another order would reach from either side.
    """
    return F.floor(x * F.lit(1e6) + F.lit(0.5001)) / F.lit(1e6)


# -- the same tables in SQL ----------------------------------------------------

SQL_LETTERS = "upper(regexp_replace({text}, '[^A-Za-z]', '', 'g'))"
SQL_SEQUENCE = f"regexp_replace({SQL_LETTERS}, '[^{ALPHABET}]', '', 'g')"


def sql_split(key: str) -> str:
    return f"CASE WHEN {key} % 10 < 8 THEN 'train' WHEN {key} % 10 = 8 THEN 'val' ELSE 'test' END"


def sql_r6(x: str) -> str:
    return f"(floor(({x}) * 1e6 + 0.5001::DOUBLE) / 1e6)"


SEQS = f"""seqs AS (
  SELECT doc_id AS seq_id, 'doc_' || doc_id AS name, lang AS "group",
         {sql_split('doc_id')} AS data_split, {SQL_SEQUENCE.format(text='text')} AS sequence
  FROM documents)"""

LABELED = SEQS + """, labeled AS (
  SELECT seqs.*, labels.quality::DOUBLE AS value_bool
  FROM seqs LEFT JOIN labels ON seqs.seq_id = labels.doc_id)"""

RESIDUES = SEQS + """, residues AS (
  SELECT seq_id, unnest(range(length(sequence))) AS pos, unnest(string_split(sequence, '')) AS aa
  FROM seqs WHERE length(sequence) > 0)"""

SCORED = f"""scored AS (
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS y,
         least(value / 500.0, 1.0)::DOUBLE AS y_pred_prob,
         (least(value / 500.0, 1.0)::DOUBLE >= 0.35::DOUBLE)::INTEGER AS y_pred,
         event_type AS "group", {sql_split('user_id')} AS data_split
  FROM events)"""

REGRESSION = f"""reg AS (
  SELECT event_id, value AS y, value * 0.8::DOUBLE + event_id % 7 AS y_pred,
         event_type AS "group", {sql_split('user_id')} AS data_split
  FROM events)"""

VECTORS = f"""vectors AS (
  SELECT vec_id AS seq_id, embedding::DOUBLE[] AS embedding, label, {sql_split('vec_id')} AS data_split
  FROM embeddings)"""


FEATURED = VECTORS + """, featured AS (
  SELECT seq_id, v.embedding, v.data_split, d.lang, d.n_chars::DOUBLE AS chars
  FROM vectors v JOIN documents d ON v.seq_id = d.doc_id)"""


def sql_codebook(name: str, values: dict[str, list[float]]) -> str:
    rows = ", ".join(
        "('%s', %s)" % (a, ", ".join(f"{float(x)!r}::DOUBLE" for x in v)) for a, v in values.items()
    )
    width = len(next(iter(values.values())))
    return f"{name}(aa, {', '.join(f'd{i}' for i in range(width))}) AS (VALUES {rows})"


ZBOOK = sql_codebook("zbook", {a: list(v) for a, v in ZSCALE.items()})
