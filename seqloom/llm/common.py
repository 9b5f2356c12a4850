"""Reading, folds, bounded training samples and scratch tables of the text operators."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path, ship_package
from .textops import Texts, slices


#: Arrow batches of texts are bounded by bytes; a batch is copied a few times in a task.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Send the package to the executors; lower the session's bound of Arrow batches."""
    ship_package(spark)
    if int(spark.conf.get(_BATCH_CONF).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, of: int) -> Column:
    """crc32 of the key's decimal text, modulo ``of``; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % of


def written(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared scratch folder and read back: lineage ends here."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Leading bits of a hash whose values are counted to find how far a sample goes.
PLACE_BITS = 20


def one_text_per_id(docs: DataFrame, max_chars: int, *columns: str) -> DataFrame:
    """doc_id, ``_text`` (a text's hash) and ``columns`` of one usable row of each id.

    Usable is a text that is not null and has at most ``max_chars`` characters. Of several
    rows with one id that with the smallest hash counts, then the smallest columns.
    """
    usable = docs.where(F.col("doc_id").isNotNull() & (F.length("text") <= max_chars))
    first = F.min(F.struct(F.xxhash64("text").alias("_text"), *columns)).alias("_first")
    return usable.groupBy("doc_id").agg(first).select("doc_id", "_first.*")


def first_by_hash(rows: DataFrame, key: str, each: int) -> DataFrame:
    """The ``each`` rows of every key with the smallest hash of doc_id; ids are distinct.

    Counts per leading bits of the hash tell up to where a key's rows can be among them,
    so a key that holds most rows is never ranked as a whole.
    """
    placed = rows.withColumn("_hash", F.xxhash64("doc_id"))
    placed = placed.withColumn("_place", F.shiftright("_hash", 64 - PLACE_BITS))
    counts = placed.groupBy(key, "_place").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    reached = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_before") < each)
    ends = reached.groupBy(key).agg(F.max("_place").alias("_end"))
    near = placed.join(ends, key).where("_place <= _end")
    ranked = Window.partitionBy(key).orderBy("_hash", "doc_id")
    near = near.withColumn("_no", F.row_number().over(ranked)).where(F.col("_no") <= each)
    return near.drop("_hash", "_place", "_end", "_no")


def picked_texts(docs: DataFrame, picked: DataFrame, max_chars: int) -> DataFrame:
    """doc_id, text and further columns of the picked (doc_id, _text), one row of each.

    ``picked`` is of bounded size and so is the result: as many rows.
    """
    label = [c for c in picked.columns if c not in ("doc_id", "_text")]
    return (
        docs.select("doc_id", "text")
        .where(F.length("text") <= max_chars)
        .withColumn("_text", F.xxhash64("text"))
        .join(F.broadcast(picked), ["doc_id", "_text"])
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), *[F.min(c).alias(c) for c in label])
    )


def texts_of(docs: DataFrame, picked: DataFrame, max_chars: int) -> pa.Table:
    """``picked_texts`` in the driver, by id."""
    return picked_texts(docs, picked, max_chars).toArrow().sort_by([("doc_id", "ascending")])


def fitted(sample: DataFrame, fit: Callable[[pa.Table], Any]) -> Any:
    """What ``fit`` makes of a bounded sample, whose rows it gets by doc_id.

    It runs in a task: texts and what is derived from them stay out of the driver, which
    gets the model alone.
    """
    prepare(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if rows := [b for b in batches if len(b)]:
            yield arrow(["model"], [pa.array([pickle.dumps(fit(pa.Table.from_batches(rows)))], pa.binary())])

    # One task, as the sample is one training set whatever the size of the tables.
    one = sample.repartition(1).sortWithinPartitions("doc_id")
    made = one.mapInArrow(run, "model binary").first()
    if made is None:
        return fit(sample.limit(0).toArrow())
    return pickle.loads(made["model"])


def labelled_rows(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    per_class: int,
    max_chars: int,
) -> DataFrame:
    """Whole texts of at most ``per_class`` labelled documents of each class.

    Documents are taken in the order of a hash of their id, so the sample does not
    depend on the layout of the tables. Texts that are null or longer than ``max_chars``
    take no place. An id labelled both ways teaches nothing and is left out; of several
    texts with one id one counts. So there are at most ``2 * per_class`` rows of
    ``max_chars`` characters, and as many ids are broadcast.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("_label"), F.max(label).cast("int").alias("_most"))
        .where("_label = _most")
        .drop("_most")
    )
    usable = one_text_per_id(docs, max_chars).join(known, "doc_id")
    order = F.xxhash64("doc_id")
    picked = [
        usable.where(F.col("_label") == c).orderBy(order, "doc_id").limit(per_class) for c in (0, 1)
    ]
    return picked_texts(docs, picked[0].unionByName(picked[1]), max_chars)


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    per_class: int,
    max_chars: int,
) -> pa.Table:
    """``labelled_rows`` in the driver, by id."""
    return labelled_rows(docs, labels, label, per_class, max_chars).toArrow().sort_by([("doc_id", "ascending")])


def map_texts(
    df: DataFrame,
    fn: Callable[[Texts, pa.RecordBatch], pa.RecordBatch],
    schema: T.StructType | str,
    column: str = "text",
) -> DataFrame:
    """Apply ``fn`` to slices of bounded size; it gets the texts and their rows."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(column)):
                yield fn(texts, batch.slice(texts.first, len(texts)))

    return df.mapInArrow(run, schema)


def arrow(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns], names
    )


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
