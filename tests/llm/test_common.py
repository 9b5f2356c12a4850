import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import LABELS, SCHEMA, prose, row
from pyspark.sql import functions as F

from seqloom.llm import common, langid, quality, toxicity
from seqloom.llm.textops import slices


def test_one_id_in_many_rows_takes_one_place(spark):
    """What reaches the driver stays within the bound, whatever repeats."""
    docs = spark.range(50_000).select(
        F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 7).alias("text"), F.lit("en").alias("lang")
    )
    more = [(i, prose(i, 9), "en" if i % 2 else "fr") for i in range(100, 160)]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"))
    marks = [(5, 0, 1, "x")] * 30 + [(i, i % 2, i % 2, "x") for i in range(100, 160)]
    got = common.labelled_sample(docs, spark.createDataFrame(marks, LABELS), "toxic", 20, 1000)
    assert len(got) == 40
    ids = got.column("doc_id").to_pylist()
    assert len(set(ids)) == 40
    again = common.labelled_sample(docs.repartition(9), spark.createDataFrame(marks[::-1], LABELS), "toxic", 20, 1000)
    assert again.equals(got)
    known = common.one_text_per_id(docs, 1000, "lang")
    picked = common.first_by_hash(known, "lang", 10)
    assert common.texts_of(docs, picked, 1000).num_rows == 20


def test_long_and_missing_texts_take_no_place_and_two_labels_teach_nothing(spark):
    rows = [row(i, "x" * 50 if i % 2 else "short") for i in range(40)] + [row(i, None) for i in range(40, 60)]
    marks = [(i, 1, i % 4 // 2, "x") for i in range(60)] + [(2, 1, 0, "x"), (2, 1, 1, "x")]
    got = common.labelled_sample(
        spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, LABELS), "toxic", 8, 20
    )
    ids = got.column("doc_id").to_pylist()
    assert all(i % 2 == 0 and i < 40 for i in ids) and 2 not in ids
    assert got.column("_label").to_pylist().count(0) == got.column("_label").to_pylist().count(1) == 8


def test_a_language_with_most_rows_is_not_ranked_whole(spark):
    known = spark.range(60_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "fr").otherwise("en").alias("lang")
    )
    got = common.first_by_hash(known, "lang", 50)
    want = {}
    for r in known.withColumn("h", F.xxhash64("doc_id")).collect():
        want.setdefault(r.lang, []).append((r.h, r.doc_id))
    assert {(r.lang, r.doc_id) for r in got.collect()} == {(k, d) for k, v in want.items() for _, d in sorted(v)[:50]}


def test_many_short_texts_need_little_memory(spark):
    model = langid.Codes(["a", "b"], langid.codewords(2), np.zeros((1 << langid.HASH_BITS, 1), np.float32), np.zeros(1))
    texts = next(slices(pa.array(["abc"] * 10_000)))
    tracemalloc.start()
    parts = [langid.decode(langid.ngrams(part), model) for part in langid.blocks(texts, langid.ROWS)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(p[0]) for p in parts) == 10_000
    assert peak < 200e6


def test_fitted_in_a_task_by_id(spark):
    docs = spark.range(300).select("id", F.concat(F.lit("text "), "id").alias("text")).withColumnRenamed("id", "doc_id")
    ids, texts, pid = common.fitted(
        docs.repartition(7), lambda rows: (rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), os.getpid())
    )
    assert ids == list(range(300)) and texts == [f"text {i}" for i in ids]
    assert pid != os.getpid()
    empty = docs.where("doc_id < 0")
    assert common.fitted(empty, lambda rows: (len(rows), rows.column_names)) == (0, ["doc_id", "text"])


@pytest.mark.parametrize("what", ["toxic", "quality", "lang"])
def test_samples_are_not_fitted_in_the_driver(spark, what):
    """The driver's Python stands beside its JVM: it gets the model, no texts and no features."""
    words = F.transform(F.sequence(F.lit(1), F.lit(300)), lambda k: F.substring(F.md5((F.col("id") * 7 + k).cast("string")), 1, 6))
    docs = spark.range(1200).select(
        F.col("id").alias("doc_id"),
        F.concat_ws(" ", words, F.when(F.col("id") % 2 == 0, F.lit("vile scum rot"))).alias("text"),
        F.when(F.col("id") % 2 == 0, "en").otherwise("fr").alias("lang"),
    )
    marks = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (1 - F.col("doc_id") % 2).cast("int").alias("toxic"))
    train = {
        "toxic": lambda: toxicity.train(docs, marks),
        "quality": lambda: quality.train(docs, marks),
        "lang": lambda: langid.train(docs),
    }[what]
    tracemalloc.start()
    model = train()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5e6
    if what == "toxic":
        rows = common.labelled_sample(docs, marks, "toxic", toxicity.SAMPLE_ROWS, toxicity.SAMPLE_CHARS)
        label = rows.column("_label").to_numpy().astype(int)
        here = toxicity.fit_field(list(slices(rows.column("text"), toxicity.SAMPLE_BYTES)), label)
        assert (model.weights == here.weights).all() and (model.doc == here.doc).all()
