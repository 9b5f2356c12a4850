import random

import pytest
from pyspark.sql import types as T

CLASHES = ("score", "spans", "digest", "bands", "class_id", "copies", "size", "hash", "part",
           "number", "row", "bucket", "held_out", "ids", "_label", "_words")
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in CLASHES],
    ]
)
LABELS = "doc_id long, quality int, toxic int, extra string"


def prose(seed: int, n: int) -> str:
    """Invented words, no two texts alike."""
    rng = random.Random(seed)
    parts = "ba de fi go lu ma ne po ri so ta vu".split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), *["x"] * len(CLASHES))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = prose(1, 60_000)
    return [
        row(1, None),
        row(2, ""),
        row(3, " \t\n "),
        row(4, long, source="b"),
        row(5, prose(2, 80)),
        row(5, prose(2, 80)),
        row(6, prose(2, 80), lang=None, source=None),
        row(None, prose(3, 70), source="b"),
        row(7, "one two three"),
        row(8, "### $$$ *** " * 30, lang="xx"),
        row(9, "é\u0000ß 你好 \U0001f600 " + prose(4, 40), lang="fr"),
        tuple([10, None, None, None, None, *[None] * len(CLASHES)]),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2, "x") for i in range(1, 10)] + [(None, 1, 0, "x"), (3, None, None, None)]
    return spark.createDataFrame(rows, LABELS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], LABELS)


def table(spark, name, sf="0.001"):
    return spark.read.parquet(f"/root/testdata/sf{sf}/{name}.parquet")
