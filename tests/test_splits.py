import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seqloom.operators import splits


def sizes(df):
    return {r["data_split"]: r["count"] for r in df.groupBy("data_split").count().collect()}


def test_random_split_sizes_and_repeatability(spark):
    ids = spark.range(1003).withColumnRenamed("id", "seq_id")
    a = splits.random_split_3way(ids, 0.7, 0.2, 0.1, seed=1)
    assert sizes(a) == {"train": 702, "val": 200, "test": 101}
    b = splits.random_split_3way(ids.repartition(13), 0.7, 0.2, 0.1, seed=1)
    assert sorted(a.collect()) == sorted(b.collect())
    c = splits.random_split_3way(ids, 0.7, 0.2, 0.1, seed=2)
    assert sorted(a.collect()) != sorted(c.collect())
    assert sizes(splits.random_split_2way(ids, 0.8)) == {"train": 802, "test": 201}
    with pytest.raises(ValueError):
        splits.random_split_3way(ids, 0.7, 0.2, 0.2)


def test_stratified_folds_are_even(spark):
    df = spark.range(1000).select(
        F.col("id").alias("seq_id"), (F.col("id") % 10 == 0).cast("double").alias("y")
    )
    counts = splits.stratified_folds(df, "y", 4).groupBy("y", "fold").count().collect()
    assert {r["count"] for r in counts if r["y"] == 1.0} == {25}
    assert {r["count"] for r in counts if r["y"] == 0.0} == {225}


def test_empty_needed_split_fails(spark):
    df = spark.createDataFrame([("train",), ("val",)], "data_split string")
    with pytest.raises(PySparkException, match="empty split"):
        splits.predefined_split(df).collect()


def test_class_weights(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (0.0,), (0.0,), (None,)], "value_bool double")
    assert splits.fit_class_weights(df) == {0.0: pytest.approx(4 / 6), 1.0: 2.0}
    assert splits.balanced_class_weight(df).where("class_weight is null").count() == 1


def test_long_fold_names_stay_whole(spark):
    name = "f" * 250
    df = spark.createDataFrame([(1, "train")], f"seq_id long, data_split_{name} string")
    assert splits.fold_columns_to_long(df, ["seq_id"]).first()["fold"] == name


def test_labels_outside_their_domain_are_refused(spark):
    df = spark.createDataFrame([(float(i),) for i in range(5)], "value_bool double")
    with pytest.raises(ValueError):
        splits.fit_class_weights(df)
    assert len(splits.fit_class_weights(df, classes=range(5))) == 5
